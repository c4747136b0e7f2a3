"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Each source's documents are shuffled (by a seeded hash of id and text, so that equal or missing ids don't meet) and queued once for each
time the source may be read. A document's virtual finish time is the source's
cumulative words up to and including it, over the source's target. All queued
documents are range-sorted by that time, and the mix ends where the total budget is used up.

Scale: no window spans a source or the table. A source is cut into blocks by
ranges of its shuffle key, and the queue into blocks of virtual time; both take about
BLOCK_ROWS rows, so there are more of them the more rows there are. Blocks'
sums are added up first (a row for each block), then each block's rows.
Only ids, sources and sizes are moved, never texts.

Defined results: null text has size 0; a null source is a source of its own, last in order;
rows of size 0 take nothing; repeated rows are rows of their own; a table without
words takes nothing; extra columns are ignored. Reruns agree: the order depends
on contents alone, and equal rows are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.common import WORD, written

WEIGHTS = (5, 2, 1)
#: How often a document may be taken.
REPEATS = 3
BLOCK_ROWS = 4096
SEED = 42


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, n, target) from (source, source_size, n): shares of the whole by weight, at most `repeats` times a source's size.

    The shares are min(cap, level * weight). With sources ordered by cap / weight, all up to the
    last one that its share at the level would exceed are capped; the level is what the caps leave, over the other weights.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    shares = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("w", F.element_at(shares, (F.row_number().over(order) - 1) % len(weights) + 1)).withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
    upto = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))))
    # Source i is capped if, all before it being capped, its share would pass its cap.
    s = s.withColumn("capped", F.col("level") * F.col("w") >= F.col("cap"))
    s = s.withColumn("rest", F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("w")).alias("k"), F.col("level").alias("level")))).over(whole))
    return s.select("source", "source_size", "n", F.when(F.col("rest").isNull() | F.col("capped"), F.col("cap")).otherwise(F.col("rest.level") * F.col("w")).alias("target"))


def block_of(key: Column, n: Column) -> Column:
    """Which of about n / BLOCK_ROWS equal ranges of [0, 1) the key is in."""
    return F.floor(key * F.ceil(n / F.lit(float(BLOCK_ROWS)))).cast("long")


def running(df: DataFrame, group: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """Cumulative sum of `value` over blocks `block` (ordered) of each group and the rows in them, by sums of blocks first."""
    sums = df.groupBy(*group, "block").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("block").alias("_block"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    match = df.block == F.col("_block")
    for g in group:
        match = match & df[g].eqNullSafe(F.col(f"_{g}"))
    inside = Window.partitionBy(*group, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(sums, match).withColumn(out, F.col("_before") + F.sum(value).over(inside)).drop("_before", "_block", *[f"_{g}" for g in group])


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken, row): one row for each document.

    `row` numbers equal (id, source, size) rows from 1.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = (F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).cast("double") / F.lit(2.0**64) + 0.5).cast("double")
    slim = written(spark, docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.least(key, F.lit(1 - 2.0**-53)).alias("key")), "sizes")
    goals = written(spark, targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, repeats), "targets")
    g = goals.select(F.col("source").alias("_s"), "source_size", "n", "target")
    rows = slim.join(g, slim.source.eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("block", block_of(F.col("key"), F.col("n")))
    by = [F.col("key"), F.col("id"), F.col("size")]
    queued = running(rows, ["source"], by, "size", "upto").withColumn("row", F.row_number().over(Window.partitionBy("source", "block", "id", "size").orderBy("upto")))
    queued = written(spark, queued.drop("block", "n"), "queued")
    total = goals.agg(F.sum("source_size").alias("budget"), F.sum("n").alias("rows"))
    turns = F.sequence(F.lit(0), F.lit(repeats - 1))
    # At virtual time 1 each source has just met its target, so a later copy by more than one document never is within the budget.
    copies = queued.where("size > 0").select("id", "source", "size", "row", "target", "upto", "source_size", F.explode(turns).alias("turn"))
    copies = copies.withColumn("finish", (F.col("turn") * F.col("source_size") + F.col("upto")) / F.col("target"))
    copies = copies.join(F.broadcast(total))  # one row
    late = F.col("finish") - F.col("size") / F.col("target")
    copies = copies.withColumn("block", F.floor(F.least(F.col("finish"), F.lit(4.0)) * F.ceil(F.col("rows") / F.lit(float(BLOCK_ROWS)))).cast("long")).where(late <= 1)
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("turn"), F.col("upto"), F.col("id"), F.col("row")]
    served = running(copies.withColumn("all", F.lit(0)), ["all"], order, "size", "used").where("used <= budget")
    taken = served.groupBy("source", "id", "size", "row").agg(F.count("*").alias("copies")).select(F.col("source").alias("_s"), F.col("id").alias("_i"), F.col("size").alias("_z"), F.col("row").alias("_r"), "copies")
    out = queued.join(taken, queued.source.eqNullSafe(F.col("_s")) & queued.id.eqNullSafe(F.col("_i")) & (queued["size"] == F.col("_z")) & (queued.row == F.col("_r")), "left")
    out = out.withColumn("copies", F.coalesce("copies", F.lit(0)))
    return out.select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "row")


def mixed_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: whole rows of `docs`, each as often as it is taken."""
    copies = mix(spark, docs, id_col, text_col, source_col).where("copies > 0").select(F.col("id").alias("_i"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("row").alias("_r"), "copies")
    names = docs.columns
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))
    rows = rows.withColumn("row", F.row_number().over(Window.partitionBy("id", "source", "size").orderBy(F.xxhash64("doc"))))
    taken = rows.join(copies, rows.id.eqNullSafe(F.col("_i")) & rows.source.eqNullSafe(F.col("_s")) & (rows["size"] == F.col("_z")) & (rows.row == F.col("_r")))
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("doc.*")
