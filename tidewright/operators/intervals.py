"""Interval algebra on [start, end) rows of integers, partitioned by keys.

All of it is window functions and equi joins; interval joins go through time buckets, so that Spark can
hash them, and each pair is reported from the one bucket that holds the later of the two starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.folds import by_merge, dealt_by

Keys = list[str]


def with_next(df: DataFrame, keys: Keys, order: Keys, value: str, out: str = "end") -> DataFrame:
    """Each row's `out` is the next row's `value`; null for the last."""
    return df.withColumn(out, F.lead(value).over(Window.partitionBy(*keys).orderBy(*order)))


def capped(df: DataFrame, keys: Keys, order: Keys, start: str, end: str, longest: int) -> DataFrame:
    """Ends no later than start + longest and than the next start."""
    nxt = F.lead(start).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(end, F.least(F.col(end), F.col(start) + longest, nxt))


def islands(df: DataFrame, keys: Keys, start: str = "start", end: str = "end", gap: int = 0, tie: Keys = ()) -> DataFrame:
    """Numbers runs of intervals: a row joins the run if its start <= the greatest end so far + gap."""
    w = Window.partitionBy(*keys).orderBy(start, end, *tie)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(seen.isNull() | (F.col(start) > seen + gap), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def coalesced(df: DataFrame, keys: Keys, start: str = "start", end: str = "end", gap: int = 0, *more: Column) -> DataFrame:
    """One row for each run: its hull, its number of rows and further aggregates."""
    return islands(df, keys, start, end, gap).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"), *more)


def union_length(df: DataFrame, keys: Keys, start: str = "start", end: str = "end") -> DataFrame:
    return coalesced(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered"))


def gaps(df: DataFrame, keys: Keys, start: str = "start", end: str = "end", least: int = 1, tie: Keys = ()) -> DataFrame:
    """Uncovered stretches of at least `least` between the first start and the last end."""
    w = Window.partitionBy(*keys).orderBy(start, end, *tie).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(end).over(w)
    return df.withColumn("gap_start", seen).where(F.col(start) - F.col("gap_start") >= least).select(*keys, "gap_start", F.col(start).alias("gap_end"))


def overlap_join(left: DataFrame, right: DataFrame, keys: Keys, width: int, slack: int = 0, l: tuple[str, str] = ("l_start", "l_end"), r: tuple[str, str] = ("r_start", "r_end"), strict: bool = True, how: str = "inner", dear: bool = False) -> DataFrame:  # noqa: E741
    """Pairs with equal keys whose intervals overlap (strict: by a positive length; else touching or within `slack`).

    Both sides are dealt to buckets of `width`; a pair is kept in the bucket where the later one starts.
    `how` is inner, left_semi or left_anti. `dear`: what is done with the pairs takes time, so an inner join goes by Spark's sort in as many
    parts as the session names, which adaptive execution would join to a few for their few bytes.
    """
    low = F.col(l[0]) - slack
    first = F.floor(low / width).cast("long")
    last = F.floor((F.col(l[1]) + slack) / width).cast("long")
    a = left.withColumn("_b", F.explode(F.sequence(first, F.greatest(first, last)))).withColumn("_f", first)
    rf, rl = F.floor(F.col(r[0]) / width).cast("long"), F.floor(F.col(r[1]) / width).cast("long")
    b = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys], F.explode(F.sequence(rf, F.greatest(rf, rl))).alias("_rb"), rf.alias("_rf"))
    near = (F.col(l[0]) - slack < F.col(r[1])) & (F.col(r[0]) < F.col(l[1]) + slack) if strict else (F.col(l[0]) - slack <= F.col(r[1])) & (F.col(r[0]) <= F.col(l[1]) + slack)
    on = (F.col("_b") == F.col("_rb")) & near
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    if how != "inner":
        ids = [c for c in left.columns]
        hit = a.join(b, on, "left_semi").select(*ids).distinct()
        return hit if how == "left_semi" else left.join(hit, ids, "left_anti")
    if dear:
        a, b = dealt_by(a, [*keys, "_b"]), by_merge(b)
    return a.join(b, on & (F.col("_b") == F.greatest("_f", "_rf"))).drop("_b", "_f", "_rb", "_rf", *[f"_{k}" for k in keys])


def last_before(df: DataFrame, keys: Keys, order: Keys, when: Column, value: Column, out: str) -> DataFrame:
    """As-of: `value` of the nearest preceding row for which `when` holds."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(F.when(when, value), ignorenulls=True).over(w))


def first_after(df: DataFrame, keys: Keys, order: Keys, when: Column, value: Column, out: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(out, F.first(F.when(when, value), ignorenulls=True).over(w))


def windows(df: DataFrame, start: str, end: str, width: int, step: int) -> DataFrame:
    """Sliding windows [t, t + width) from start on, whole ones only."""
    whole = F.col(end) - F.col(start) >= width
    starts = F.when(whole, F.sequence(F.col(start), F.col(end) - width, F.lit(step)))
    return df.withColumn("w_start", F.explode(starts)).withColumn("w_end", F.col("w_start") + width)


def runs(df: DataFrame, keys: Keys, order: Keys, value: Column) -> DataFrame:
    """Numbers maximal runs of equal `value` (null is a value)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.row_number().over(w) == 1, 1).otherwise((~value.eqNullSafe(F.lag(value).over(w))).cast("int"))
    return df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")
