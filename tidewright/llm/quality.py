"""Quality rules: counting rules and a log-likelihood ratio of hashed n-grams, with DataFrame operations only.

Tokens are lower-cased runs of word characters or of other signs; tokens and pairs of
neighbours are hashed into SLOTS slots. The raw multinomial counts the slots
over all documents; the trusted one counts them over documents labelled as good, at most
TRUSTED of them (those of the least id hashes: a documented bound, so that the ids
can be broadcast and no text is shuffled). The raw counts are scaled to the size of the trusted ones and both are smoothed by
PRIOR, so that n-grams that few documents have say little either way, however large the tables are. A document's score is the mean
over its n-grams of ln(trusted / raw), summed in whole thousandths, and it is kept if the score is at least MARGIN: the raw corpus
holds the trusted kind as well as the other, so ordinary documents score near zero and every document is judged by the same number.

Scale: per-document work stays in one row (no explode by document) and is n log n in its words; the counts
are summed in map tasks into SLOTS keys; the two models are arrays of SLOTS numbers, and their ratio is a constant of the plan.

Defined results: null or empty text has no words and fails; one line or word is
fine; without trusted labels the ratio is 0 and only the counting rules decide; null ids and labels are no trusted documents; repeated
rows each get a result; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import WORD, written

SPACE = r"[\x20\x09-\x0D]"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
SLOTS = 1 << 18
TRUSTED = 1 << 15
PRIOR = 3.0
MARGIN = -0.2
MIN_WORDS = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def bound(value: Column, body) -> Column:
    """`body` of a value that is computed once for each row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of three that the text has twice or more."""

    def covered(places: Column) -> Column:
        # Each window adds the words that the one before it did not cover.
        return F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a.n + F.least(F.lit(3), i - a.last)).alias("n")), lambda a: a.n)

    def repeats(hashes: Column) -> Column:
        # Sorted with their places, equal windows are neighbours.
        def twice(o: Column) -> Column:
            return F.filter(o, lambda w, k: (w.h == F.get(o, k - 1).h) | (w.h == F.get(o, k + 1).h))

        with_places = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = bound(with_places, lambda o: F.sort_array(F.transform(twice(o), lambda w: w.i)))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(places))

    windows = bound(words, lambda ws: F.transform(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2))))
    return bound(windows, repeats).cast("long")


def slots(text: Column) -> Column:
    """The slots of a text's tokens and pairs of neighbouring tokens."""

    def both(ts: Column) -> Column:
        one = F.transform(ts, lambda h: F.pmod(h, F.lit(SLOTS)).cast("int"))
        two = F.transform(F.slice(ts, F.lit(1), F.greatest(F.size(ts) - 1, F.lit(0))), lambda h, i: F.pmod(F.xxhash64(h, F.get(ts, i + 1)), F.lit(SLOTS)).cast("int"))
        return F.concat(one, two)

    return bound(F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t)), both)


def counts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.explode(slots(F.col(text_col))).alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))


def log_ratios(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", trusted: int = TRUSTED) -> DataFrame:
    """One row: `ratios`, an array of SLOTS log ratios in thousandths."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("_id")).where("_id is not null").distinct()
    good = F.broadcast(good.orderBy(F.xxhash64("_id"), "_id").limit(trusted))  # at most `trusted` ids
    slim = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    raw = counts(slim, "t")
    target = counts(slim.join(good, F.col("i") == F.col("_id"), "left_semi"), "t")
    every = spark.range(SLOTS).select(F.col("id").cast("int").alias("slot"))
    both = every.join(raw.withColumnRenamed("n", "r"), "slot", "left").join(target.withColumnRenamed("n", "t"), "slot", "left").select("slot", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("t", F.lit(0)).alias("t"))
    packed = both.agg(F.array_sort(F.collect_list(F.struct("slot", "r", "t"))).alias("c"), F.sum("r").alias("rs"), F.sum("t").alias("ts"))
    expected = lambda x: x.r * (F.col("ts") / F.col("rs"))
    ratio = F.transform("c", lambda x: F.when(F.col("ts") == 0, F.lit(0)).otherwise(F.round(1000 * F.log((x.t + PRIOR) / (expected(x) + PRIOR))).cast("int")))
    return packed.select(ratio.alias("ratios"))


def judged(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN, keep_row: bool = False) -> DataFrame:
    """Counts, score and verdict of every document; with keep_row its whole row as `row`."""
    model = written(spark, log_ratios(spark, docs, labels, id_col, text_col), "ratios")
    ratios = F.split(F.lit(model.select(F.array_join("ratios", " ")).first()[0]), " ").cast("array<int>")  # SLOTS numbers
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(*([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_row else []), F.col(f"`{id_col}`").alias("id"), text.alias("t"))
    words = F.regexp_extract_all("t", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    scored = bound(slots(F.col("t")), lambda at: F.struct(F.aggregate(at, F.lit(0).cast("long"), lambda a, x: a + F.get(ratios, x)).alias("total"), F.size(at).alias("n")))
    found = F.struct(
        F.regexp_count("t", F.lit(WORD)).cast("long").alias("n_words"),
        (F.length("t") - F.regexp_count("t", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        scored.alias("s"),
    )

    def verdict(x: Column) -> Column:
        failed = (x.n_words < MIN_WORDS) | (100 * x.n_repeat_words > 50 * x.n_words)
        score = F.when(x.s.n > 0, x.s.total / (1000 * x.s.n)).otherwise(0.0)
        return F.struct(*[x[c].alias(c) for c in COUNTS], failed.alias("base_failed"), score.alias("score"), (~failed & (score >= margin)).alias("kept"))

    # One expression, so that a filter on the verdict computes what it needs but once.
    out = rows.select(*(["row"] if keep_row else []), "id", bound(found, verdict).alias("v"))
    return out.select(*(["row"] if keep_row else []), "id", "v.*")


def good_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Whole rows of the documents that are kept."""
    return judged(spark, docs, labels, keep_row=True).where("kept").select("row.*")
