"""Cuts, cue groups and collapsed rows, evaluated over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.operators import evaluation
from tidewright.sources.code import ship
from tidewright.sources.tables import events_us, table


def _cases(spark, d):
    e = events_us(ship(spark), d)
    cases = e.groupBy(F.col("user_id").alias("case")).agg(F.element_at(F.array(*map(F.lit, ("en", "ko", "ja", ""))), (F.col("case") % 4 + 1).cast("int")).alias("language"))
    cases = cases.withColumn("timed", F.col("case") % 9 != 0).withColumn("legacy", F.col("case") % 18 == 0).withColumn("tolerance_ms", F.lit(500.0))
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("t_us", "event_id")) * 350.0
    cuts = e.select(F.col("user_id").alias("case"), (F.col("event_id") % 2 == 0).alias("expected"), (at + F.col("value")).alias("at_ms"))
    return cases, cuts


def d5_cut_metrics(spark, d):
    """Errors of matched cuts, overall and by language."""
    cases, cuts = _cases(spark, d)
    return evaluation.cut_metrics(cases, evaluation.cut_errors(cuts, cases.where("timed")))


def i17_cue_groups(spark, d):
    """The lines of each order as reference, and as prediction: every third is joined to the one before, every seventh is missing."""
    parts = table(ship(spark), d, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_name").alias("line"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").join(parts, "l_partkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    rows = rows.withColumn("k", F.row_number().over(order) - 1)
    ref = rows.select("l_orderkey", F.lit(True).alias("expected"), (F.col("k") * 3000).alias("start_ms"), (F.col("k") * 3000 + 2500).alias("end_ms"), F.col("line").alias("text"))
    said = rows.where("l_partkey % 7 <> 0").withColumn("g", F.count_if(F.col("l_partkey") % 3 != 0).over(order)).groupBy("l_orderkey", "g")
    said = said.agg(F.min("k").alias("a"), F.max("k").alias("b"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), " ").alias("text"))
    pred = said.select("l_orderkey", F.lit(False), F.col("a") * 3000 + 200, F.col("b") * 3000 + 2400, F.regexp_replace("text", "e", "a"))
    return evaluation.aligned_groups(ref.union(pred), "l_orderkey")


def e20_collapsed_rows(spark, d):
    """Of each user's events as cues, those that stayed and whose text the next one has too."""
    e = events_us(ship(spark), d).withColumn("cue", (F.row_number().over(Window.partitionBy("user_id").orderBy("t_us", "event_id")) - 1).cast("int"))
    order = Window.partitionBy("user_id").orderBy("cue")
    kept = F.col("event_id") % 3 == 0
    text = F.concat_ws(" ", "event_type", F.floor("value"))
    own = e.withColumn("own", text).withColumn("before", F.when(F.lag("event_id").over(order) % 3 == 0, F.lag(text).over(order)))
    start = (F.col("cue") * 3000).cast("long")
    rows = own.select("user_id", "cue", (F.col("event_id") % 50 == 0).cast("string").alias("track"), F.when(kept, "keep_existing").otherwise("mapped").alias("status"), start.alias("start_ms"), (start + 1500 + F.floor(F.col("value") * 12)).alias("end_ms"), F.col("own").alias("original"), F.concat_ws(" ", "before", "own").alias("text"), F.when(F.col("before").isNotNull(), 2).otherwise(1).alias("n_lines"))
    return evaluation.collapsed_after_unmapped(rows, "user_id")


def l11_confirmed_cases(spark, d):
    """Events of each user as cues of four seconds; every seventh confirms something around itself, of four kinds."""
    e = events_us(spark, d).withColumn("k", (F.row_number().over(Window.partitionBy("user_id").orderBy("t_us", "event_id")) - 1).cast("long"))
    n, start = F.col("event_id"), F.col("k") * 3000 + F.floor(F.col("value") * 3).cast("long")
    cues = e.where("event_id % 10 <> 3").select(F.col("user_id").alias("task"), F.col("event_id").alias("cue"), start.alias("start_ms"), (start + 2600 + n % 5 * 100).alias("end_ms"), F.col("event_type").alias("key"))
    kind = F.element_at(F.array(*map(F.lit, ("interval_text", "interval_timing", "continuous_coverage", "absent_text"))), (n % 4 + 1).cast("int"))
    at = F.col("k") * 3000
    end = F.when(n % 4 < 2, at + 2800).otherwise(at + 9000)
    cases = e.where("event_id % 7 = 2").select(F.col("user_id").alias("task"), n.alias("case"), kind.alias("kind"), at.alias("start_ms"), end.alias("end_ms"), F.lit(250).alias("tolerance_ms"), (n % 3 * 400).alias("max_gap_ms"), F.when(n % 8 == 3, "sign").when(n % 4 == 3, "purchase").otherwise(F.col("event_type")).alias("key"))
    return evaluation.regression_cases(cases, cues)


L11 = """
WITH e AS (SELECT user_id AS task, event_id AS n, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
q AS (SELECT task, k * 3000 + CAST(floor(value * 3) AS BIGINT) AS s, k * 3000 + CAST(floor(value * 3) AS BIGINT) + 2600 + n % 5 * 100 AS f, event_type AS have FROM e WHERE n % 10 <> 3),
c AS (SELECT task, n AS cs, ['interval_text', 'interval_timing', 'continuous_coverage', 'absent_text'][n % 4 + 1] AS kind, k * 3000 AS a, k * 3000 + CASE WHEN n % 4 < 2 THEN 2800 ELSE 9000 END AS b, n % 3 * 400 AS gap,
             CASE WHEN n % 8 = 3 THEN 'sign' WHEN n % 4 = 3 THEN 'purchase' ELSE event_type END AS want FROM e WHERE n % 7 = 2),
m AS (SELECT c.*, s, f, have, greatest(a, coalesce(max(f) OVER (PARTITION BY c.task, cs ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a)) AS before FROM c JOIN q ON q.task = c.task AND s < b AND f > a WHERE kind = 'continuous_coverage'),
v AS (SELECT task, cs, NOT bool_or(s - before > gap) AND max(f) >= any_value(b) AS covered FROM m GROUP BY 1, 2)
SELECT c.task, cs AS "case", kind, CASE kind WHEN 'interval_timing' THEN EXISTS (SELECT 1 FROM q WHERE q.task = c.task AND abs(s - a) <= 250 AND abs(f - b) <= 250)
    WHEN 'interval_text' THEN EXISTS (SELECT 1 FROM q WHERE q.task = c.task AND abs(s - a) <= 250 AND abs(f - b) <= 250 AND have = want)
    WHEN 'absent_text' THEN NOT EXISTS (SELECT 1 FROM q WHERE q.task = c.task AND s < b AND f > a AND contains(have, want)) ELSE coalesce(covered, false) END AS passed
FROM c LEFT JOIN v USING (task, cs)
"""

QUERIES = {"d5_cut_metrics": (d5_cut_metrics, None), "l11_confirmed_cases": (l11_confirmed_cases, L11), "i17_cue_groups": (i17_cue_groups, None), "e20_collapsed_rows": (e20_collapsed_rows, None)}
