"""Plans of intervals, partial repairs and replayed decisions over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.operators import planning
from tidewright.sources.tables import events_us, table


def _plan(spark, d):
    o = table(spark, d, "orders")
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    k = F.row_number().over(order)
    occurrences = o.select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("occurrence"), k.alias("ordinal"), (k * 60.0 - F.col("o_orderkey") % 90).alias("start"))
    mixes = table(spark, d, "customer").select(F.col("c_custkey").alias("task"), (F.col("c_custkey") % 20 * 60.0 + 30).alias("duration"))
    return planning.interval_plan(occurrences, mixes)


def k6_occurrence_intervals(spark, d):
    return _plan(spark, d)[0]


def k6_transition_searches(spark, d):
    return _plan(spark, d)[1]


K6 = """
WITH o AS (SELECT o_custkey AS task, o_orderkey AS occurrence, k, k * 60.0 - o_orderkey % 90 AS s, c_custkey % 20 * 60.0 + 30 AS dur
           FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) JOIN customer ON c_custkey = o_custkey),
p AS (SELECT *, lead(s) OVER w AS nx, lag(s) OVER w AS pv, lead(occurrence) OVER w AS rt FROM o WINDOW w AS (PARTITION BY task ORDER BY k))
"""
K6_INTERVALS = K6 + "SELECT task, occurrence, CAST(s AS DOUBLE) AS primary_start, CAST(coalesce(nx, dur) AS DOUBLE) AS primary_end, CASE WHEN s < 0 OR s >= dur THEN 'start_outside_mix' WHEN pv > s THEN 'starts_decrease' WHEN coalesce(nx, dur) <= s THEN 'empty_interval' END AS problem FROM p"
K6_SEARCHES = K6 + "SELECT task, occurrence AS \"left\", rt AS \"right\", CAST(nx AS DOUBLE) AS boundary, CAST(greatest(0, nx - 10) AS DOUBLE) AS search_start, CAST(least(dur, nx + 10) AS DOUBLE) AS search_end FROM p WHERE rt IS NOT NULL"


def k7_partial_repairs(spark, d):
    """Events of each user as cues; by type and value they are trusted, and have candidates."""
    e = events_us(spark, d).withColumn("cue", (F.row_number().over(Window.partitionBy("user_id").orderBy("t_us", "event_id")) - 1).cast("int"))
    start, n = (F.col("cue") * 3000).cast("long"), F.col("event_id")
    cues = e.select(F.col("user_id").alias("task"), "cue", start.alias("start_ms"), (start + 2500).alias("end_ms"))
    status = F.when(n % 3 == 0, "trusted").when((n % 23 == 1) & (F.col("user_id") % 2 == 0), "unknown").otherwise("untrusted")
    trust = e.where("event_id % 29 <> 0 OR user_id % 3 <> 0").select(F.col("user_id").alias("task"), "cue", status.alias("status"))
    at = start + F.floor(F.col("value") * 20).cast("long") - 900
    candidates = e.where("event_id % 5 <> 0").select(F.col("user_id").alias("task"), "cue", F.when(n % 7 == 0, "issue").otherwise("projected").alias("status"), F.when(n % 14 == 0, "crosses_cut").otherwise("").alias("reason"), at.alias("start_ms"), (at + 2400).alias("end_ms"))
    return planning.partial_repair(cues, trust, candidates)


K7 = """
WITH e AS (SELECT user_id AS task, event_id AS n, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS cue FROM events),
x AS (SELECT task, CAST(cue AS INTEGER) AS cue, cue * 3000 AS s, cue * 3000 + 2500 AS f, CASE WHEN n % 29 = 0 AND task % 3 = 0 THEN 'unknown' WHEN n % 3 = 0 THEN 'trusted' WHEN n % 23 = 1 AND task % 2 = 0 THEN 'unknown' ELSE 'untrusted' END AS trust,
             CASE WHEN n % 5 <> 0 THEN CASE WHEN n % 7 = 0 THEN 'issue' ELSE 'projected' END END AS proj, CASE WHEN n % 14 = 0 THEN 'crosses_cut' ELSE 'source_to_mix_projection_unavailable' END AS why,
             CASE WHEN n % 5 <> 0 THEN cue * 3000 + CAST(floor(value * 20) AS BIGINT) - 900 END AS a FROM e),
l AS (SELECT *, a + 2400 AS b, last_value(CASE WHEN trust = 'trusted' THEN f END IGNORE NULLS) OVER (PARTITION BY task ORDER BY cue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo,
             first_value(CASE WHEN trust = 'trusted' THEN s END IGNORE NULLS) OVER (PARTITION BY task ORDER BY cue ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM x),
y AS (SELECT *, CASE WHEN trust = 'trusted' THEN ['preserve', 'explicitly_trusted_editor_timing_locked'] WHEN trust = 'unknown' THEN ['review', 'unknown_timing_trust_requires_review']
        WHEN proj IS NULL THEN ['review', 'untrusted_cue_has_no_source_to_mix_candidate'] WHEN proj <> 'projected' THEN ['block', why] WHEN a < lo THEN ['block', 'candidate_crosses_locked_left_cue']
        WHEN b > hi THEN ['block', 'candidate_crosses_locked_right_cue'] ELSE ['propose_repair', 'candidate_respects_locked_neighbors'] END AS r FROM l),
z AS (SELECT *, last_value(CASE WHEN r[1] = 'propose_repair' THEN b END IGNORE NULLS) OVER (PARTITION BY task ORDER BY cue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb,
             first_value(CASE WHEN r[1] = 'propose_repair' THEN a END IGNORE NULLS) OVER (PARTITION BY task ORDER BY cue ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS na,
             count(*) FILTER (trust = 'trusted') OVER (PARTITION BY task) AS nt, count(*) FILTER (trust = 'untrusted') OVER (PARTITION BY task) AS nu, count(*) OVER (PARTITION BY task) AS nn FROM y),
q AS (SELECT *, r[1] = 'propose_repair' AND (coalesce(pb > a, false) OR coalesce(b > na, false)) AS clash FROM z)
SELECT task, cue, CASE WHEN nt = nn THEN 'preserve' WHEN nt > 0 AND nu > 0 AND nt + nu = nn THEN 'hybrid' ELSE 'rebuild' END AS mode, trust,
       CASE WHEN clash THEN 'block' ELSE r[1] END AS action, CASE WHEN clash THEN 'candidate_overlaps_another_repair_candidate' ELSE r[2] END AS reason,
       CASE WHEN trust <> 'trusted' THEN a END AS new_start_ms, CASE WHEN trust <> 'trusted' THEN b END AS new_end_ms FROM q
"""


def l9_replayed_decisions(spark, d):
    """Orders as issues, lines as decisions on them, each kind with its own allowed actions."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    kind = F.when(F.col("o_orderstatus") == "F", "transition").when(F.col("o_orderstatus") == "O", "timewarp").otherwise("timewarp_discontinuity")
    issues = o.where("o_orderkey % 10 <> 3").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("issue"), kind.alias("kind"))
    said = li.where("l_linenumber = 1 AND l_quantity > 10").groupBy("l_orderkey", "l_returnflag").agg(F.max("l_tax").alias("tax"))
    action = F.when(F.col("l_returnflag") == "A", "confirmed_overlap").when(F.col("l_returnflag") == "N", "confirmed_requires_rebuild").otherwise("confirmed_cut")
    decisions = said.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("issue"), action.alias("action"), F.when(F.col("tax") > 0.01, "heard it").otherwise(" ").alias("rationale"))
    rules = [("transition", "resolved_clear", "cleared"), ("transition", "confirmed_overlap", "blocked"), ("timewarp", "confirmed_requires_rebuild", "rebuild"), ("timewarp_discontinuity", "confirmed_cut", "cut"), ("timewarp_discontinuity", "rejected_requires_remap", "remap")]
    return planning.replayed(issues, decisions, spark.createDataFrame(rules, "kind string, action string, outcome string"))


L9 = """
WITH i AS (SELECT o_custkey AS task, o_orderkey AS issue, CASE o_orderstatus WHEN 'F' THEN 'transition' WHEN 'O' THEN 'timewarp' ELSE 'timewarp_discontinuity' END AS kind FROM orders WHERE o_orderkey % 10 <> 3),
s AS (SELECT l_orderkey, l_returnflag, max(l_tax) AS tax FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 10 GROUP BY 1, 2),
d AS (SELECT o_custkey AS task, o_orderkey AS issue, count(*) AS n, min(CASE l_returnflag WHEN 'A' THEN 'confirmed_overlap' WHEN 'N' THEN 'confirmed_requires_rebuild' ELSE 'confirmed_cut' END) AS action, min(tax) > 0.01 AS told FROM s JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
a(kind, action, outcome) AS (VALUES ('transition', 'confirmed_overlap', 'blocked'), ('timewarp', 'confirmed_requires_rebuild', 'rebuild'), ('timewarp_discontinuity', 'confirmed_cut', 'cut'))
SELECT coalesce(i.task, d.task) AS task, coalesce(i.issue, d.issue) AS issue, i.kind, CASE WHEN coalesce(n, 1) = 1 THEN d.action END AS action,
       CASE WHEN i.issue IS NULL THEN 'foreign' WHEN n IS NULL THEN 'open' WHEN n > 1 THEN 'ambiguous' WHEN outcome IS NULL OR NOT told THEN 'refused' ELSE outcome END AS outcome
FROM i FULL JOIN d ON i.task = d.task AND i.issue = d.issue LEFT JOIN a ON a.kind = i.kind AND a.action = d.action
"""

QUERIES = {
    "k6_occurrence_intervals": (k6_occurrence_intervals, K6_INTERVALS), "k6_transition_searches": (k6_transition_searches, K6_SEARCHES),
    "k7_partial_repairs": (k7_partial_repairs, K7), "l9_replayed_decisions": (l9_replayed_decisions, L9),
}
