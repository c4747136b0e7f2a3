"""Aggregations, evaluation metrics, gates and lineage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidewright.functions.dialect import both
from tidewright.operators import folds, lineage
from tidewright.sources.code import ship
from tidewright.sources.tables import events_us, table

#: Truth and prediction: each line's price and a prediction that is off by its discount and tax.
ERR = "e AS (SELECT *, abs(l_discount - l_tax) * 1000 AS err FROM {lineitem})"



def m6_lineage_walk(spark, d):
    """What each nation and supplier belongs to, at every depth."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("child"), F.concat(F.lit(b), F.col(y).cast("string")).alias("parent"))
    return lineage.walk(edge(n, "n", "n_nationkey", "r", "n_regionkey").union(edge(s, "s", "s_suppkey", "n", "s_nationkey")))


def d7_robust_line(spark, d):
    """A robust line through all pairs of a user's events, refitted once on what lies near it. Pairs are made where a user's events are, so only events are shuffled."""

    def run(x: list[float], y: list[float | None]) -> list[tuple]:
        if x[0] == x[-1]:
            return []
        known = np.array([v is not None for v in y])
        x, y = np.array(x)[known], np.array([v for v in y if v is not None], np.float64)
        if (slope := folds.median_slope(x, y)) is None:
            return [(None, None)]
        near = np.abs(y - folds.middle(y - slope * x) - slope * x) <= 15
        return [(slope, folds.median_slope(x[near], y[near]))]

    e = events_us(ship(spark), d).select("user_id", (F.col("t_us") / F.lit(1e11)).alias("x"), F.col("value").alias("y")).where("x IS NOT NULL AND user_id IS NOT NULL")
    lines = folds.by_sorted(e, ["user_id"], ["x", F.col("y")], ["x", "y"], run, "slope double, refit double")
    return lines.select("user_id", F.round("slope", 4).alias("slope"), F.round("refit", 4).alias("refit"))


QUERIES = {
    "d1_metric_report": both(f"""
        WITH {ERR} SELECT l_returnflag, count(*) AS n, round(avg(err), 3) AS mae, round(PCT[err|0.5], 3) AS p50, round(PCT[err|0.9], 3) AS p90, round(PCT[err|0.95], 3) AS p95, round(avg(CASE WHEN err <= 25 THEN 1e0 ELSE 0e0 END), 6) AS within_rate,
        round(coalesce(sum(l_quantity * l_discount) / nullif(sum(l_quantity), 0), 0.0), 6) AS ratio_of_sums FROM e GROUP BY 1"""),
    "d2_grouping_sets": both(f"""
        WITH {ERR} SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'flag:' || l_returnflag WHEN grouping(l_linestatus) = 0 THEN 'status:' || l_linestatus ELSE 'overall' END AS scope, count(*) AS n, round(avg(err), 3) AS mae
        FROM e GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())"""),
    "d3_family_metrics": both("""
        WITH f AS (SELECT l_returnflag, l_quantity, 'discount' AS family, l_discount AS x FROM {lineitem} UNION ALL SELECT l_returnflag, l_quantity, 'tax', l_tax FROM {lineitem}),
        b AS (SELECT family, 'all' AS bucket, x FROM f UNION ALL SELECT family, 'flag:' || l_returnflag, x FROM f UNION ALL SELECT family, 'large', x FROM f WHERE l_quantity > 30 UNION ALL SELECT family, 'extreme', x FROM f WHERE x > 0.07)
        SELECT family, bucket, count(*) AS n, round(avg(x), 6) AS mean_x, round(PCT[x|0.9], 6) AS p90_x FROM b GROUP BY 1, 2"""),
    "d4_percentiles": both("SELECT o_orderpriority, round(PCT[o_totalprice|0.05], 4) AS p05, round(PCT[o_totalprice|0.5], 4) AS p50, round(PCT[o_totalprice|0.95], 4) AS p95 FROM {orders} GROUP BY 1"),
    "d6_robust_location": both("""
        WITH m AS (SELECT user_id, PCT[value|0.5] AS med FROM {events} GROUP BY 1)
        SELECT e.user_id, round(any_value(med), 6) AS median_value, round(PCT[abs(value - med)|0.5], 6) AS mad, round(avg(CASE WHEN abs(value - med) <= 7.5 THEN 1e0 ELSE 0e0 END), 6) AS inliers FROM {events} e JOIN m ON m.user_id = e.user_id GROUP BY e.user_id"""),
    # A robust line through all pairs, refitted once on what lies near it.
    "d7_robust_line": (d7_robust_line, both("""
        WITH e AS (SELECT user_id, US[ts] / 1e11 AS x, value AS y FROM {events}),
        s AS (SELECT a.user_id, PCT[(b.y - a.y) / (b.x - a.x)|0.5] AS slope FROM e a JOIN e b ON a.user_id = b.user_id AND a.x < b.x GROUP BY 1),
        i AS (SELECT e.user_id, any_value(slope) AS slope, PCT[y - slope * x|0.5] AS icept FROM e JOIN s ON s.user_id = e.user_id GROUP BY e.user_id),
        k AS (SELECT e.user_id, x, y FROM e JOIN i ON i.user_id = e.user_id WHERE abs(y - icept - slope * x) <= 15),
        s2 AS (SELECT a.user_id, PCT[(b.y - a.y) / (b.x - a.x)|0.5] AS slope FROM k a JOIN k b ON a.user_id = b.user_id AND a.x < b.x GROUP BY 1)
        SELECT i.user_id, round(i.slope, 4) AS slope, round(s2.slope, 4) AS refit FROM i LEFT JOIN s2 ON s2.user_id = i.user_id""")[1]),
    # Least squares, clamped, then once more without what lies far off.
    "d8_least_squares": both("""
        WITH f AS (SELECT l_returnflag AS g, regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM {lineitem} GROUP BY 1),
        k AS (SELECT g, l_quantity AS x, l_extendedprice AS y FROM {lineitem} JOIN f ON g = l_returnflag WHERE abs(l_extendedprice - b - a * l_quantity) <= 20000)
        SELECT k.g AS l_returnflag, count(*) AS n, round(greatest(450.0, least(18000.0, regr_slope(y, x))), 2) AS slope, round(regr_intercept(y, x), 1) AS intercept FROM k GROUP BY k.g"""),
    # Residuals by thirds: the first two of max(1, n // 3) rows, the rest the last.
    "d10_diagnostics": both("""
        WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY US[ts], event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM {events}),
        t AS (SELECT *, least(2, DIV[pos|greatest(1, DIV[n|3])]) AS third FROM p)
        SELECT user_id, count(*) AS n, round(avg(CASE WHEN third = 0 THEN value END), 6) AS early, round(avg(CASE WHEN third = 1 THEN value END), 6) AS middle, round(avg(CASE WHEN third = 2 THEN value END), 6) AS late, round(PCT[value|0.95], 6) AS p95 FROM t GROUP BY 1"""),
    "d15_count_maps": both("SELECT o_orderstatus, AGG[o_orderpriority || '=' || CAST(n AS STRING)|,|o_orderpriority] AS counts FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY 1, 2) t GROUP BY 1"),
    # Jobs by key: distinct reasons in order, and a priority that only rises.
    "d16_job_accumulator": both("""
        WITH r AS (SELECT DISTINCT l_orderkey, CASE WHEN l_discount > 0.08 THEN 'discount' WHEN l_tax > 0.06 THEN 'tax' ELSE 'plain' END AS reason, CASE WHEN l_discount > 0.08 THEN 0 WHEN l_tax > 0.06 THEN 1 ELSE 2 END AS prio FROM {lineitem})
        SELECT l_orderkey, AGG[reason|;|reason] AS reasons, min(prio) AS prio FROM r GROUP BY 1"""),
    # Texts by their hashes, so that no text is shuffled; how often each occurs is counted before languages meet.
    "d17_unique_texts": both("""
        WITH t AS (SELECT lang, SHA[text] AS h, count(*) AS n FROM {documents} GROUP BY 1, 2), w AS (SELECT h, sum(n) AS times FROM t GROUP BY 1)
        SELECT lang, BIG[sum(n)] AS n, count(DISTINCT t.h) AS n_distinct, BIG[sum(CASE WHEN times = 1 THEN n ELSE 0 END)] AS n_unique FROM t LEFT JOIN w ON w.h = t.h GROUP BY 1"""),
    "d18_split_isolation": both("SELECT source, count(DISTINCT doc_id % 3) AS n_splits, count(DISTINCT doc_id % 3) > 1 AS leaks FROM {documents} GROUP BY 1"),
    "d19_readiness": both("SELECT doc_id % 3 AS split, bool_and(n_chars > 5) AS all_long, bool_or(lang = 'de') AS has_de, count_if(lang = 'en') AS n_en, count(DISTINCT lang) AS n_langs FROM {documents} GROUP BY 1"),
    "d20_segment_quality": both("SELECT user_id, round(avg(value), 6) AS mean_value, max(value) AS worst, bool_and(props IS NOT NULL) AS complete FROM {events} GROUP BY 1"),
    "d21_hull": both("SELECT user_id, min(US[ts]) AS first_us, max(US[ts] + BIG[floor(value)] * 1000000) AS last_us FROM {events} WHERE value >= 1 GROUP BY 1"),
    "d22_weighted_average": both("SELECT lang, round(sum(q * n_chars) / sum(n_chars), 6) AS weighted FROM (SELECT d.lang, d.n_chars, CAST(l.quality AS DOUBLE) AS q FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id) t GROUP BY 1"),
    # Any pair that differs too much is a conflict, whatever the majority.
    "d23_support_levels": both("""
        WITH f AS (SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS a, max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS b, max(CASE WHEN l_linenumber = 3 THEN l_quantity END) AS c FROM {lineitem} GROUP BY 1),
        g AS (SELECT *, greatest(coalesce(abs(a - b), -1), coalesce(abs(a - c), -1), coalesce(abs(b - c), -1)) AS gap, CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT) + CAST(c IS NOT NULL AS INT) AS n FROM f)
        SELECT l_orderkey, CASE WHEN gap > 20 THEN 'CONFLICT' WHEN n >= 3 THEN 'HIGH' WHEN n = 2 THEN 'MEDIUM' ELSE 'LOW' END AS level, CASE WHEN gap >= 0 THEN gap END AS widest FROM g"""),
    "d24_pivot_counts": both("SELECT o_orderpriority, count_if(o_orderstatus = 'F') AS n_f, count_if(o_orderstatus = 'O') AS n_o, count_if(o_orderstatus = 'P') AS n_p FROM {orders} GROUP BY 1"),
    "d26_batch_summary": both("SELECT event_type, count(*) AS n, count_if(TRY_CAST(substr(props, 7, 2) AS INT) IS NULL) AS n_failed, count_if(value > 50) AS n_high FROM {events} GROUP BY 1"),
    "d27_multiset_intersection": both("""
        WITH a AS (SELECT SHA[text] AS h, count(*) AS n FROM {documents} WHERE source < 'src15' GROUP BY 1), b AS (SELECT SHA[text] AS h, count(*) AS n FROM {documents} WHERE source >= 'src15' GROUP BY 1)
        SELECT BIG[coalesce(sum(least(a.n, b.n)), 0)] AS n_common FROM a JOIN b ON a.h = b.h"""),
    # The upper median of slopes, each as often as its weight says.
    "d28_weighted_median": both("""
        WITH w AS (SELECT o_custkey, l_quantity AS x, l_linenumber AS w, l_orderkey FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey),
        c AS (SELECT o_custkey, x, sum(w) OVER (PARTITION BY o_custkey ORDER BY x, l_orderkey, w ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY o_custkey) AS total FROM w)
        SELECT o_custkey, min(x) AS weighted_median FROM c WHERE upto > DIV[total|2] GROUP BY 1""".replace("sum(w)", "BIG[sum(w)]").replace("BIG[sum(w)] OVER (PARTITION BY o_custkey ORDER BY x, l_orderkey, w ROWS UNBOUNDED PRECEDING)", "BIG[sum(w) OVER (PARTITION BY o_custkey ORDER BY x, l_orderkey, w ROWS UNBOUNDED PRECEDING)]").replace("BIG[sum(w)] OVER (PARTITION BY o_custkey)", "BIG[sum(w) OVER (PARTITION BY o_custkey)]")),
    # Slopes to try for each brand: a grid, and what its sizes suggest.
    "j2_slope_grid": both("""
        WITH g AS (SELECT p_brand, round(1 + (p_size - 25) / 1e2, 4) AS prior FROM {part})
        SELECT p_brand, round(8e-1 + 2e-2 * i, 4) AS slope FROM (SELECT DISTINCT p_brand FROM g) b CROSS JOIN SEQ[0|30] t UNION SELECT p_brand, prior FROM g"""),
    # Robust timing model of each group: pairwise median slope, median offset, residuals, status ladder.
    "i5_timing_model": both("""
        WITH e AS (SELECT user_id, US[ts] / 1e11 AS x, value AS y FROM {events} WHERE event_type = 'purchase'),
        s AS (SELECT a.user_id, PCT[(b.y - a.y) / (b.x - a.x)|0.5] AS slope FROM e a JOIN e b ON a.user_id = b.user_id AND b.x - a.x >= 0.3 GROUP BY 1),
        o AS (SELECT e.user_id, any_value(slope) AS slope, PCT[y - slope * x|0.5] AS icept, count(*) AS n FROM e JOIN s ON s.user_id = e.user_id GROUP BY e.user_id),
        r AS (SELECT o.user_id, any_value(n) AS n, PCT[abs(y - icept - slope * x)|0.5] AS res FROM e JOIN o ON o.user_id = e.user_id GROUP BY o.user_id)
        SELECT user_id, n, round(res, 4) AS residual, CASE WHEN n < 4 THEN 'too_few' WHEN res <= 10 THEN 'ready' WHEN res <= 20 THEN 'degraded' ELSE 'rejected' END AS status FROM r"""),
    # The same model over all users and all their events; users without a pair far enough apart have too few.
    "i5_timing_model_all": both("""
        WITH e AS (SELECT user_id, US[ts] / 1e11 AS x, value AS y FROM {events}),
        s AS (SELECT a.user_id, PCT[(b.y - a.y) / (b.x - a.x)|0.5] AS slope FROM e a JOIN e b ON a.user_id = b.user_id AND b.x - a.x >= 0.3 GROUP BY 1),
        o AS (SELECT e.user_id, any_value(slope) AS slope, PCT[y - slope * x|0.5] AS icept, count(*) AS n FROM e LEFT JOIN s ON s.user_id = e.user_id GROUP BY e.user_id),
        r AS (SELECT o.user_id, any_value(n) AS n, PCT[abs(y - icept - slope * x)|0.5] AS res FROM e JOIN o ON o.user_id = e.user_id GROUP BY o.user_id)
        SELECT user_id, n, round(res, 4) AS residual, CASE WHEN n < 4 OR res IS NULL THEN 'too_few' WHEN res <= 10 THEN 'ready' WHEN res <= 20 THEN 'degraded' ELSE 'rejected' END AS status FROM r"""),
    "i4_anchor_grades": both("""
        WITH d AS (SELECT doc_id, coalesce(SHA[text], '') AS h, n_chars FROM {documents}), c AS (SELECT h, count(*) AS times FROM d GROUP BY 1), g AS (SELECT doc_id, times, n_chars FROM d JOIN c ON c.h = d.h)
        SELECT doc_id, CASE WHEN times = 1 AND n_chars >= 200 THEN 'A' WHEN times <= 2 THEN 'B' ELSE 'C' END AS grade FROM g"""),
    "l4_reasons": both("SELECT l_orderkey, l_linenumber, concat_ws(';', CASE WHEN l_discount > 0.08 THEN 'high_discount' END, CASE WHEN l_quantity < 5 THEN 'small' END, CASE WHEN l_tax = 0 THEN 'untaxed' END) AS reasons FROM {lineitem} WHERE l_discount > 0.08 OR l_quantity < 5 OR l_tax = 0"),
    "l5_decision_fusion": both("""
        WITH t AS (SELECT l_orderkey, CASE WHEN max(l_tax) > 0.07 THEN 'shift' WHEN max(l_tax) > 0.04 THEN 'confirm' ELSE 'none' END AS timing FROM {lineitem} GROUP BY 1), x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'match' WHEN 'P' THEN 'mismatch' ELSE 'unknown' END AS txt FROM {orders})
        SELECT o_orderkey, coalesce(timing, 'none') AS timing, txt, CASE WHEN txt = 'mismatch' AND timing = 'shift' THEN 'critical' WHEN txt = 'mismatch' OR timing = 'shift' THEN 'high' WHEN timing = 'confirm' THEN 'low' ELSE 'normal' END AS priority FROM x LEFT JOIN t ON l_orderkey = o_orderkey"""),
    # Gates: every metric against its policy, with a slack of 1e-12, and all of them together.
    "l7_gates": both("""
        WITH m AS (SELECT 'mean_discount' AS metric, avg(l_discount) AS got FROM {lineitem} UNION ALL SELECT 'mean_tax', avg(l_tax) FROM {lineitem} UNION ALL SELECT 'max_quantity', max(l_quantity) FROM {lineitem}),
        p AS (SELECT 'mean_discount' AS metric, 'ceiling' AS kind, 0.06 AS bound UNION ALL SELECT 'mean_tax', 'floor', 0.05 UNION ALL SELECT 'max_quantity', 'ceiling', 50.0),
        g AS (SELECT m.metric, kind, CASE WHEN kind = 'ceiling' THEN got <= bound + 1e-12 ELSE got >= bound - 1e-12 END AS passed FROM m JOIN p ON p.metric = m.metric)
        SELECT metric, kind, passed, bool_and(passed) OVER () AS all_passed FROM g"""),
    "l10_positional_comparison": both("""
        WITH a AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, n_chars > 500 AS long FROM {documents} WHERE lang IN ('en', 'de')), b AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, n_chars > 500 AS long FROM {documents} WHERE lang NOT IN ('en', 'de'))
        SELECT coalesce(a.source, b.source) AS source, coalesce(a.pos, b.pos) AS pos, CASE WHEN b.pos IS NULL THEN 'missing' WHEN a.pos IS NULL THEN 'extra' ELSE 'different' END AS kind FROM a FULL JOIN b ON a.source = b.source AND a.pos = b.pos WHERE a.pos IS NULL OR b.pos IS NULL OR a.long <> b.long"""),
    "l15_structure_checks": both("""
        WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS want FROM {conversations})
        SELECT conv_id, count_if(turn <> want) AS n_misnumbered, count_if(trim(text) = '') AS n_blank, count_if(contains(text, '�')) AS n_broken, count_if(length(text) < 10) AS n_short FROM c GROUP BY 1"""),
    "l16_trust_ladder": both("""
        WITH b AS (SELECT l_orderkey, count(*) AS n, max(l_returnflag) AS flag FROM {lineitem} GROUP BY 1)
        SELECT o_orderkey, CASE WHEN coalesce(n, 0) <> 1 THEN 'unknown' WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'unknown' WHEN flag = 'R' THEN 'untrusted' ELSE 'trusted' END AS trust FROM {orders} LEFT JOIN b ON l_orderkey = o_orderkey"""),
    "l2_window_sizing": both("SELECT event_id, greatest(0.0, round(value - greatest(0.0, 12.0 - value) / 2, 6)) AS w_start, round(value + greatest(12.0, value) / 2, 6) AS w_end FROM {events}"),
    "l1_bounded_plan": both("""
        WITH r AS (SELECT l_orderkey AS k, 'discount' AS reason, 1 AS prio FROM {lineitem} WHERE l_discount >= 0.09 UNION ALL SELECT o_orderkey, 'status', 0 FROM {orders} WHERE o_orderstatus = 'P'),
        j AS (SELECT k, min(prio) AS prio, count(DISTINCT reason) AS n FROM r GROUP BY 1)
        SELECT substr(SHA[concat_ws('/', CAST(k AS STRING), CAST(prio AS STRING))], 1, 12) AS job_id, k, prio, n FROM j ORDER BY prio, k LIMIT 300"""),
    "l3_selective_plan": both("""
        WITH c AS (SELECT o_orderkey, o_custkey, o_totalprice, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rival FROM {orders})
        SELECT o_orderkey, round(o_totalprice - rival, 2) AS lead_over FROM c WHERE rival IS NOT NULL AND o_totalprice - rival < 2000"""),
    "l9_decision_replay": both("""
        WITH i AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'content' ELSE 'quality' END AS kind FROM {labels} WHERE toxic = 1 OR quality = 0), d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'accept' WHEN doc_id % 4 = 1 THEN 'reject' ELSE 'mask' END AS action FROM {labels} WHERE quality = 0)
        SELECT i.doc_id, kind, action, CASE WHEN action IS NULL THEN 'active' WHEN action = 'mask' AND kind <> 'content' THEN 'invalid' ELSE 'resolved' END AS state FROM i LEFT JOIN d ON d.doc_id = i.doc_id"""),
    "l11_regression_cases": both("""
        WITH t AS (SELECT user_id, min(value) AS want FROM {events} WHERE event_type = 'view' GROUP BY 1)
        SELECT t.user_id, EXISTS (SELECT 1 FROM {events} e WHERE e.user_id = t.user_id AND e.event_type = 'click' AND abs(e.value - t.want) <= 0.5) AS passed FROM t"""),
    "l12_release_gate": both("""
        WITH k AS (SELECT 'negative_price' AS name, count(*) AS n FROM {lineitem} WHERE l_extendedprice < 0 UNION ALL SELECT 'orphans', count(*) FROM {orders} WHERE o_custkey NOT IN (SELECT c_custkey FROM {customer}) UNION ALL SELECT 'toxic', count(*) FROM {labels} WHERE toxic = 1)
        SELECT name, n, n = 0 AS passed, bool_and(n = 0) OVER () AS released FROM k"""),
    "l13_manual_override": both("SELECT d.doc_id, coalesce(CASE WHEN l.quality = 0 THEN 'reviewed' END, d.source) AS source FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id"),
    # A case for each document of a source, every fifth of them blind.
    "l14_scaffold": both("""
        WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM {documents})
        SELECT source, doc_id, n AS case_no, 'case-' || lpad(CAST(n AS STRING), 6, '0') AS case_id, CASE WHEN n % 5 = 0 THEN 'blind' ELSE 'development' END AS split FROM n"""),
    "l17_next_action": both("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'wait' WHEN n IS NULL THEN 'collect' WHEN n > 5 THEN 'split' ELSE 'run' END AS action FROM {orders} LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY 1) t ON l_orderkey = o_orderkey"),
    # Artifact ids from content and the sorted ids upstream; missing upstream artifacts.
    "m1_manifest": both("""
        WITH c AS (SELECT c_custkey, SHA[concat_ws('/', CAST(c_custkey AS STRING), c_name)] AS up FROM {customer})
        SELECT o_custkey, substr(SHA[AGG[CAST(o_orderkey AS STRING)|,|o_orderkey]], 1, 16) AS artifact_id, substr(max(up), 1, 16) AS upstream_id, max(up) IS NULL AS missing FROM {orders} LEFT JOIN c ON c_custkey = o_custkey GROUP BY 1"""),
    # Sums of hashes of (id, text): they don't depend on order, and no source's rows meet.
    "m2_fingerprint": both(
        "SELECT source, count(*) AS n, CAST(sum(CAST(conv(substr(SHA[concat_ws('/', CAST(doc_id AS STRING), SHA[text])], 1, 14), 16, 10) AS DECIMAL(20, 0))) AS STRING) AS fingerprint FROM {documents} GROUP BY 1",
        "SELECT source, count(*) AS n, CAST(sum(CAST('0x' || substr(SHA[concat_ws('/', CAST(doc_id AS STRING), SHA[text])], 1, 14) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM {documents} GROUP BY 1",
    ),
    # All that an artifact depends on, at any distance.
    "m6_lineage_walk": (m6_lineage_walk, both("""
        WITH RECURSIVE edge AS (SELECT 'n' || CAST(n_nationkey AS STRING) AS child, 'r' || CAST(n_regionkey AS STRING) AS parent FROM {nation} UNION ALL SELECT 's' || CAST(s_suppkey AS STRING), 'n' || CAST(s_nationkey AS STRING) FROM {supplier}),
        walk AS (SELECT child, parent, 1 AS depth FROM edge UNION ALL SELECT w.child, e.parent, w.depth + 1 FROM walk w JOIN edge e ON e.child = w.parent)
        SELECT child, parent, depth FROM walk""")[1]),
    "m7_readiness_report": both("SELECT 'documents' AS what, count(*) AS n, count(DISTINCT doc_id) AS n_keys FROM {documents} UNION ALL SELECT 'labels', count(*), count(DISTINCT doc_id) FROM {labels} UNION ALL SELECT 'pages', count(*), count(DISTINCT page_id) FROM {pages}"),
}
