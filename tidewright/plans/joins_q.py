"""Joins, set operations, sorts and limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.dialect import both
from tidewright.operators.ranking import numbered


def placed(text: str, order: str, columns: str, out: str) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """`columns` of a query's rows with their place over the whole table: range-sorted in Spark, a window in the SQL."""
    rows, sql = both(text)
    keys = lambda: [F.desc(x.removesuffix(" DESC")) if x.endswith(" DESC") else F.col(x) for x in order.split(", ")]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return numbered(rows(spark, sf_dir), keys(), out).select(*columns.split(", "), out)

    return run, f"SELECT {columns}, row_number() OVER (ORDER BY {order}) AS {out} FROM ({sql}) t"


QUERIES = {
    # Evidence families onto the key of the canonical line: three left joins.
    "c1_evidence_join": both("""
        WITH a AS (SELECT l_orderkey, l_quantity AS x FROM {lineitem} WHERE l_linenumber = 1), b AS (SELECT l_orderkey, l_quantity AS x FROM {lineitem} WHERE l_linenumber = 2), c AS (SELECT l_orderkey, l_quantity AS x FROM {lineitem} WHERE l_linenumber = 3),
        a1 AS (SELECT l_orderkey, max(x) AS x FROM a GROUP BY 1), b1 AS (SELECT l_orderkey, max(x) AS x FROM b GROUP BY 1), c1 AS (SELECT l_orderkey, max(x) AS x FROM c GROUP BY 1)
        SELECT o_orderkey, a1.x AS first_x, b1.x AS second_x, c1.x AS third_x, CAST(a1.x IS NOT NULL AS INT) + CAST(b1.x IS NOT NULL AS INT) + CAST(c1.x IS NOT NULL AS INT) AS n_families
        FROM {orders} LEFT JOIN a1 ON a1.l_orderkey = o_orderkey LEFT JOIN b1 ON b1.l_orderkey = o_orderkey LEFT JOIN c1 ON c1.l_orderkey = o_orderkey"""),
    # Keys that occur twice in a family are errors.
    "c1_duplicate_keys": both("SELECT l_orderkey, l_linenumber, count(*) AS n FROM {lineitem} GROUP BY 1, 2 HAVING count(*) > 1"),
    # Truth joined to results, with a check of the text's identity.
    "c2_identity_join": both("""
        SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN SHA[d.text] <> SHA[trim(d.text)] THEN 'mismatch' ELSE 'ok' END AS identity, substr(SHA[d.text], 1, 16) AS text_id
        FROM {labels} l LEFT JOIN {documents} d ON d.doc_id = l.doc_id"""),
    # Missing evidence is a reason of its own.
    "c3_missing_evidence": both("""
        WITH e AS (SELECT l_orderkey, max(l_discount) AS worst FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY 1)
        SELECT o_orderkey, CASE WHEN e.l_orderkey IS NULL THEN 'missing_evidence' WHEN worst > 0.08 THEN 'weak' ELSE 'fine' END AS reason FROM {orders} LEFT JOIN e ON e.l_orderkey = o_orderkey"""),
    "c4_referential_check": both("SELECT DISTINCT e.user_id FROM {events} e LEFT ANTI JOIN {customer} c ON c.c_custkey = e.user_id", "SELECT DISTINCT user_id FROM events WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id)"),
    "c5_never_matched": both("SELECT c.c_custkey, c.c_name FROM {customer} c LEFT ANTI JOIN {orders} o ON o.o_custkey = c.c_custkey", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "c6_selected": both("SELECT l.l_orderkey, l.l_linenumber, l.l_quantity FROM {lineitem} l LEFT SEMI JOIN (SELECT o_orderkey FROM {orders} WHERE o_orderpriority = '1-URGENT') o ON o.o_orderkey = l.l_orderkey", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    # Events within a distance of each other, whatever the file's order.
    # Interval and gap: strict overlap, and the part of the gap.
    "c13_gap_intersection": both("""
        WITH o AS (SELECT event_id, user_id, value AS a, value + 8 AS b FROM {events} WHERE event_type = 'view'), g AS (SELECT 1.2e1 AS a, 1.45e1 AS b UNION ALL SELECT 3e1, 3.3e1)
        SELECT o.event_id, g.a AS gap_start, round(greatest(o.a, g.a), 6) AS cut_start, round(least(o.b, g.b), 6) AS cut_end FROM o JOIN g ON greatest(o.a, g.a) < least(o.b, g.b)"""),
    # Slopes of all ordered pairs of a group, their median.
    "c24_pairwise_slopes": both("""
        WITH e AS (SELECT user_id, event_id, US[ts] / 1e9 AS x, value AS y FROM {events}),
        p AS (SELECT a.user_id, (b.y - a.y) / (b.x - a.x) AS slope FROM e a JOIN e b ON a.user_id = b.user_id AND b.x - a.x >= 3)
        SELECT user_id, count(*) AS n_pairs, round(PCT[slope|0.5], 6) AS median_slope FROM p GROUP BY 1"""),
    "c25_lookup_chain": both("SELECT s_suppkey, s_name, n_name, r_name FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey JOIN {region} ON r_regionkey = n_regionkey"),
    # Lines bound to a cue: none, one or many.
    "c27_binding": both("""
        WITH b AS (SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS only_line FROM {lineitem} WHERE l_quantity > 40 GROUP BY 1)
        SELECT o_orderkey, CASE WHEN n IS NULL THEN 'unavailable' WHEN n = 1 THEN 'candidate' ELSE 'ambiguous' END AS binding, CASE WHEN n = 1 THEN only_line END AS line FROM {orders} LEFT JOIN b ON l_orderkey = o_orderkey"""),
    # A human's decision goes before the calibrated one.
    "c29_trust_merge": both("""
        WITH h AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'trusted' ELSE 'untrusted' END AS s FROM {labels} WHERE toxic = 0), c AS (SELECT doc_id, CASE WHEN n_chars > 500 THEN 'trusted' ELSE 'unknown' END AS s FROM {documents} WHERE n_chars > 20)
        SELECT coalesce(h.doc_id, c.doc_id) AS doc_id, coalesce(h.s, c.s) AS status, CASE WHEN h.s IS NOT NULL THEN 'human' ELSE 'calibrated' END AS origin FROM h FULL JOIN c ON h.doc_id = c.doc_id"""),
    # Unordered pairs named on one side only.
    "c30_pair_consistency": both("""
        WITH p AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM {lineitem} WHERE l_returnflag = 'A'), q AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM {lineitem} WHERE l_returnflag = 'R')
        SELECT coalesce(p.a, q.a) AS a, coalesce(p.b, q.b) AS b, CASE WHEN q.a IS NULL THEN 'left_only' WHEN p.a IS NULL THEN 'right_only' ELSE 'both' END AS side FROM p FULL JOIN q ON p.a = q.a AND p.b = q.b"""),
    # Overrides by key, table after table, in a fixed order.
    "c36_override_chain": both("""
        WITH a AS (SELECT doc_id, 'en' AS lang FROM {labels} WHERE quality = 0), b AS (SELECT doc_id, 'checked' AS source FROM {labels} WHERE toxic = 1)
        SELECT d.doc_id, coalesce(a.lang, d.lang) AS lang, coalesce(b.source, d.source) AS source FROM {documents} d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id"""),
    # Plan with a budget: full sort, limit, and whether it was cut.
    "f1_budgeted_plan": both("SELECT o_orderkey, o_orderpriority, o_totalprice, (SELECT count(*) FROM {orders}) > 200 AS truncated FROM {orders} ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 200"),
    "f2_routing_order": placed("""
        WITH s AS (SELECT l_orderkey, CAST(min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS INT) AS severity, count(*) AS reasons FROM {lineitem} GROUP BY 1)
        SELECT o_orderkey, o_orderpriority, o_orderdate, coalesce(severity, -1) AS severity, coalesce(reasons, 0) AS reasons FROM {orders} LEFT JOIN s ON l_orderkey = o_orderkey""", "o_orderpriority, severity, reasons DESC, o_orderdate, o_orderkey", "o_orderkey", "place"),
    "f3_ranked_jobs": both("""
        SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE WHEN o_totalprice > 200000 THEN 0 ELSE 1 END, o_orderstatus, o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM {orders}"""),
    "f4_top_k": both("SELECT l_orderkey, l_linenumber, place FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_discount DESC, l_linenumber) AS place FROM {lineitem}) t WHERE place <= 3"),
    "f5_best_job": both("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(o_totalprice, -1) DESC, o_orderkey DESC) AS place FROM {orders}) t WHERE place = 1"),
    "f6_candidate_selection": both("SELECT p_partkey, p_retailprice FROM {part} WHERE p_size >= 5 AND p_retailprice < 1500 ORDER BY p_retailprice DESC, p_size DESC, p_partkey LIMIT 1"),
    "f7_argmax_first_wins": both("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS place FROM {lineitem}) t WHERE place = 1"),
    "e6_top_margin": both("""
        WITH r AS (SELECT o_custkey, o_totalprice AS score, row_number() OVER w AS place, lead(o_totalprice) OVER w AS runner FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))
        SELECT o_custkey, round(score, 2) AS top_score, round(score - coalesce(runner, 0), 2) AS margin, score - coalesce(runner, 0) < 1000 AS ambiguous FROM r WHERE place = 1"""),
    "e11_dense_numbering": placed("SELECT event_id, user_id, event_type, US[ts] AS t FROM {events}", "t, user_id, event_type, event_id", "event_id", "number"),
    "g1_union_of_jobs": both("SELECT 'order' AS kind, o_orderkey AS id, o_orderstatus AS status, CAST(NULL AS DOUBLE) AS balance FROM {orders} UNION ALL SELECT 'customer', c_custkey, NULL, c_acctbal FROM {customer}"),
    "g2_intersect": both("SELECT l_partkey FROM {lineitem} WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM {lineitem} WHERE l_returnflag = 'R'"),
    "g3_except": both("SELECT c_custkey FROM {customer} EXCEPT SELECT o_custkey FROM {orders}"),
    "g5_overlay": both("""
        WITH u AS (SELECT l_orderkey, l_linenumber, l_quantity, 1 AS pass FROM {lineitem} UNION ALL SELECT l_orderkey, l_linenumber, l_quantity * 2, 2 FROM {lineitem} WHERE l_discount > 0.05),
        r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY pass DESC, l_quantity DESC) AS place FROM u) SELECT l_orderkey, l_linenumber, l_quantity, pass FROM r WHERE place = 1"""),
    "g6_preserved_intervals": both("SELECT l_shipdate, l_quantity FROM {lineitem} WHERE l_tax < 0.04 INTERSECT SELECT l_shipdate, l_quantity FROM {lineitem} WHERE l_discount < 0.04"),
    "g7_review_queue": placed("SELECT doc_id, 'short' AS family, 2 AS risk FROM {documents} WHERE n_chars < 100 UNION ALL SELECT doc_id, 'toxic', 0 FROM {labels} WHERE toxic = 1 UNION ALL SELECT doc_id, 'poor', 1 FROM {labels} WHERE quality = 0", "risk, doc_id, family", "doc_id, family, risk", "place"),
    "g8_eligible_scopes": both("SELECT lang FROM {documents} WHERE n_chars > 1000 INTERSECT SELECT lang FROM {documents} WHERE lang LIKE 'e%'"),
}
