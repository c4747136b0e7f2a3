"""Routing, windows, fused decisions and languages over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.functions import languages
from tidewright.operators import routing
from tidewright.sources.code import ship
from tidewright.sources.tables import events_us, table


def l2_windows(spark, d):
    """A window for each event, half a second of context and at least four seconds."""
    e = events_us(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("t_us", "event_id")) - 1)
    start = (F.col("k") * 900).cast("long")
    return e.select("event_id", routing.window(start, start + F.floor(F.col("value") * 60), 500, 4000).alias("w")).select("event_id", "w.*")


L2 = """
WITH e AS (SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 900 AS a, CAST(floor(value * 60) AS BIGINT) AS n FROM events),
w AS (SELECT event_id, greatest(0, a - 500) AS l, a + n + 500 AS r FROM e), s AS (SELECT *, greatest(0, 4000 - (r - l)) AS short FROM w),
g AS (SELECT *, greatest(0, l - short // 2) AS nl, r + short - short // 2 AS nr FROM s)
SELECT event_id, nl AS "left", CASE WHEN nl = 0 AND short > 0 THEN greatest(nr, 4000) ELSE nr END AS "right" FROM g
"""


def l4_route_reasons(spark, d):
    """Orders as jobs, customers' figures as their first pass, lines as segments, whose means are summed in the order of the table's rows."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    jobs = o.select(F.col("o_orderkey").alias("job"))
    n = F.col("o_orderkey")
    evidence = o.where("o_orderkey % 8 <> 0").select(n.alias("job"), F.when(n % 9 != 0, n % 101 / 100.0).alias("support"), F.when(n % 7 != 0, n % 53 / 52.0).alias("language_probability"))
    segments = li.where("l_quantity > 5").select(F.col("l_orderkey").alias("job"), F.when(F.col("l_tax") > 0, -F.col("l_discount") * 12).alias("logprob"), (F.col("l_quantity") / 64).alias("no_speech"), "file", "row")
    return routing.route_reasons(jobs, evidence, routing.segment_quality(segments, ["job"], ["file", "row"]), "job").select("job", F.array_join("reasons", ";").alias("reasons"))


L4 = """
WITH e AS (SELECT o_orderkey AS job, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey % 101 AS DOUBLE) / 100 END AS s, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 53 AS DOUBLE) / 52 END AS p FROM orders WHERE o_orderkey % 8 <> 0),
q AS (SELECT l_orderkey AS job, count(*) AS n, avg(CASE WHEN l_tax > 0 THEN -l_discount * 12 END) AS lp, max(l_quantity / 64) AS ns, bool_and(l_tax > 0) AS whole FROM lineitem WHERE l_quantity > 5 GROUP BY 1),
j AS (SELECT o_orderkey AS job, e.job IS NOT NULL AS seen, s, p, coalesce(n, 0) AS n, lp, ns, whole FROM orders LEFT JOIN e ON e.job = o_orderkey LEFT JOIN q ON q.job = o_orderkey)
SELECT job, CASE WHEN NOT seen THEN 'missing_first_pass_evidence' ELSE concat_ws(';', CASE WHEN n > 0 AND ns > 0.6 THEN 'high_no_speech_probability' END, CASE WHEN n > 0 AND lp < -0.75 THEN 'low_avg_logprob' END,
    CASE WHEN s < 0.65 THEN 'low_canonical_text_support' END, CASE WHEN p < 0.65 THEN 'low_language_probability' END, CASE WHEN s IS NULL THEN 'missing_canonical_text_support' END,
    CASE WHEN n > 0 AND NOT whole THEN 'missing_segment_quality' END, CASE WHEN n = 0 THEN 'missing_segments' END) END AS reasons FROM j
"""


def l5_fused_decisions(spark, d):
    """Orders as jobs on their customers' cues; shifts, gates and supports from keys and lines."""
    o, c, li = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "lineitem")
    n, k = F.col("o_orderkey"), F.col("c_custkey")
    jobs = o.select(n.alias("job"), F.col("o_custkey").alias("cue"), (F.col("o_custkey") % 5).alias("line"), F.when(n % 3 == 0, F.array(F.lit("acoustic"))).otherwise(F.array(F.lit("acoustic"), F.lit("speech"))).alias("wants"))
    action = lambda m: F.when(k % m == 0, "preserve").otherwise("review")
    timing = c.where("c_custkey % 13 <> 0").select(k.alias("cue"), action(4).alias("action"), F.when(k % 6 != 0, k * 97 % 3001 - 1500).alias("shift_ms"))
    crossed = F.when(k % 17 == 0, "preceding_canonical_anchor_confirms_cross_script_vocalization").otherwise("low")
    texts = c.where("c_custkey % 19 <> 0").select(k.alias("cue"), action(3).alias("action"), crossed.alias("reason"), F.when(k % 7 != 0, k % 5).alias("line"))
    acoustic = o.where("o_orderkey % 5 <> 0").select(n.alias("job"), F.when(n % 11 != 0, n * 89 % 3001 - 1500).alias("shift_ms"), (n % 4 != 1).alias("gate"))
    speech = li.groupBy(F.col("l_orderkey").alias("job")).agg((F.min("l_quantity") / 30).alias("support"))
    out = routing.fused(jobs, timing, texts, acoustic, speech)
    return out.withColumn("missing", F.array_join("missing", ";"))


L5 = """
WITH t AS (SELECT c_custkey AS cue, c_custkey % 4 <> 0 AS review, CASE WHEN c_custkey % 6 <> 0 THEN c_custkey * 97 % 3001 - 1500 END AS ours FROM customer WHERE c_custkey % 13 <> 0),
x AS (SELECT c_custkey AS cue, c_custkey % 3 <> 0 AS review, c_custkey % 17 = 0 AS crossed, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 5 END AS line FROM customer WHERE c_custkey % 19 <> 0),
a AS (SELECT o_orderkey AS job, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey * 89 % 3001 - 1500 END AS heard, o_orderkey % 4 <> 1 AS gate FROM orders WHERE o_orderkey % 5 <> 0),
s AS (SELECT l_orderkey AS job, min(l_quantity) / 30 AS support FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey AS job, o_custkey AS cue, o_orderkey % 3 <> 0 AS wants_speech, coalesce(t.review, false) AS tr, ours, coalesce(x.review, false) AS xr, coalesce(crossed, false) AS crossed, coalesce(x.line = o_custkey % 5, false) AS planned,
             a.job IS NOT NULL AS has_a, s.job IS NOT NULL AS has_s, heard, coalesce(gate, false) AS gate, coalesce(gate, false) AND heard IS NOT NULL AS speaks, support
      FROM orders LEFT JOIN t ON t.cue = o_custkey LEFT JOIN x ON x.cue = o_custkey LEFT JOIN a ON a.job = o_orderkey LEFT JOIN s ON s.job = o_orderkey),
p AS (SELECT *, CASE WHEN NOT tr THEN 'not_requested'
        WHEN ours IS NULL THEN CASE WHEN NOT speaks THEN 'unvalidated_no_actionable_evidence' WHEN abs(heard) >= 1000 THEN 'pro_detected_anomaly' WHEN abs(heard) <= 150 THEN 'editor_supported_by_acoustic' ELSE 'unvalidated_acoustic_observation' END
        WHEN NOT speaks THEN 'smart_candidate_unverified'
        WHEN abs(ours) < 900 THEN CASE WHEN abs(heard) >= 1000 THEN 'smart_pro_conflict' ELSE 'editor_within_display_tolerance' END
        WHEN (ours > 0) = (heard > 0) AND abs(ours - heard) <= 750 THEN 'smart_candidate_supported' WHEN abs(heard) < 900 THEN 'smart_candidate_rebutted' ELSE 'smart_pro_conflict' END AS timing_state FROM j),
q AS (SELECT *, CASE WHEN crossed THEN 'cross_script_vocalization_resolved_by_smart' WHEN NOT xr THEN 'resolved_by_smart' WHEN support >= 0.72 THEN 'canonical_text_supported'
        WHEN planned AND gate AND timing_state = 'smart_candidate_supported' THEN 'canonical_occurrence_supported_by_acoustic' WHEN support IS NOT NULL THEN 'text_review_asr_insufficient' ELSE 'text_review_unvalidated' END AS text_state FROM p),
r AS (SELECT *, CASE WHEN timing_state = 'smart_candidate_supported' AND text_state IN ('canonical_occurrence_supported_by_acoustic', 'cross_script_vocalization_resolved_by_smart') THEN 3
        WHEN timing_state IN ('pro_detected_anomaly', 'smart_candidate_supported', 'smart_pro_conflict') OR text_state IN ('canonical_text_supported', 'canonical_occurrence_supported_by_acoustic') THEN 2
        WHEN timing_state = 'smart_candidate_rebutted' THEN 1 ELSE 0 END AS rank FROM q)
SELECT job, cue, timing_state, text_state, CAST(rank AS INTEGER) AS rank, ['none', 'diagnostic', 'medium', 'high'][rank + 1] AS priority,
       concat_ws(';', CASE WHEN NOT has_a THEN 'acoustic' END, CASE WHEN wants_speech AND NOT has_s THEN 'speech' END) AS missing FROM r
"""


def b1_credits(spark, d):
    """Texts of documents' first twelve characters with and without heads of credits and labels, by what they are."""
    heads = ["", "作词：", "by: ", "Rap：", "混音 :", "OP: ", "词 "]
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % 7 + 1).cast("int"))
    text = F.concat(head, F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 12), "[^A-Za-z ]", ""), F.when(F.col("doc_id") % 3 == 0, "：").otherwise(""))
    docs = table(spark, d, "documents").select("doc_id", text.alias("line"))
    return docs.select("doc_id", languages.is_metadata(F.col("line")).alias("is_metadata"), languages.title_like(F.col("doc_id"), F.concat("line", F.lit(" - x"))).alias("title_like"))


B1 = """
WITH t AS (SELECT doc_id, trim(regexp_replace(['', '作词：', 'by: ', 'Rap：', '混音 :', 'OP: ', '词 '][doc_id % 7 + 1] || regexp_replace(substring(coalesce(text, ''), 1, 12), '[^A-Za-z ]', '', 'g') || CASE WHEN doc_id % 3 = 0 THEN '：' ELSE '' END, '\\s+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, regexp_matches(s, '(?i)^(?:\\[?by\\s*[:：]|(?:作词|混音|OP|词)\\s*[:：])')
       OR regexp_matches(s, '(?i)^(?:Rap|[A-Za-z0-9][A-Za-z0-9 ._&+/()-]{0,60})\\s*[:：]$') AS is_metadata, doc_id <= 1000 AS title_like FROM t
"""


def h13_language_units(spark, d):
    """How many units each document has in its language, and its first ones; every other one with Han, kana and Hangul before it."""
    docs = table(ship(spark), d, "documents")
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, "한국 노래 日本のうた don’t ").otherwise(""), F.coalesce("text", F.lit("")))
    language = F.element_at(F.array(*map(F.lit, ("en", "zh", "ko", "auto"))), (F.col("doc_id") % 4 + 1).cast("int"))
    u = docs.select("doc_id", languages.language_units(language, text).alias("u"))
    return u.select("doc_id", F.size("u").alias("n"), F.array_join(F.slice("u", 1, 12), "|").alias("first"))


def h16_profiles(spark, d):
    """What holds for the language of each document, written in many ways."""
    name = F.element_at(F.array(*map(F.lit, ("en", " CN", "cantonese", "KR ", "jp", "multi", "und", "fr", "auto"))), (F.col("doc_id") % 9 + 1).cast("int"))
    return languages.with_profile(table(spark, d, "documents").select("doc_id", name.alias("name")), "name")


H16 = """
WITH p(name, code, auto_score, review_score, least_coverage) AS (VALUES ('en', 'en', 0.88::DOUBLE, 0.64::DOUBLE, 0.68::DOUBLE), (' CN', 'zh', 0.90, 0.66, 0.72), ('cantonese', 'yue', 0.92, 0.70, 0.74), ('KR ', 'ko', 0.86, 0.60, 0.64),
    ('jp', 'ja', 0.92, 0.68, 0.74), ('multi', 'mixed', 0.94, 0.72, 0.78), ('und', 'generic', 0.95, 0.74, 0.80), ('auto', 'auto', 0.95, 0.74, 0.80)),
n AS (SELECT doc_id, ['en', ' CN', 'cantonese', 'KR ', 'jp', 'multi', 'und', 'fr', 'auto'][doc_id % 9 + 1] AS name FROM documents)
SELECT doc_id, n.name, code, auto_score, review_score, least_coverage FROM n LEFT JOIN p ON p.name = n.name
"""

QUERIES = {
    "l2_windows": (l2_windows, L2), "l4_route_reasons": (l4_route_reasons, L4), "l5_fused_decisions": (l5_fused_decisions, L5),
    "b1_credits": (b1_credits, B1), "h13_language_units": (h13_language_units, None), "h16_profiles": (h16_profiles, H16),
}
