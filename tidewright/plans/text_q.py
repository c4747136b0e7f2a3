"""Predicates, scalar functions and timeline projection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.functions import text as tx
from tidewright.functions.dialect import both
from tidewright.operators.folds import dealt_by
from tidewright.sources.code import ship
from tidewright.sources.tables import table


def h1_match_key(spark, d):
    docs = table(ship(spark), d, "documents")
    return docs.select("doc_id", F.sha2(tx.match_key("text"), 256).alias("key"))


def h2_alnum_key(spark, d):
    docs = table(ship(spark), d, "documents")
    return docs.select("doc_id", F.sha2(tx.alnum_key("text"), 256).alias("key"))


def _neighbours(spark, d):
    """Each turn and the one before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = dealt_by(table(ship(spark), d, "conversations").withColumnRenamed("text", "line"), ["conv_id"])
    return c.withColumn("before", F.lag("line").over(w)).where("before is not null")


def h4_pair_score(spark, d):
    return _neighbours(spark, d).select("conv_id", "turn", F.round(tx.pair_score("before", "line"), 6).alias("score"))


def h5_support_score(spark, d):
    return _neighbours(spark, d).select("conv_id", "turn", F.round(tx.support_score("before", "line"), 6).alias("score"))


def h6_contained_score(spark, d):
    return _neighbours(spark, d).select("conv_id", "turn", F.round(tx.contained_score("before", "line"), 6).alias("score"))


def h7_token_distance(spark, d):
    return _neighbours(spark, d).select("conv_id", "turn", tx.token_distance("before", "line").alias("distance"))


def h8_edit_script(spark, d):
    ops = _neighbours(spark, d).select("conv_id", "turn", F.explode(tx.edit_script("before", "line")).alias("e"))
    return ops.groupBy("conv_id", "turn", F.col("e.op").alias("op")).agg(F.count("*").alias("n"))


def h10_layout(spark, d):
    return _neighbours(spark, d).select("conv_id", "turn", tx.laid_out("before", "line").alias("text"))


#: What is put before texts, so that scans and spans meet other scripts: by id modulo 4.
SAMPLES = ("", "サッカー テスト。", "널 사랑해 ", "未知の漢字 ")


def _sampled(text: str = "text"):
    return F.concat(F.element_at(F.array(*map(F.lit, SAMPLES)), (F.col("doc_id") % 4 + 1).cast("int")), F.col(text))


def h12_language_spans(spark, d):
    docs = table(ship(spark), d, "documents").withColumn("text", _sampled())
    s = docs.select("doc_id", F.posexplode(tx.language_spans(F.col("text"), F.col("lang"))).alias("span", "s"))
    return s.select("doc_id", "span", F.col("s.start").alias("at"), F.col("s.end").alias("until"), F.col("s.language").alias("language"), F.col("s.script").alias("script"))


#: The samples' spans are known; what follows is in the language of the table, or of no script.
H12 = """WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, doc_id % 4 AS k, regexp_matches(coalesce(text, ''), '[A-Za-zÀ-ÖØ-öø-ÿĀ-ž]') AS latin FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, CASE k WHEN 0 THEN 0 WHEN 1 THEN 9 ELSE 6 END AS n, length(regexp_extract(text, '^[^A-Za-zÀ-ÖØ-öø-ÿĀ-ž]*')) AS lead FROM d)
SELECT doc_id, CAST(0 AS INTEGER) AS span, CAST(0 AS INTEGER) AS at, CAST(CASE WHEN latin THEN n + lead ELSE n + length(text) END AS INTEGER) AS until, CASE k WHEN 1 THEN 'ja' WHEN 2 THEN 'ko' END AS language, CASE k WHEN 1 THEN 'kana' WHEN 2 THEN 'hangul' END AS script FROM p WHERE k IN (1, 2)
UNION ALL SELECT doc_id, 1, n + lead, n + length(text), lang, 'latin' FROM p WHERE k IN (1, 2) AND latin
UNION ALL SELECT doc_id, 0, 0, CASE WHEN latin THEN length(text) ELSE length(text) END, CASE WHEN latin THEN lang ELSE 'unknown' END, CASE WHEN latin THEN 'latin' ELSE 'other' END FROM p WHERE k = 0 AND text <> ''
UNION ALL SELECT doc_id, u.i, u.a, u.b, u.l, u.s FROM p, (VALUES (0, 0, 2, 'und-han', 'han'), (1, 2, 3, 'ja', 'kana')) u(i, a, b, l, s) WHERE k = 3
UNION ALL SELECT doc_id, 2, 3, CASE WHEN latin THEN n + lead ELSE n + length(text) END, 'und-han', 'han' FROM p WHERE k = 3
UNION ALL SELECT doc_id, 3, n + lead, n + length(text), lang, 'latin' FROM p WHERE k = 3 AND latin"""


def h14_phonetic(spark, d):
    docs = table(ship(spark), d, "documents").withColumn("text", _sampled())
    return docs.select("doc_id", F.sha2(tx.phonetic("text"), 256).alias("phonetic_sha"))


H14 = r"""SELECT doc_id, sha256(CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'sakkatesuto' WHEN 2 THEN 'neolsaranghae' ELSE '未知no漢字' END || regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g')) AS phonetic_sha FROM documents"""


def h21_hinge(spark, d):
    """A piecewise-linear map at each value, and back."""
    e = table(spark, d, "events").select("event_id", "value")
    breaks, deltas = F.array(F.lit(10.0), F.lit(25.0)), F.array(F.lit(0.5), F.lit(-0.3))
    bend = F.aggregate(F.arrays_zip(breaks.alias("b"), deltas.alias("d")), F.lit(0.0), lambda a, h: a + h["d"] * F.greatest(F.lit(0.0), F.col("value") - h["b"]))
    y = F.lit(2.0) + F.lit(1.1) * F.col("value") + bend
    e = e.withColumn("y", y)
    back = F.when(F.col("y") <= 13.0, (F.col("y") - 2.0) / 1.1).when(F.col("y") <= 37.0, 10.0 + (F.col("y") - 13.0) / 1.6).otherwise(25.0 + (F.col("y") - 37.0) / 1.3)
    return e.select("event_id", F.round("y", 6).alias("y"), F.round(back - F.col("value"), 6).alias("error"))


def h23_vectors(spark, d):
    """Cosine of each vector with the first."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    one = F.broadcast(v.where("vec_id = 0").select(F.col("v").alias("q")))  # one row
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return v.join(one).select("vec_id", F.round(dot("v", "q") / F.sqrt(dot("v", "v") * dot("q", "q")), 5).alias("cosine"))


PAIRS = "SELECT conv_id, turn, text AS a, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM {conversations}"

#: DuckDB counts bytes: the tables' accented letters are put as single bytes that the turns don't have.
BYTES = PAIRS.replace("text", "translate(text, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', '!#$%&()*+-/0123456789')")

B4 = """WITH p AS ({}), s AS (SELECT conv_id, turn, 1 - levenshtein(a, b) / CAST(greatest(length(a), length(b), 1) AS DOUBLE) AS score, least(length(a), length(b)) / CAST(greatest(length(a), length(b), 1) AS DOUBLE) AS ratio, length(a) AS n FROM p WHERE b IS NOT NULL)
        SELECT conv_id, turn, round(score, 6) AS score, score >= 0.3 AND ratio >= 0.6 AND (n > 3 OR score >= 0.84) AS safe FROM s"""
H7 = "WITH p AS ({}) SELECT conv_id, turn, CAST(levenshtein(a, b) AS INT) AS distance FROM p WHERE b IS NOT NULL"

QUERIES = {
    "b1_metadata_predicate": both("SELECT doc_id, contains(lower(text), 'licensed under') OR contains(lower(text), 'released under') OR contains(lower(text), 'copyright') AS is_metadata FROM {documents}"),
    "b2_title_like": both("SELECT p_partkey FROM {part} WHERE p_size > 10 AND contains(p_name, ' ')"),
    "b3_pure_tokens": both("SELECT doc_id FROM {documents} WHERE LIKE[lower(text)|'^[a-z]+[.]?$']"),
    "b4_safe_match": both(B4.replace("{}", PAIRS), B4.replace("{}", BYTES)),
    "b5_span_admission": both("""WITH p AS (SELECT l_orderkey, l_linenumber, l_linenumber % 4 + 1 AS span, 1 - l_discount AS score, 1 - l_tax AS ratio FROM {lineitem})
        SELECT l_orderkey, l_linenumber, CASE WHEN span = 1 THEN true WHEN span = 2 THEN score >= 0.95 AND ratio >= 0.96 ELSE score >= 0.98 AND ratio >= 0.98 END AS admitted FROM p"""),
    "b6_private_rows": both("SELECT doc_id, SHA[text] AS text_sha, BIG[length(text)] AS n FROM {documents}"),
    "b7_actionable_shift": both("SELECT event_id, abs(value - 25) AS shift FROM {events} WHERE abs(value - 25) >= 0.35 AND abs(value - 25) <= 8"),
    "b8_content_scan": both("SELECT doc_id, contains(text, 'AKIA') AS has_key, contains(text, 'password=') AS has_password, LIKE[text|'[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}'] AS has_address FROM {documents}".replace("{1,3}", "{{1,3}}"), "SELECT doc_id, contains(text, 'AKIA') AS has_key, contains(text, 'password=') AS has_password, LIKE[text|'[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}'] AS has_address FROM {documents}"),
    "b9_path_rules": both("SELECT page_id, CASE WHEN contains(url, '?') THEN 'query' WHEN contains(url, '#') THEN 'fragment' WHEN url LIKE '%/' THEN 'folder' ELSE 'page' END AS kind, url LIKE 'https://%' AS secure FROM {pages}"),
    "b10_capability": both("SELECT doc_id FROM {documents} WHERE lang IN ('de', 'fr') AND n_chars > 100"),
    "b11_split_filter": both("SELECT doc_id, lang FROM {documents} WHERE source IN ('src1', 'src4', 'src7')"),
    "b12_stage_gate": both("SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'P' OR o_totalprice > 250000"),
    "b13_vote_gate": both("SELECT event_id, value >= 1 AND value <= 60 AS timing_ok, event_type IN ('view', 'click') AS local_ok FROM {events}"),
    "h1_match_key": (h1_match_key, r"SELECT doc_id, sha256(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\p{P}\p{Z}\p{C}]', '', 'g')) AS key FROM documents"),
    "h2_alnum_key": (h2_alnum_key, r"SELECT doc_id, sha256(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g')) AS key FROM documents"),
    "h3_display": both("SELECT doc_id, SHA[trim(SUB[text|'[ \t\n\r]+'|' '])] AS shown FROM {documents}"),
    "h4_pair_score": (h4_pair_score, None),
    "h5_support_score": (h5_support_score, None),
    "h6_contained_score": (h6_contained_score, None),
    "h7_levenshtein": both(H7.replace("{}", PAIRS), H7.replace("{}", BYTES)),
    "h7_token_distance": (h7_token_distance, None),
    "h8_edit_script": (h8_edit_script, None),
    "h10_layout": (h10_layout, None),
    "h12_script_flags": both("SELECT doc_id, LIKE[text|'[a-zA-Z]'] AS has_latin, LIKE[text|'[À-ÿ]'] AS has_accents, LIKE[text|'[぀-ヿ一-鿿]'] AS has_cjk FROM {documents}"),
    "h12_language_spans": (h12_language_spans, H12),
    "h13_tokens": both("SELECT doc_id, CAST(size(regexp_extract_all(lower(text), '[a-zà-ÿ]+', 0)) AS BIGINT) AS n_tokens FROM {documents}", "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS BIGINT) AS n_tokens FROM {documents}"),
    "h14_phonetic": (h14_phonetic, H14),
    "h16_language_alias": both("SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' ELSE 'und' END AS code, CASE lang WHEN 'en' THEN 0.8e0 WHEN 'de' THEN 0.75e0 ELSE 0.7e0 END AS threshold FROM {documents}"),
    "h19_clock": both("""WITH m AS (SELECT event_id, DIV[US[ts]|1000] % 86400000 AS ms FROM {events})
        SELECT event_id, lpad(CAST(DIV[ms|3600000] AS STRING), 2, '0') || ':' || lpad(CAST(DIV[ms|60000] % 60 AS STRING), 2, '0') || ':' || lpad(CAST(DIV[ms|1000] % 60 AS STRING), 2, '0') || ',' || lpad(CAST(ms % 1000 AS STRING), 3, '0') AS clock FROM m"""),
    "h20_math": both("SELECT l_orderkey, l_linenumber, EVEN[l_quantity / 2|0] AS half, round(ln(l_extendedprice), 6) AS log_price, greatest(0e0, least(1e0, l_discount * 12)) AS clipped, coalesce(l_tax / nullif(l_discount, 0), 0e0) AS safe FROM {lineitem}"),
    "h21_hinge": (h21_hinge, """WITH y AS (SELECT event_id, value, 2.0::DOUBLE + 1.1::DOUBLE * value + 0.5::DOUBLE * greatest(0.0::DOUBLE, value - 10) - 0.3::DOUBLE * greatest(0.0::DOUBLE, value - 25) AS y FROM events)
        SELECT event_id, round(y, 6) AS y, round(CASE WHEN y <= 13 THEN (y - 2) / 1.1::DOUBLE WHEN y <= 37 THEN 10 + (y - 13) / 1.6::DOUBLE ELSE 25 + (y - 37) / 1.3::DOUBLE END - value, 6) AS error FROM y"""),
    "h22_arrays": both("SELECT l_orderkey, CAST(size(a) AS BIGINT) AS n, a[0] AS first_x, array_max(a) AS top, forall(sequence(1, greatest(1, size(a) - 1)), i -> size(a) = 1 OR a[i] >= a[i - 1]) AS rising FROM (SELECT l_orderkey, transform(array_sort(collect_list(struct(l_linenumber, l_quantity))), x -> x.l_quantity) AS a FROM {lineitem} GROUP BY 1) t",
        "SELECT l_orderkey, count(*) AS n, first(l_quantity ORDER BY l_linenumber, l_quantity) AS first_x, max(l_quantity) AS top, bool_and(p IS NULL OR l_quantity >= p) AS rising FROM (SELECT *, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS p FROM {lineitem}) t GROUP BY 1"),
    "h23_vectors": (h23_vectors, "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 5) AS cosine FROM embeddings"),
    "h24_ids": both("SELECT o_orderkey, substr(SHA[concat_ws(chr(31), CAST(o_orderkey AS STRING), CAST(o_custkey AS STRING), o_orderstatus)], 1, 20) AS id FROM {orders}"),
    "h25_map_filter": both("SELECT event_id, get_json_object(props, '$.k') AS k FROM {events}", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM {events}"),
    "h26_tempo_ratio": both("SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity / 1000 AS ratio, CASE WHEN l_quantity > 25 THEN 'hard' ELSE 'soft' END AS prior FROM {lineitem}"),
    "h27_first_present": both("SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN value * 1000 END, CASE WHEN event_type = 'click' THEN value END, -1e0) AS time_ms FROM {events}"),
    "k1_projection": both("SELECT event_id, round((value - 2) / 1.25e0, 6) AS mix_start, round(least((value + 3 - 2) / 1.25e0, 30e0), 6) AS mix_end FROM {events} WHERE (value - 2) / 1.25e0 >= 0 AND (value - 2) / 1.25e0 < 30"),
    "k2_cut_aware": both("""WITH g AS (SELECT 1 AS seg, 0e0 AS a, 18e0 AS b UNION ALL SELECT 2, 24e0, 200e0)
        SELECT e.event_id, CASE WHEN min(seg) IS NULL THEN 'omitted' WHEN bool_or(e.value + 1 > g.b) THEN 'issue' ELSE 'projected' END AS outcome, min(seg) AS seg FROM {events} e LEFT JOIN g ON e.value >= g.a AND e.value < g.b GROUP BY e.event_id"""),
    "k3_forced_projection": both("""WITH g AS (SELECT 1 AS seg, 0e0 AS a, 18e0 AS b UNION ALL SELECT 2, 24e0, 200e0)
        SELECT e.event_id, CASE WHEN s.seg = t.seg THEN round(e.value * 2, 6) END AS start_mix, CASE WHEN s.seg = t.seg THEN round((e.value + 2) * 2, 6) END AS end_mix FROM {events} e LEFT JOIN g s ON e.value >= s.a AND e.value <= s.b LEFT JOIN g t ON e.value + 2 >= t.a AND e.value + 2 <= t.b"""),
    "k4_clip": both("SELECT event_id, greatest(value, 10e0) AS clip_start, least(value + 6, 40e0) AS clip_end FROM {events} WHERE least(value + 6, 40e0) > greatest(value, 10e0)"),
    "k5_composition_check": both("""WITH x AS (SELECT event_id, user_id, US[ts] AS t, US[ts] + BIG[floor(value)] * 60000000 AS e FROM {events}),
        n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS number, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nxt FROM x) SELECT user_id, count(*) AS n_cues, count_if(nxt < e) AS n_overlaps, count_if(e <= t) AS n_empty FROM n GROUP BY 1"""),
    "k6_interval_plan": both("""WITH x AS (SELECT o_custkey, o_orderkey, o_totalprice AS b, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS nxt, max(o_totalprice) OVER (PARTITION BY o_custkey) AS dur FROM {orders})
        SELECT o_orderkey, b AS primary_start, coalesce(nxt, dur) AS primary_end, greatest(0e0, coalesce(nxt, dur) - 500) AS change_start, least(dur, coalesce(nxt, dur) + 500) AS change_end FROM x"""),
    "k7_partial_repair": both("""WITH t AS (SELECT conv_id, count(*) AS n, count_if(length(text) > 200) AS n_trusted FROM {conversations} GROUP BY 1)
        SELECT conv_id, CASE WHEN n_trusted = n THEN 'preserve' WHEN n_trusted = 0 THEN 'rebuild' ELSE 'hybrid' END AS route FROM t"""),
    "e23_interpolation": both("""WITH p AS (SELECT event_id, user_id, US[ts] AS t, CASE WHEN event_type = 'purchase' THEN value END AS v FROM {events}),
        a AS (SELECT *, last_value(v) IGNORE NULLS OVER w AS v0, first_value(v) IGNORE NULLS OVER n AS v1 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT event_id, round(coalesce((v0 + v1) / 2, v0, v1), 6) AS filled FROM a""", """WITH p AS (SELECT event_id, user_id, US[ts] AS t, CASE WHEN event_type = 'purchase' THEN value END AS v FROM {events}),
        a AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS v0, first_value(v IGNORE NULLS) OVER n AS v1 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT event_id, round(coalesce((v0 + v1) / 2, v0, v1), 6) AS filled FROM a"""),
}
