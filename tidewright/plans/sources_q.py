"""Scans and sinks, fed with texts made from the tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.sources import cues
from tidewright.sources.tables import table


def _line() -> Column:
    """A turn as one line of text, whole."""
    return F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " "))


#: The same in SQL.
LINE = r"trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))"


def _cues(spark, d):
    c = table(spark, d, "conversations").where(_line() != "")
    return c.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("path"), (F.col("turn") + 1).cast("int").alias("number"), (F.col("turn") * 4000).alias("start_ms"), (F.col("turn") * 4000 + 3000).alias("end_ms"), _line().alias("text"))


def a1_srt_scan(spark, d):
    """Conversations as SRT texts, scanned again; a fault anywhere would raise."""
    files = cues.render_srt(_cues(spark, d), ["path"])
    return cues.parse_srt_strict(files).select("path", "ordinal", "number", "start_ms", "end_ms", "text")


A1 = """SELECT 'conv-' || conv_id AS path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ordinal, CAST(turn + 1 AS INTEGER) AS number, turn * 4000 AS start_ms, turn * 4000 + 3000 AS end_ms,
LINE AS text FROM conversations WHERE LINE <> ''""".replace("LINE", LINE)


def a2_layout_scan(spark, d):
    """CRLF texts keep their line ends when one block's text is replaced."""
    files = cues.render_srt(_cues(spark, d), ["path"]).select("path", F.regexp_replace("value", "\n", "\r\n").alias("value"))
    changes = files.select("path", F.lit(0).alias("raw_block_index"), F.lit("changed").alias("new_text"))
    out = cues.with_replaced_blocks(files, changes)
    return out.select("path", F.contains("value", F.lit("changed\r\n")).alias("changed"), (F.length("value") - F.length(F.regexp_replace("value", "\r", ""))).alias("n_returns"))


A2 = "SELECT 'conv-' || conv_id AS path, true AS changed, CAST(4 * count(*) - 1 AS INTEGER) AS n_returns FROM conversations WHERE trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) <> '' GROUP BY conv_id"


def a4_lrc_scan(spark, d):
    """Turns as LRC lines, every third with two time tags."""
    c = table(spark, d, "conversations")
    at = lambda m: F.format_string("[%02d:%02d.50]", (F.col("turn") / 60).cast("int") + m, (F.col("turn") % 60).cast("int"))
    line = F.concat(at(0), F.when(F.col("turn") % 3 == 0, at(5)).otherwise(""), _line())
    files = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("value")).select(F.col("conv_id").cast("string").alias("path"), "value")
    return cues.parse_lrc(files).select(F.col("path").cast("long").alias("conv_id"), "ordinal", "time_ms", "text")


A4 = """WITH c AS (SELECT conv_id, turn, LINE AS text FROM conversations WHERE LINE <> ''),
t AS (SELECT conv_id, turn, 0 AS k, turn * 1000 + 500 AS time_ms, trim(text) AS text FROM c UNION ALL SELECT conv_id, turn, 1, 300000 + turn * 1000 + 500, trim(text) FROM c WHERE turn % 3 = 0)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY time_ms, turn, k) - 1 AS INTEGER) AS ordinal, time_ms, text FROM t""".replace("LINE", LINE)


def a7_word_scan(spark, d):
    """Order lines as word-timed lines."""
    l = table(spark, d, "lineitem")  # noqa: E741
    word = F.concat(F.lit("w"), F.col("l_linenumber").cast("string"), F.lit("("), (F.col("l_linenumber") * 100 + 5000).cast("string"), F.lit(","), F.col("l_quantity").cast("int").cast("string"), F.lit(")"))
    files = l.groupBy("l_orderkey").agg(F.concat(F.lit("[5000,2000]"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", word.alias("w")))), lambda x: x["w"]), "")).alias("value"))
    got = cues.parse_words(files.select(F.col("l_orderkey").cast("string").alias("path"), "value"))
    return got.select(F.col("path").cast("long").alias("l_orderkey"), "token", "text", "start_ms", "end_ms")


A7 = """SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS INTEGER) AS token, 'w' || l_linenumber AS text, CAST(5000 + l_linenumber * 100 AS BIGINT) AS start_ms, CAST(5000 + l_linenumber * 100 + floor(l_quantity) AS BIGINT) AS end_ms FROM lineitem"""


def a3_lenient_scan(spark, d):
    """Texts with blocks that can't be read: no block at all, and every third cue of no length. They are skipped."""
    c = _cues(spark, d).withColumn("end_ms", F.when(F.col("number") % 3 == 0, F.col("start_ms")).otherwise(F.col("end_ms")))
    files = cues.render_srt(c, ["path"]).select("path", F.concat(F.lit("no cue\nat all\n\n"), "value").alias("value"))
    return cues.parse_srt(files).select("path", "ordinal", "number", "start_ms", "end_ms", "text")


A3 = A1.replace("WHERE", "WHERE (turn + 1) % 3 <> 0 AND")


def a5_alternatives(spark, d):
    """Lines of equal time are one line and its alternatives."""
    c = table(spark, d, "conversations").where(_line() != "")
    at = F.format_string("[%02d:%02d.50]", (F.col("turn") / 60).cast("int"), (F.col("turn") % 60).cast("int"))
    line = F.concat(at, _line(), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\n"), at, F.col("role"))).otherwise(""))
    files = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("value")).select(F.col("conv_id").cast("string").alias("path"), "value")
    got = cues.alternatives(cues.parse_lrc(files))
    return got.select(F.col("path").cast("long").alias("conv_id"), "time_ms", "n", F.array_join("texts", " / ").alias("texts"))


A5 = """SELECT conv_id, turn * 1000 + 500 AS time_ms, CAST(CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n, LINE || CASE WHEN turn % 2 = 0 THEN ' / ' || role ELSE '' END AS texts FROM conversations WHERE LINE <> ''""".replace("LINE", LINE)


def a6_enhanced_scan(spark, d):
    """Order lines as words with marks of their own."""
    l = table(spark, d, "lineitem")  # noqa: E741
    word = F.format_string("<00:%02d.50>w%d", F.col("l_linenumber").cast("int"), F.col("l_quantity").cast("int"))
    files = l.groupBy("l_orderkey").agg(F.concat(F.lit("[00:00.10]"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", word.alias("w")))), lambda x: x["w"]), "")).alias("value"))
    got = cues.parse_enhanced(files.select(F.col("l_orderkey").cast("string").alias("path"), "value"))
    return got.select(F.col("path").cast("long").alias("l_orderkey"), "token", "text", "start_ms", "end_ms")


A6 = """SELECT l_orderkey, CAST(row_number() OVER w - 1 AS INTEGER) AS token, 'w' || CAST(floor(l_quantity) AS INTEGER) AS text, CAST(l_linenumber * 1000 + 500 AS BIGINT) AS start_ms, CAST(lead(l_linenumber) OVER w * 1000 + 500 AS BIGINT) AS end_ms
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity)"""


def a10_song_list(spark, d):
    c = table(spark, d, "conversations")
    line = F.format_string("%02d:%02d %s - Song No %d", (F.col("turn") / 60).cast("int"), (F.col("turn") % 60).cast("int"), F.initcap("role"), F.col("turn") % 3)
    files = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("value")).select(F.col("conv_id").cast("string").alias("path"), "value")
    return cues.parse_song_list(files).select(F.col("path").cast("long").alias("conv_id"), "ordinal", "nominal_start_ms", "artist", "title", "track_id")


A10 = """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ordinal, turn * 1000 AS nominal_start_ms, upper(role[1]) || role[2:] AS artist, 'Song No ' || (turn % 3) AS title,
substr(sha256(lower(role) || chr(31) || 'song no ' || (turn % 3)), 1, 12) AS track_id FROM conversations"""


def a11_tempo_list(spark, d):
    p = table(spark, d, "part")
    line = F.concat("p_name", F.lit(": "), F.col("p_size").cast("string"), F.lit(" -> "), (F.col("p_size") + 10).cast("string"), F.lit(".5"))
    files = p.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("value")).select(F.col("p_brand").alias("path"), "value")
    return cues.parse_tempo_list(files).select(F.col("path").alias("p_brand"), "title_key", "source_bpm", "target_bpm", F.round("ratio", 6).alias("ratio"))


A11 = "SELECT p_brand, lower(p_name) AS title_key, CAST(p_size AS DOUBLE) AS source_bpm, p_size + 10.5e0 AS target_bpm, round((p_size + 10.5e0) / p_size, 6) AS ratio FROM part"


def a19_srt_sink(spark, d):
    return cues.render_srt(_cues(spark, d), ["path"]).select("path", F.sha2("value", 256).alias("value_sha"))


A19 = """WITH c AS (SELECT conv_id, turn, LINE AS text, turn * 4 AS s FROM conversations WHERE LINE <> ''),
t AS (SELECT *, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) || ',000 --> ' || printf('%02d:%02d:%02d', (s + 3) // 3600, (s + 3) // 60 % 60, (s + 3) % 60) || ',000' AS clock FROM c)
SELECT 'conv-' || conv_id AS path, sha256(string_agg((turn + 1) || chr(10) || clock || chr(10) || text, chr(10) || chr(10) ORDER BY turn) || chr(10)) AS value_sha FROM t GROUP BY conv_id""".replace("LINE", LINE)


def a12_json_scan(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k INT").getField("k").alias("k"))


A12 = "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events"

QUERIES = {
    "a1_srt_scan": (a1_srt_scan, A1),
    "a2_layout_scan": (a2_layout_scan, A2),
    "a3_lenient_scan": (a3_lenient_scan, A3),
    "a4_lrc_scan": (a4_lrc_scan, A4),
    "a5_alternatives": (a5_alternatives, A5),
    "a6_enhanced_scan": (a6_enhanced_scan, A6),
    "a10_song_list": (a10_song_list, A10),
    "a11_tempo_list": (a11_tempo_list, A11),
    "a19_srt_sink": (a19_srt_sink, A19),
    "a7_word_scan": (a7_word_scan, A7),
    "a12_json_scan": (a12_json_scan, A12),
}
