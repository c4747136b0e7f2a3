"""Scans and sinks of timed-text formats: SRT, line LRC, enhanced LRC, word-timed lyrics, song and tempo lists.

Every scan takes whole files as rows (path, value), so files are spread over tasks and never joined by line order;
parsing is Spark expressions. Strict scans raise on the first malformed row; lenient ones skip what they can't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLOCK = r"(\d{1,3}):([0-5]\d):([0-5]\d)[,.](\d{3})"
TIMING = rf"^\s*{CLOCK}\s*-->\s*{CLOCK}\s*$"
TAG = r"\[(\d{1,3}):(\d{1,2})(?:[.:](\d{1,3}))?\]"


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Whole files as (path, value)."""
    return spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def decoded(files: DataFrame) -> DataFrame:
    """binaryFile rows as text: UTF-8 with or without a byte-order mark, anything else is an error."""
    text = F.decode("content", "UTF-8")
    bad = ~F.expr("is_valid_utf8(CAST(content AS STRING))")
    return files.select("path", F.when(bad, F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path")))).otherwise(F.regexp_replace(text, "^﻿", "")).alias("value"), text.startswith("﻿").alias("has_mark"))


def clock_ms(text: Column, at: int = 1, pattern: str = TIMING) -> Column:
    g = lambda i: F.regexp_extract(text, pattern, at + i).cast("long")
    return ((g(0) * 60 + g(1)) * 60 + g(2)) * 1000 + g(3)


def as_clock(ms: Column) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    whole = lambda d: F.floor(ms / d).cast("long")
    return F.concat(two(whole(3600000)), F.lit(":"), two(whole(60000) % 60), F.lit(":"), two(whole(1000) % 60), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def blocks(files: DataFrame) -> DataFrame:
    """Blank-line separated blocks with their place, new lines unified."""
    text = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), r"\r\n?", "\n")
    split = F.split(F.regexp_replace(text, r"^\s*\n|\s+$", ""), r"\n[ \t]*\n+")
    return files.select("path", F.posexplode(split).alias("raw_block_index", "block")).where("trim(block) <> ''")


def _srt(files: DataFrame) -> DataFrame:
    b = blocks(files).withColumn("lines", F.split("block", "\n"))
    timing = F.get("lines", F.lit(1))
    ok = F.get("lines", F.lit(0)).rlike(r"^\s*\d+\s*$") & timing.rlike(TIMING)
    b = b.withColumn("ok", F.coalesce(ok, F.lit(False)))
    good = lambda c: F.when(F.col("ok"), c)
    b = b.withColumn("number", good(F.trim(F.get("lines", F.lit(0))).cast("int"))).withColumn("timing", good(timing)).withColumn("start_ms", good(clock_ms(timing))).withColumn("end_ms", good(clock_ms(timing, 5)))
    return b.withColumn("text", F.array_join(F.slice("lines", F.lit(3), F.greatest(F.size("lines") - 2, F.lit(0))), "\n"))


def parse_srt(files: DataFrame) -> DataFrame:
    """Lenient: (path, ordinal, number, timing, start_ms, end_ms, text) of the blocks that can be read."""
    good = _srt(files).where("ok and end_ms > start_ms and trim(text) <> ''")
    order = Window.partitionBy("path").orderBy("raw_block_index")
    return good.select("path", (F.row_number().over(order) - 1).alias("ordinal"), "number", "timing", "start_ms", "end_ms", "text", "raw_block_index")


def srt_faults(files: DataFrame) -> DataFrame:
    """(path, raw_block_index, fault) of every block that the strict scan refuses."""
    s = _srt(files).withColumn("times", F.count("*").over(Window.partitionBy("path", "number")))
    fault = F.when(F.size("lines") < 3, "too_few_lines").when(~F.col("ok"), "malformed").when(F.col("number") <= 0, "number").when(F.col("end_ms") <= F.col("start_ms"), "duration").when(F.trim("text") == "", "blank").when(F.col("times") > 1, "repeated_number")
    return s.select("path", "raw_block_index", fault.alias("fault")).where("fault is not null")


def parse_srt_strict(files: DataFrame) -> DataFrame:
    """As parse_srt, but any fault raises."""
    first = srt_faults(files).orderBy("path", "raw_block_index").first()
    if first is not None:
        raise ValueError(f"{first.path}, block {first.raw_block_index}: {first.fault}")
    return parse_srt(files)


def render_srt(cues: DataFrame, keys: list[str]) -> DataFrame:
    """One text for each key from (number, start_ms, end_ms, text)."""
    cue = F.concat_ws("\n", F.col("number").cast("string"), F.concat(as_clock(F.col("start_ms")), F.lit(" --> "), as_clock(F.col("end_ms"))), F.col("text"))
    listed = F.array_sort(F.collect_list(F.struct("start_ms", "number", cue.alias("cue"))))
    return cues.groupBy(*keys).agg(F.concat(F.array_join(F.transform(listed, lambda x: x["cue"]), "\n\n"), F.lit("\n")).alias("value"))


def with_replaced_blocks(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Files with the texts of some blocks replaced (path, raw_block_index, new_text); layout and line ends stay."""
    parts = files.select("path", F.posexplode(F.split("value", r"(?<=\n)(?=\r?\n)|(?<=\n\n)|(?<=\n\r\n)")).alias("part", "piece"))
    number = F.sum((F.trim("piece") != "").cast("int")).over(Window.partitionBy("path").orderBy("part")) - 1
    parts = parts.withColumn("raw_block_index", F.when(F.trim(F.regexp_replace("piece", r"\s", "")) != "", number))
    j = parts.join(changes, ["path", "raw_block_index"], "left")
    kept = F.regexp_extract("piece", r"^((?:[^\n]*\n){2})", 1)
    end = F.regexp_extract("piece", r"(\r?\n?)$", 1)
    piece = F.when(F.col("new_text").isNotNull(), F.concat(kept, "new_text", end)).otherwise(F.col("piece"))
    return j.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", piece.alias("p")))), lambda x: x["p"]), "").alias("value"))


def fraction_ms(f: Column) -> Column:
    """1 to 3 digits after the point as milliseconds."""
    return F.rpad(F.when(f == "", "0").otherwise(f), 3, "0").cast("long")


def tag_ms(tag: Column) -> Column:
    g = lambda i: F.regexp_extract(tag, TAG, i)
    return (g(1).cast("long") * 60 + g(2).cast("long")) * 1000 + fraction_ms(g(3))


def lines(files: DataFrame) -> DataFrame:
    text = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), r"\r\n?", "\n")
    return files.select("path", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def parse_lrc(files: DataFrame) -> DataFrame:
    """(path, ordinal, time_ms, text, source_line): a line with several time tags counts once for each, in order of time."""
    l = lines(files).withColumn("tags", F.regexp_extract_all("line", F.lit(TAG), F.lit(0))).where(F.size("tags") > 0)  # noqa: E741
    text = F.trim(F.regexp_replace("line", TAG, ""))
    l = l.select("path", "line_no", text.alias("text"), F.posexplode("tags").alias("seq", "tag")).withColumn("time_ms", tag_ms(F.col("tag"))).where("text <> ''")  # noqa: E741
    order = Window.partitionBy("path").orderBy("time_ms", "line_no", "seq")
    return l.select("path", (F.row_number().over(order) - 1).alias("ordinal"), "time_ms", "text", F.col("line_no").alias("source_line"))


def alternatives(lyrics: DataFrame) -> DataFrame:
    """Lines of equal time as one row: how many, the first, all."""
    return lyrics.groupBy("path", "time_ms").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]).alias("texts"))


def parse_enhanced(files: DataFrame) -> DataFrame:
    """Words with their own marks <mm:ss.xx>: a word ends where the next begins, the last has no end."""
    mark = r"<(\d{1,3}):(\d{1,2})(?:[.:](\d{1,3}))?>([^<]*)"
    l = lines(files).withColumn("marks", F.regexp_extract_all("line", F.lit(mark), F.lit(0))).where(F.size("marks") > 0)  # noqa: E741
    l = l.select("path", "line_no", F.posexplode("marks").alias("token", "m"))  # noqa: E741
    g = lambda i: F.regexp_extract("m", mark, i)
    l = l.withColumn("start_ms", (g(1).cast("long") * 60 + g(2).cast("long")) * 1000 + fraction_ms(g(3))).withColumn("text", g(4))  # noqa: E741
    return l.select("path", "line_no", "token", "text", "start_ms", F.lead("start_ms").over(Window.partitionBy("path", "line_no").orderBy("token")).alias("end_ms"))


def parse_words(files: DataFrame) -> DataFrame:
    """Word-timed lines `[start,duration]word(start,duration)...`; starts before the line's are relative to it."""
    head, word = r"^\[(\d+),(\d+)\]", r"([^()]*)\((\d+),(\d+)\)"
    l = lines(files).where(F.col("line").rlike(head))  # noqa: E741
    l = l.withColumn("at", F.regexp_extract("line", head, 1).cast("long")).withColumn("dur", F.regexp_extract("line", head, 2).cast("long"))  # noqa: E741
    words = F.regexp_extract_all(F.regexp_replace("line", head, ""), F.lit(word), F.lit(0))
    l = l.select("path", "line_no", "at", "dur", F.posexplode(words).alias("token", "w"))  # noqa: E741
    g = lambda i: F.regexp_extract("w", word, i)
    l = l.withColumn("text", g(1)).withColumn("s", g(2).cast("long")).withColumn("d", g(3).cast("long"))  # noqa: E741
    own = Window.partitionBy("path", "line_no")
    relative = (F.min("s").over(own) < F.greatest(F.lit(0), F.col("at") - 500)) & (F.max("s").over(own) <= F.col("dur") + 500)
    start = F.when(relative, F.col("at") + F.col("s")).otherwise(F.col("s"))
    return l.select("path", "line_no", "token", "text", start.alias("start_ms"), (start + F.col("d")).alias("end_ms"))


def parse_song_list(files: DataFrame) -> DataFrame:
    """`MM:SS Artist - Title` lines in non-decreasing time."""
    row = r"^\s*(?:(\d{1,2}):)?(\d{1,3}):(\d{2})\s+(.+?)\s+-\s+(.+?)\s*$"
    g = lambda i: F.regexp_extract("line", row, i)
    hours = F.when(g(1) == "", "0").otherwise(g(1)).cast("long")
    l = lines(files).where(F.col("line").rlike(row)).withColumn("start_ms", ((hours * 60 + g(2).cast("long")) * 60 + g(3).cast("long")) * 1000)  # noqa: E741
    order = Window.partitionBy("path").orderBy("line_no")
    back = F.lag("start_ms").over(order) > F.col("start_ms")
    start = F.when(back, F.raise_error(F.concat(F.lit("times go back at "), F.col("line")))).otherwise(F.col("start_ms"))
    track = F.substring(F.sha2(F.concat_ws("\u001f", F.lower(g(4)), F.lower(g(5))), 256), 1, 12)
    return l.select("path", (F.row_number().over(order) - 1).alias("ordinal"), start.alias("nominal_start_ms"), g(4).alias("artist"), g(5).alias("title"), track.alias("track_id"))


def parse_tempo_list(files: DataFrame) -> DataFrame:
    """`Title: 128 -> 132` lines."""
    row = r"^\s*(.+?)\s*[:|]\s*(\d+(?:\.\d+)?)\s*(?:->|=>)\s*(\d+(?:\.\d+)?)\s*$"
    g = lambda i: F.regexp_extract("line", row, i)
    return lines(files).where(F.col("line").rlike(row)).select("path", F.lower(g(1)).alias("title_key"), g(2).cast("double").alias("source_bpm"), g(3).cast("double").alias("target_bpm"), (g(3).cast("double") / g(2).cast("double")).alias("ratio"))
