"""Paths through observations and lines of each user, and words that move between neighbouring cues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.operators import sequences
from tidewright.sources.code import ship
from tidewright.sources.tables import events_us, table


def _lines(spark, d):
    e = events_us(ship(spark), d).withColumn("k", (F.row_number().over(Window.partitionBy("user_id").orderBy("t_us", "event_id")) - 1).cast("int"))
    text = F.when(F.col("event_id") % 13 == 5, "oh yeah").otherwise(F.concat_ws(" ", "event_type", F.format_string("%d", F.col("event_id") % 100), F.floor("value"), F.lit("of the day")))
    return e.select("user_id", "event_id", "k", "value", text.alias("text"))


def i16_reused_path(spark, d):
    """Each user's events as projected lines, and as observations: every seventh is missing, some are cut in two or misheard."""
    e = _lines(spark, d)
    events = e.select("user_id", F.col("k").alias("j"), (F.col("k") * 3000).cast("long").alias("at_ms"), "text")
    n = F.col("event_id")
    whole = F.when(n % 5 == 0, F.regexp_replace("text", "[aeo]", "")).otherwise(F.col("text"))
    parts = F.when(n % 6 == 1, F.array(F.substring_index(whole, " ", 2), F.substring_index(whole, " ", -3))).otherwise(F.array(whole))
    o = e.where(n % 7 != 0).select("user_id", "k", "value", F.posexplode(parts).alias("part", "text"))
    o = o.withColumn("start_ms", (F.col("k") * 3000 + F.col("part") * 1400 + F.floor(F.col("value") * 9)).cast("long"))
    o = o.withColumn("i", (F.row_number().over(Window.partitionBy("user_id").orderBy("start_ms", "k", "part")) - 1).cast("int"))
    return sequences.aligned(o.select("user_id", "i", "start_ms", (F.col("start_ms") + 1300).alias("end_ms"), "text"), events, "user_id")


def i18_resegmented(spark, d):
    """The names of each order's parts as neighbouring cues; words of every third one have slipped to the next cue."""
    parts = table(ship(spark), d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", "p_brand").alias("seen"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").join(parts, "l_partkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    c = rows.withColumn("cue", (F.row_number().over(order) - 1).cast("int"))
    word = F.substring_index("seen", " ", -1)
    slips = (F.col("l_partkey") % 3 == 0) & F.lead("cue").over(order).isNotNull()
    c = c.withColumn("given", F.when(slips, word)).withColumn("got", F.lag("given").over(order))
    kept = F.when(slips, F.expr("substring(seen, 1, length(seen) - length(substring_index(seen, ' ', -1)) - 1)")).otherwise(F.col("seen"))
    start = (F.col("cue") * 3000).cast("long")
    c = c.select("l_orderkey", "cue", start.alias("start_ms"), (start + 2500).alias("end_ms"), F.concat_ws(" ", "got", kept).alias("text"), F.regexp_replace("seen", "[eo]", "a").alias("seen"), F.col("seen").alias("again"), F.when(F.col("l_quantity") > 25, 0.9).otherwise(0.3).alias("sure"), (F.col("l_partkey") % 11 == 0).alias("fixed"))
    return sequences.resegmented(c, "l_orderkey").select("l_orderkey", "cue", "text", "moved")


QUERIES = {"i16_reused_path": (i16_reused_path, None), "i18_resegmented": (i18_resegmented, None)}
