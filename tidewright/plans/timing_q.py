"""Repairs: of timing over the events of each user, taken as cues of a task; of text over the lines of each order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.operators import repair, timing
from tidewright.sources.code import ship
from tidewright.sources.tables import events_us, table


def _tables(spark, d):
    """Cues in order of time, four seconds apart, drifting by their value; each tells a line of its type's source at a known time."""
    order = Window.partitionBy("user_id").orderBy("t_us", "event_id")
    e = events_us(ship(spark), d).select("user_id", "event_id", "event_type", "value", "t_us").withColumn("cue", F.row_number().over(order) - 1)
    at = F.col("cue") * 4000 + F.when(F.col("value") > 60, 1500).when(F.col("value") > 40, -2600).otherwise(0) + F.floor(F.col("value") * 7) % 300
    cues = e.select(F.col("user_id").alias("task"), "cue", at.cast("long").alias("start_ms"), (at + 2500 + F.floor("value") % 20 * 100).cast("long").alias("end_ms"))
    source = F.when(F.col("event_type").isin("view", "click", "purchase"), 1).when(F.col("event_type") == "signup", 2)
    grade = F.when(F.col("event_type") == "click", "B").when(F.col("event_type") == "signup", "C").otherwise("A")
    obs = e.select(F.col("user_id").alias("task"), "cue", source.alias("source"), F.col("cue").alias("line"), (F.col("cue") * 4400 + 9000).cast("long").alias("source_ms"), grade.alias("grade")).where("source is not null")
    return cues, obs


def i6_timing_ladder(spark, d):
    return timing.plan(*_tables(spark, d))


def i7_hardened_plan(spark, d):
    return timing.hardened(timing.plan(*_tables(spark, d)))


def i5_source_models(spark, d):
    """The robust model of each source, from its A anchors; every third task knows its rate."""
    cues, obs = _tables(spark, d)
    priors = obs.where("task % 3 = 0").select("task", "source").distinct().withColumn("rate", F.lit(1.1))
    return timing.source_models(obs, cues, priors)


def i4_observation_grades(spark, d):
    """Each recovered table's claims of one line, graded: exact and unique on both sides, strong, or neither."""
    from tidewright.plans.recovery_q import tables

    cues, lines, decisions = tables(spark, d)
    s = cues.join(decisions, ["task", "cue"]).where("line IS NOT NULL")
    k = lines.withColumn("line_times", F.count("*").over(Window.partitionBy("task", "source", "key"))).select("task", "line", "source", F.col("key").alias("line_key"), "line_times")
    s = s.join(k, ["task", "line"]).withColumn("cue_times", F.count("*").over(Window.partitionBy("task", "source", "key")))
    grade = timing.grade(F.col("n_lines") == 1, F.col("action"), F.col("score"), F.col("key") == F.col("line_key"), F.col("line_times"), F.col("cue_times"))
    return s.select("task", "cue", "source", "line", grade.alias("grade"))


def i3_repair_plan(spark, d):
    """Each order's lines, some misspelt, against the names of their parts."""
    parts = table(ship(spark), d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("line"))
    rows = table(spark, d, "lineitem").join(parts, "l_partkey").select("l_orderkey", "l_linenumber", "l_quantity", "line")
    n = F.col("l_quantity").cast("int")
    misspelt = F.when(n % 5 == 0, F.regexp_replace("line", "e", "a")).when(n % 5 == 1, F.concat("line", F.lit("!"))).when(n % 7 == 0, F.reverse("line")).otherwise(F.col("line"))
    cues = rows.where(n % 11 != 0).select("l_orderkey", "l_linenumber", F.lit(True).alias("is_cue"), misspelt.alias("line"))
    return repair.repair_plan(cues.union(rows.select("l_orderkey", "l_linenumber", F.lit(False), "line")), "l_orderkey", "is_cue", ["l_linenumber", "line"], "line")


QUERIES = {"i4_observation_grades": (i4_observation_grades, None), "i5_source_models": (i5_source_models, None), "i3_repair_plan": (i3_repair_plan, None), "i6_timing_ladder": (i6_timing_ladder, None), "i7_hardened_plan": (i7_hardened_plan, None)}
