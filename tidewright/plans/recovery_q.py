"""Recovery of reviews over the events of each user: a line for each event, a cue for one or two of them, some under review."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.operators import coverage, folds, ownership, recovery, settled, tempo
from tidewright.sources.code import ship
from tidewright.sources.shared import written
from tidewright.sources.tables import events_us, table


def tables(spark, d):
    """(cues, lines, decisions): sources of 14 lines at a rate of 1.1; some lines share the cue of the one before, some cues drift, every fifth is under review."""
    e = events_us(ship(spark), d).select("user_id", "event_id", "event_type", "value", "t_us")
    order = Window.partitionBy("user_id").orderBy("t_us", "event_id")
    e = e.withColumn("k", F.row_number().over(order) - 1).withColumn("source", F.floor(F.col("k") / 14).cast("int"))
    text = F.concat_ws(" ", "event_type", F.format_string("%x", F.col("event_id")), F.floor("value"))
    key = F.regexp_replace(text, " ", "")
    lines = e.select(F.col("user_id").alias("task"), "source", F.col("k").cast("long").alias("line"), (F.col("k") % 14 * 4400 + 9000).cast("long").alias("at_ms"), key.alias("key"), text.alias("text"))
    joined = (F.col("event_id") % 9 == 4) & (F.col("k") % 14 != 0)
    c = e.withColumn("cue", F.count_if(~joined).over(order) - 1).withColumn("at", F.col("k") * 4000 + F.floor(F.col("value") * 7) % 300 + F.when(F.col("value") > 95, 2000).otherwise(0))
    c = c.groupBy("user_id", "cue").agg(F.min("k").alias("k"), F.count("*").cast("int").alias("n"), F.min(F.struct("k", "at", "event_id")).alias("head"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", text.alias("t")))), lambda x: x["t"]), " ").alias("text"))
    weak = F.col("head.event_id") % 5 == 0
    wrong = F.when(weak & (F.col("head.event_id") % 3 == 0), F.regexp_replace("text", "[aeiou]", "x")).otherwise(F.col("text"))
    cues = c.select(F.col("user_id").alias("task"), F.col("cue").cast("int").alias("cue"), F.col("head.at").alias("start_ms"), (F.col("head.at") + 3500 * F.col("n")).alias("end_ms"), F.regexp_replace(wrong, " ", "").alias("key"), wrong.alias("text"))
    score = F.when(weak, 0.55).when(F.col("n") > 1, 0.8).otherwise(1.0)
    claim = ~weak | (F.col("head.event_id") % 4 == 1)
    decisions = c.select(
        F.col("user_id").alias("task"), F.col("cue").cast("int").alias("cue"), F.when(weak, "review").otherwise("unchanged").alias("action"), F.when(weak, "low_score").otherwise("matched").alias("reason"),
        score.alias("score"), F.when(claim, F.col("k")).cast("long").alias("line"), F.when(claim, F.col("n")).alias("n_lines"),
    )
    return written(cues, "cues"), written(lines, "lines"), written(decisions, "decisions")


def i9_sequence_recovery(spark, d):
    """Reviews between and beyond sure cues, by the projection of each source."""
    return recovery.sequence_recovered(*tables(spark, d))


def i8_timing_recovery(spark, d):
    """Reviews between anchors that a ready model confirms; the model is the projection of each source."""
    cues, lines, decisions = tables(spark, d)
    models = recovery.projections(recovery.text_anchors(cues, lines, decisions), lines)
    return recovery.timing_recovered(cues, lines, decisions, models)


def i9_projections(spark, d):
    """The projection of each source from its sure cues."""
    cues, lines, decisions = tables(spark, d)
    return recovery.projections(recovery.text_anchors(cues, lines, decisions), lines)


def i13_ownership_guard(spark, d):
    """The recovered decisions after a slip: the last word of every fourth recovered cue went to the next one, or is in both."""
    cues, lines, decisions = tables(spark, d)
    done = recovery.sequence_recovered(cues, lines, decisions)
    order = Window.partitionBy("task").orderBy("cue")
    now = done.join(folds.by_merge(cues.select("task", "cue", F.col("text").alias("was"))), ["task", "cue"]).withColumn("now", F.coalesce("text", "was"))
    word = F.substring_index("now", " ", -1)
    slips = (F.col("cue") % 4 == 1) & (F.length(word) < F.length("now"))
    now = now.withColumn("given", F.when(slips, word)).withColumn("got", F.lag("given").over(order))
    kept = F.when(slips & (F.col("cue") % 8 == 1), F.expr("substring(now, 1, length(now) - length(substring_index(now, ' ', -1)) - 1)")).otherwise(F.col("now"))
    slipped = now.withColumn("text", F.concat_ws(" ", "got", kept)).withColumn("action", F.when(F.col("text") != F.col("was"), "replace").otherwise(F.col("action")))
    return ownership.ownership_restored(cues, slipped)


def _coverage(spark, d):
    """Events of a user as lines with an index, and as rows that carry their index, the next one too, or a stale one."""
    e = events_us(ship(spark), d).withColumn("k", (F.row_number().over(Window.partitionBy("user_id").orderBy("t_us", "event_id")) - 1).cast("int"))
    text = F.concat_ws(" ", "event_type", F.format_string("%d", F.col("event_id") % 100), F.floor("value"), F.lit("of the day"))
    events = e.select(F.col("user_id").alias("track"), F.col("event_id").alias("event"), F.col("k").alias("idx"), (F.col("k") * 4000).cast("long").alias("at_ms"), text.alias("text"))
    n = F.col("event_id")
    idx = F.when(n % 7 == 0, F.array(F.col("k") + 5)).when(n % 3 == 0, F.array("k", F.col("k") + 1)).when(n % 5 == 0, F.array().cast("array<int>")).otherwise(F.array("k"))
    start = F.col("k") * 4000 + F.floor(F.col("value") * 50).cast("long")
    said = F.when(n % 4 == 0, F.regexp_replace(text, "[aeo]", "")).when(n % 6 == 1, F.substring_index(text, " ", 2)).otherwise(text)
    rows = e.select(F.col("user_id").alias("track"), n.alias("row"), start.alias("start_ms"), (start + 1500).alias("end_ms"), idx.alias("indices"), said.alias("text"))
    return events, rows


def c26_coverage_join(spark, d):
    return coverage.coverage_pairs(*_coverage(spark, d))


C26 = """
WITH e AS (SELECT user_id AS track, event_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS k FROM events),
r AS (SELECT track, event_id AS row, k * 4000 + CAST(floor(value * 50) AS BIGINT) AS start_ms,
             CASE WHEN event_id % 7 = 0 THEN [k + 5] WHEN event_id % 3 = 0 THEN [k, k + 1] WHEN event_id % 5 = 0 THEN [] ELSE [k] END AS idx FROM e)
SELECT e.track, e.event_id AS event, r.row, list_contains(r.idx, e.k) AS linked, (r.start_ms + 1500 >= e.k * 4000 - 3000 AND r.start_ms <= e.k * 4000 + 3000) AS near
FROM e JOIN r ON r.track = e.track AND (list_contains(r.idx, e.k) OR (r.start_ms + 1500 >= e.k * 4000 - 3000 AND r.start_ms <= e.k * 4000 + 3000))
"""


def c26_coverage(spark, d):
    """Whether each event's line is covered, by index and by time."""
    return coverage.coverage(*_coverage(spark, d))


def c22_best_run(spark, d):
    """The run of words of each benchmark text that is likest to the first six words of the turn with its number."""
    said = table(ship(spark), d, "conversations").select((F.col("conv_id") % 50).alias("k"), "conv_id", "turn", F.array_join(F.slice(F.split("text", r"\s+"), 1, 6), " ").alias("said"))
    lines = table(spark, d, "benchmark").where("text IS NOT NULL").select((F.col("item_id") % 50).alias("k"), "item_id", "text")
    pairs = said.where("said IS NOT NULL").join(lines, "k")
    schema = "conv_id long, turn long, item_id long, run string, score double, coverage double, mode string"
    return recovery.each_row(recovery.spread(pairs.select("conv_id", "turn", "item_id", "said", "text")), lambda r: [(r["conv_id"], r["turn"], r["item_id"], *coverage.best_run(r["said"], r["text"]))], schema)


def i10_tempo_recovery(spark, d):
    """Reviews at the rate that each source's tempo gives, which is 1.1 for all but every third."""
    cues, lines, decisions = tables(spark, d)
    decisions = decisions.withColumn("reason", F.when(F.col("reason") == "matched", tempo.SAFE[0]).otherwise(F.col("reason"))).withColumn("text", F.lit(None).cast("string"))
    priors = lines.select("task", "source").distinct().select("task", "source", F.when(F.col("source") % 3 == 2, 1.3).otherwise(1.1).alias("rate"))
    return tempo.tempo_recovered(cues, lines, decisions, priors)


def i11_bounded_regions(spark, d):
    """Runs of reviews whose claims fill the gap between resolved neighbours, bracketed by anchors of the sources' own projections."""
    cues, lines, decisions = tables(spark, d)
    claims = decisions.withColumn("line", F.coalesce("line", F.lit(-1))).where("line >= 0")
    anchors = recovery.text_anchors(cues, lines, decisions)
    ready = recovery.projections(anchors, lines).select("task", "source", "status", "rate", "offset")
    placed = recovery.positioned(lines).select("task", "source", "pos", "line")
    timing = anchors.join(folds.by_merge(ready), ["task", "source"]).join(folds.by_merge(placed), ["task", "source", "pos"])
    timing = timing.select("task", "cue", "source", "line", "grade", F.col("status").alias("model_status"), (F.col("start_ms") - recovery.mix_ms("at_ms")).cast("double").alias("residual_ms"))
    return settled.bounded_recovered(cues, lines, claims, timing)


def i12_final_recovery(spark, d):
    """Reviews that are their line but for one character, or its end after a cue that has its beginning."""
    cues, lines, decisions = tables(spark, d)
    n = F.length("key")
    wrong = F.when((F.col("cue") % 2 == 0) & (n > 8), F.concat(F.expr("left(key, 3)"), F.lit("q"), F.expr("substring(key, 5)"))).otherwise(F.col("key"))
    said = cues.withColumn("key", wrong).withColumn("text", F.when(wrong != F.col("key"), wrong).otherwise(F.col("text")))
    return settled.final_recovered(said, lines, decisions)


QUERIES = {"i8_timing_recovery": (i8_timing_recovery, None), "i9_sequence_recovery": (i9_sequence_recovery, None), "i9_projections": (i9_projections, None),
           "i13_ownership_guard": (i13_ownership_guard, None), "i11_bounded_regions": (i11_bounded_regions, None), "i12_final_recovery": (i12_final_recovery, None), "i10_tempo_recovery": (i10_tempo_recovery, None), "c22_best_run": (c22_best_run, None), "c26_coverage_join": (c26_coverage_join, C26), "c26_coverage": (c26_coverage, None)}
