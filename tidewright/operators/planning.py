"""Plans over tasks: intervals of occurrences and of the transitions between them, repairs that respect trusted cues, and replayed decisions of reviewers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.intervals import first_after, last_before


def interval_plan(occurrences: DataFrame, mixes: DataFrame, margin: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """((task, occurrence, primary_start, primary_end, problem), (task, left, right, boundary, search_start, search_end)).

    occurrences: task, occurrence, ordinal, start (seconds); mixes: task, duration. An occurrence lasts until the next begins, the last one until the mix ends;
    a transition is searched around each boundary. `problem` says why a task can't be planned: the first of an equal ordinal, a start outside the mix,
    or before the one before it, an empty interval.
    """
    order = Window.partitionBy("task").orderBy("ordinal", "occurrence")
    o = occurrences.join(mixes, "task")
    ahead = lambda c: F.lead(c).over(order)
    problem = (
        F.when(F.count("*").over(Window.partitionBy("task", "ordinal")) > 1, "ordinal_not_unique")
        .when((F.col("start") < 0) | (F.col("start") >= F.col("duration")), "start_outside_mix")
        .when(F.lag("start").over(order) > F.col("start"), "starts_decrease")
        .when(F.coalesce(ahead("start"), F.col("duration")) <= F.col("start"), "empty_interval")
    )
    o = o.withColumn("problem", problem).withColumn("right", ahead("occurrence")).withColumn("boundary", ahead("start"))
    first = o.select("task", "occurrence", F.col("start").alias("primary_start"), F.coalesce("boundary", "duration").alias("primary_end"), "problem")
    edge = o.where("right IS NOT NULL")
    second = edge.select("task", F.col("occurrence").alias("left"), "right", "boundary", F.greatest(F.lit(0.0), F.col("boundary") - margin).alias("search_start"), F.least("duration", F.col("boundary") + margin).alias("search_end"))
    return first, second


def partial_repair(cues: DataFrame, trust: DataFrame, candidates: DataFrame) -> DataFrame:
    """(task, cue, mode, trust, action, reason, new_start_ms, new_end_ms) of every cue.

    cues: task, cue, start_ms, end_ms; trust: task, cue, status (trusted, untrusted, unknown); candidates: task, cue, status, reason, start_ms, end_ms. Trusted cues
    are preserved and lock what is beside them: the nearest ones on both sides are as-of values, not searches. Of proposals that follow each other and
    overlap, both are blocked. `mode` of a task: preserve if all its cues are trusted, hybrid if some are and the rest are untrusted, else rebuild.
    """
    c = candidates.select("task", "cue", F.col("status").alias("projection"), F.col("reason").alias("why"), F.col("start_ms").alias("new_start_ms"), F.col("end_ms").alias("new_end_ms"))
    d = cues.join(trust.select("task", "cue", F.col("status").alias("trust")), ["task", "cue"], "left").withColumn("trust", F.coalesce("trust", F.lit("unknown"))).join(c, ["task", "cue"], "left")
    locked = F.col("trust") == "trusted"
    d = last_before(d, ["task"], ["cue"], locked, F.col("end_ms"), "_left")
    d = first_after(d, ["task"], ["cue"], locked, F.col("start_ms"), "_right")
    steps = [
        (locked, "preserve", F.lit("explicitly_trusted_editor_timing_locked")),
        (F.col("trust") == "unknown", "review", F.lit("unknown_timing_trust_requires_review")),
        (F.col("projection").isNull(), "review", F.lit("untrusted_cue_has_no_source_to_mix_candidate")),
        (F.col("projection") != "projected", "block", F.coalesce(F.nullif("why", F.lit("")), F.lit("source_to_mix_projection_unavailable"))),
        (F.coalesce(F.col("new_start_ms") < F.col("_left"), F.lit(False)), "block", F.lit("candidate_crosses_locked_left_cue")),
        (F.coalesce(F.col("new_end_ms") > F.col("_right"), F.lit(False)), "block", F.lit("candidate_crosses_locked_right_cue")),
        (F.lit(True), "propose_repair", F.lit("candidate_respects_locked_neighbors")),
    ]
    action = reason = None
    for when, a, r in steps:
        action, reason = (F.when(when, a), F.when(when, r)) if action is None else (action.when(when, a), reason.when(when, r))
    d = d.withColumn("action", action).withColumn("reason", reason)
    proposed = F.col("action") == "propose_repair"
    d = last_before(d, ["task"], ["cue"], proposed, F.col("new_end_ms"), "_before")
    d = first_after(d, ["task"], ["cue"], proposed, F.col("new_start_ms"), "_after")
    clash = proposed & (F.coalesce(F.col("_before") > F.col("new_start_ms"), F.lit(False)) | F.coalesce(F.col("new_end_ms") > F.col("_after"), F.lit(False)))
    d = d.withColumn("reason", F.when(clash, "candidate_overlaps_another_repair_candidate").otherwise(F.col("reason"))).withColumn("action", F.when(clash, "block").otherwise(F.col("action")))
    whole = Window.partitionBy("task")
    n = lambda s: F.count_if(F.col("trust") == s).over(whole)
    mode = F.when(n("trusted") == F.count("*").over(whole), "preserve").when((n("trusted") > 0) & (n("untrusted") > 0) & (n("unknown") == 0), "hybrid").otherwise("rebuild")
    shown = lambda c: F.when(~locked, F.col(c)).alias(c)
    return d.select("task", "cue", mode.alias("mode"), "trust", "action", "reason", shown("new_start_ms"), shown("new_end_ms"))


def replayed(issues: DataFrame, decisions: DataFrame, allowed: DataFrame) -> DataFrame:
    """(task, issue, kind, action, outcome) of every issue and of every decision without one.

    issues: task, issue, kind; decisions: task, issue, action, rationale; allowed: kind, action, outcome. open: nobody has decided; refused: the kind doesn't allow the
    action, or no rationale is given; ambiguous: decided more than once, whatever is said; foreign: no such issue in the task.
    """
    d = decisions.withColumn("_n", F.count("*").over(Window.partitionBy("task", "issue"))).dropDuplicates(["task", "issue"])
    both = issues.withColumn("_known", F.lit(True)).join(d, ["task", "issue"], "full_outer").join(allowed, ["kind", "action"], "left")
    several = F.col("_n") > 1
    outcome = F.when(F.col("_known").isNull(), "foreign").when(F.col("_n").isNull(), "open").when(several, "ambiguous").when(F.col("outcome").isNull() | (F.trim(F.coalesce("rationale", F.lit(""))) == ""), "refused").otherwise(F.col("outcome"))
    return both.select("task", "issue", "kind", F.when(~F.coalesce(several, F.lit(False)), F.col("action")).alias("action"), outcome.alias("outcome"))
