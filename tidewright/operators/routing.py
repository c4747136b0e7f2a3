"""Which evidence is asked for again, how wide a window it gets, and what two kinds of evidence say together. All of it is expressions over one row of each side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Routing:
    """Below (or above) what a first pass is repeated."""

    support: float = 0.65
    logprob: float = -0.75
    no_speech: float = 0.60
    language: float = 0.65


def window(start: Column, end: Column, context_ms: int, least_ms: int) -> Column:
    """(left, right) of a cue with context on both sides, widened evenly to at least `least_ms`, and never before 0."""
    left, right = F.greatest(F.lit(0), start - context_ms), end + context_ms
    short = F.greatest(F.lit(0), F.lit(least_ms) - (right - left))
    grown = F.greatest(F.lit(0), left - F.floor(short / 2))
    wide = right + short - F.floor(short / 2)
    return F.struct(grown.cast("long").alias("left"), F.when((grown == 0) & (short > 0), F.greatest(wide, F.lit(least_ms))).otherwise(wide).cast("long").alias("right"))


def segment_quality(segments: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """(keys, n_segments, logprob, no_speech, complete) of segments (keys, logprob, no_speech): mean of the former, greatest of the latter, over those that have them.

    With `order` the mean is of a sum in that order, so that it is the same to the last bit however rows are dealt; a key's segments are held for that.
    """
    whole = F.bool_and(F.col("logprob").isNotNull() & F.col("no_speech").isNotNull())
    mean = F.avg("logprob")
    if order:
        own = F.array_sort(F.collect_list(F.when(F.col("logprob").isNotNull(), F.struct(*order, "logprob"))))
        mean = F.when(F.count("logprob") > 0, F.aggregate(own, F.lit(0.0), lambda s, x: s + x["logprob"]) / F.count("logprob"))
    return segments.groupBy(*keys).agg(F.count("*").alias("n_segments"), mean.alias("logprob"), F.max("no_speech").alias("no_speech"), whole.alias("complete"))


def route_reasons(jobs: DataFrame, evidence: DataFrame, quality: DataFrame, key: str, rules: Routing = Routing()) -> DataFrame:
    """Each job with `reasons`, sorted, why its first pass isn't enough; none if it is. evidence: key, support, language_probability; quality: segment_quality."""
    e = jobs.join(evidence.withColumn("_seen", F.lit(True)), key, "left").join(quality, key, "left")
    n = F.coalesce("n_segments", F.lit(0))
    when = [
        (F.col("support") < rules.support, "low_canonical_text_support"),
        (F.col("support").isNull(), "missing_canonical_text_support"),
        (F.col("language_probability") < rules.language, "low_language_probability"),
        (n == 0, "missing_segments"),
        ((n > 0) & ~F.col("complete"), "missing_segment_quality"),
        ((n > 0) & (F.col("logprob") < rules.logprob), "low_avg_logprob"),
        ((n > 0) & (F.col("no_speech") > rules.no_speech), "high_no_speech_probability"),
    ]
    found = F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in when])))
    return e.select(*jobs.columns, F.when(F.col("_seen").isNull(), F.array(F.lit("missing_first_pass_evidence"))).otherwise(found).alias("reasons"))


@dataclass(frozen=True)
class Fusion:
    """Fixed values of decision fusion, in milliseconds and as a score."""

    supports_ms: int = 150
    actionable_ms: int = 900
    agree_ms: int = 750
    anomaly_ms: int = 1000
    text: float = 0.72


def fused(jobs: DataFrame, timing: DataFrame, texts: DataFrame, acoustic: DataFrame, speech: DataFrame, rules: Fusion = Fusion()) -> DataFrame:
    """(job, cue, timing_state, text_state, rank, priority, missing) of each job, from what is known of its cue and of itself.

    jobs: job, cue, line, wants (kinds of evidence); timing: cue, action, shift_ms; texts: cue, action, reason, line; acoustic: job, shift_ms, gate (whether it may speak on
    timing); speech: job, support. What isn't there says nothing. Timing states are told apart by the two shifts, text states by support and by whether the occurrence
    is the planned one; text that only agreement of correlated evidence supports ranks high, since it settles an open occurrence.
    """
    t = timing.select("cue", F.col("action").alias("t_action"), F.col("shift_ms").alias("ours"))
    x = texts.select("cue", F.col("action").alias("x_action"), F.col("reason").alias("x_reason"), F.col("line").alias("x_line"))
    a = acoustic.select("job", F.col("shift_ms").alias("heard"), F.coalesce("gate", F.lit(False)).alias("gate"), F.lit(True).alias("has_acoustic"))
    s = speech.select("job", "support", F.lit(True).alias("has_speech"))
    j = jobs.join(t, "cue", "left").join(x, "cue", "left").join(a, "job", "left").join(s, "job", "left")
    speaks = F.coalesce("gate", F.lit(False)) & F.col("heard").isNotNull()
    ours, heard = F.abs("ours"), F.abs("heard")
    alone = F.when(~speaks, "unvalidated_no_actionable_evidence").when(heard >= rules.anomaly_ms, "pro_detected_anomaly").when(heard <= rules.supports_ms, "editor_supported_by_acoustic").otherwise("unvalidated_acoustic_observation")
    agree = ((F.col("ours") > 0) == (F.col("heard") > 0)) & (F.abs(F.col("ours") - F.col("heard")) <= rules.agree_ms)
    both = (
        F.when(~speaks, "smart_candidate_unverified")
        .when((ours < rules.actionable_ms) & (heard >= rules.anomaly_ms), "smart_pro_conflict")
        .when(ours < rules.actionable_ms, "editor_within_display_tolerance")
        .when(agree, "smart_candidate_supported")
        .when(heard < rules.actionable_ms, "smart_candidate_rebutted")
        .otherwise("smart_pro_conflict")
    )
    asked = F.coalesce(F.col("t_action") == "review", F.lit(False))
    j = j.withColumn("timing_state", F.when(~asked, "not_requested").when(F.col("ours").isNull(), alone).otherwise(both))
    crossed = F.col("x_reason") == "preceding_canonical_anchor_confirms_cross_script_vocalization"
    planned = F.coalesce(F.col("x_line") == F.col("line"), F.lit(False))
    j = j.withColumn(
        "text_state",
        F.when(crossed, "cross_script_vocalization_resolved_by_smart")
        .when(~F.coalesce(F.col("x_action") == "review", F.lit(False)), "resolved_by_smart")
        .when(F.col("support") >= rules.text, "canonical_text_supported")
        .when(planned & F.coalesce("gate", F.lit(False)) & (F.col("timing_state") == "smart_candidate_supported"), "canonical_occurrence_supported_by_acoustic")
        .when(F.col("support").isNotNull(), "text_review_asr_insufficient")
        .otherwise("text_review_unvalidated"),
    )
    state, text = F.col("timing_state"), F.col("text_state")
    settles = text.isin("canonical_occurrence_supported_by_acoustic", "cross_script_vocalization_resolved_by_smart")
    rank = (
        F.when((state == "smart_candidate_supported") & settles, 3)
        .when(state.isin("pro_detected_anomaly", "smart_candidate_supported", "smart_pro_conflict") | text.isin("canonical_text_supported", "canonical_occurrence_supported_by_acoustic"), 2)
        .when(state == "smart_candidate_rebutted", 1)
        .otherwise(0)
    )
    names = F.array(*map(F.lit, ("none", "diagnostic", "medium", "high")))
    lacks = F.array_compact(F.array(*[F.when(F.array_contains("wants", k) & F.col(h).isNull(), F.lit(k)) for k, h in (("acoustic", "has_acoustic"), ("speech", "has_speech"))]))
    return j.withColumn("rank", rank).select("job", "cue", "timing_state", "text_state", "rank", F.element_at(names, F.col("rank") + 1).alias("priority"), lacks.alias("missing"))
