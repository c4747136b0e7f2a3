"""Evidence of an editor's cues for lines, roles that repeated context proves, and trust that calibration allows.

Weights, gates and scopes are tables or arguments; every join is by key or by time bucket.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewright.functions import text as tx
from tidewright.operators.folds import by_merge
from tidewright.operators.intervals import overlap_join

#: How each language is compared, and the weights of its text and of its times.
WEIGHTS = {
    "en": ("direct_text", 0.85, 0.75), "zh": ("direct_text", 0.75, 0.70), "yue": ("timing_hint", 0.0, 0.25), "ko": ("phonetic_hint", 0.10, 0.30),
    "ja": ("phonetic_hint", 0.10, 0.30), "generic": ("timing_hint", 0.0, 0.20), "unknown": ("timing_hint", 0.0, 0.20), "und-han": ("timing_hint", 0.0, 0.20),
}
HAN = tx.re.compile("[一-鿿]")


def plain(text: str) -> str:
    return "".join(c for c in tx.fold(text) if c.isalnum())


def supported(want: str, got: str) -> float:
    """How well what was observed holds a text: the ratio, or covered subsequence and its F1, whichever is more."""
    if not want or not got:
        return 0.0
    n = tx.common_subsequence(want, got)
    return max(tx.ratio(want, got), 0.7 * n / len(want) + 0.3 * 2 * n / (len(want) + len(got)))


SUPPORT = ("direct", "phonetic", "text", "text_weight", "timing_weight")


def support(line: str, language: str, cue: str, weights: dict[str, tuple[str, float, float]] = WEIGHTS) -> tuple[float | None, float | None, float | None, float, float]:
    """SUPPORT of a cue for a line: each run of one language is compared as that language is, and counts by its letters."""
    sums = {"direct_text": [0.0, 0.0], "phonetic_hint": [0.0, 0.0], "text": [0.0, 0.0]}
    timing = total = 0.0
    for start, end, lang, _ in tx.spans(line, language):
        part = line[start:end]
        n = float(max(1, sum(c.isalnum() for c in part)))
        mode, text_weight, timing_weight = weights.get(lang, weights["generic"])
        score = None
        if mode == "direct_text":
            score = supported(plain(part), plain(cue))
        elif mode == "phonetic_hint" and not (lang == "ja" and HAN.search(tx.fold(part))):
            seen = "" if lang == "ja" and HAN.search(tx.fold(cue)) else tx.romanised(cue)
            sounds, seen = tx.romanised(part), seen or plain(cue)
            score = supported(sounds, seen) if sounds and seen else None
        if score is not None:
            for k, w in ((mode, 1.0), ("text", text_weight)):
                sums[k][0] += score * w * n
                sums[k][1] += w * n
        timing += timing_weight * n
        total += n
    mean = lambda k: sums[k][0] / sums[k][1] if sums[k][1] else None
    return mean("direct_text"), mean("phonetic_hint"), mean("text"), sums["text"][1] / total if total else 0.0, timing / total if total else 0.0


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in SUPPORT]))
def span_support(line: pd.Series, language: pd.Series, cue: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([support(a or "", k or "auto", b or "") for a, k, b in zip(line, language, cue, strict=True)], columns=list(SUPPORT)).astype("float64")


def near_cues(lines: DataFrame, cues: DataFrame, radius_ms: int, width: int = 60_000) -> DataFrame:
    """Each line (track, line, start_ms, end_ms, ...) with each cue (track, cue, start_ms, end_ms, ...) of its track at most `radius_ms` away, and `timing` in [0, 1].

    A line without an end, or with one that isn't after its start, lasts a millisecond.
    """
    end = F.greatest(F.coalesce("end_ms", F.col("start_ms") + 1), F.col("start_ms") + 1)
    a = lines.withColumn("l_end", end).withColumnRenamed("start_ms", "l_start").drop("end_ms")
    b = cues.withColumnRenamed("start_ms", "r_start").withColumnRenamed("end_ms", "r_end")
    d = overlap_join(a, b, ["track"], width, radius_ms, strict=False, dear=True)
    over = F.greatest(F.lit(0), F.least("l_end", "r_end") - F.greatest("l_start", "r_start"))
    hull = F.greatest("l_end", "r_end") - F.least("l_start", "r_start")
    apart = F.abs((F.col("l_start") + F.col("l_end")) / 2.0 - (F.col("r_start") + F.col("r_end")) / 2.0)
    close = F.greatest(F.lit(0.0), 1.0 - apart / radius_ms)
    return d.withColumn("timing", F.least(F.lit(1.0), F.greatest(F.when(hull > 0, over / hull).otherwise(0.0), 0.80 * close)))


def ranked(pairs: DataFrame, k: int = 3, more: tuple[str, ...] = ()) -> DataFrame:
    """(track, line, n_near, cue, rank, score, timing, margin, onset_ms, offset_ms): the k best cues of each line.

    pairs: near_cues with `text`, `text_weight`, `timing_weight`. The score weighs text, where there is one, against time. The margin of the best is over the second,
    or over nothing. `more` columns of the pairs come along. Spark cuts to k before it shuffles; only the count of a line's cues is made of all of them.
    """
    has = F.col("text").isNotNull() & (F.col("text_weight") > 0)
    weighted = F.col("timing") * F.col("timing_weight") + F.when(has, F.col("text") * F.col("text_weight")).otherwise(0.0)
    weight = F.col("timing_weight") + F.when(has, F.col("text_weight")).otherwise(0.0)
    p = pairs.select("track", "line", "cue", F.round(F.when(weight > 0, weighted / weight).otherwise(F.col("timing")), 6).alias("score"), F.round("timing", 6).alias("timing"), (F.col("r_start") - F.col("l_start")).alias("onset_ms"), (F.col("r_end") - F.col("l_end")).alias("offset_ms"), *more)
    order = Window.partitionBy("track", "line").orderBy(F.desc("score"), F.desc("timing"), "cue")
    best = p.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, 2))
    best = best.withColumn("second", F.lead("score").over(order)).where(F.col("rank") <= k)
    best = best.withColumn("margin", F.when(F.col("rank") == 1, F.round(F.col("score") - F.coalesce("second", F.lit(0.0)), 6))).drop("second")
    return best.join(p.groupBy("track", "line").agg(F.count("*").alias("n_near")), ["track", "line"])


def editor_evidence(lines: DataFrame, cues: DataFrame, radius_ms: int = 2500, k: int = 3) -> DataFrame:
    """`ranked` by the texts of lines (text, language) and cues (text), with direct and phonetic support; lines without a cue have one row of nulls."""
    pairs = near_cues(lines.withColumnRenamed("text", "line_text"), cues.withColumnRenamed("text", "cue_text"), radius_ms)
    pairs = pairs.withColumn("s", span_support("line_text", "language", "cue_text")).select("*", *[f"s.{c}" for c in SUPPORT])
    best = ranked(pairs.withColumn("direct", F.round("direct", 6)).withColumn("phonetic", F.round("phonetic", 6)), k, ("direct", "phonetic"))
    best = best.select(*[c for c in best.columns if c not in ("direct", "phonetic")], "direct", "phonetic")
    return lines.select("track", "line").join(by_merge(best), ["track", "line"], "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))


#: Labels of one name, of several, and a name in them.
NAME = r"[\x{3400}-\x{9fff}]{2,6}"
ONE_LABEL = rf"^({NAME})\s*[:：]$"
MEMBER = r"[\x{3400}-\x{9fff}A-Za-z0-9._+\-]{1,20}"
CAST_LABEL = rf"^({MEMBER}(?:[/、&+]{MEMBER})+)(?:\s*[（(](?:(?i)Rap|说唱|主唱|和声|合唱|独白)[）)])?\s*[:：]$"


def role_names(entries: DataFrame, least: int = 4, within_ms: int = 2000) -> DataFrame:
    """(song, name, proof) of the roles of each song. entries: song, ord, at_ms, text, meta (whether the text is a credit or the like).

    explicit: a member of a label of several names. inferred: a name that only labels by itself, twice or more, each time just before sung text, in
    a song where at least `least` explicit names label by themselves too. Names found in the first pass are joined back for the second.
    """
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    e = entries.select("song", "ord", "at_ms", text.alias("text"), "meta").where("text <> ''")
    cast = F.regexp_extract("text", CAST_LABEL, 1)
    explicit = e.where(cast != "").select("song", F.explode(F.split(cast, "[/、&+]")).alias("name")).where(F.col("name").rlike(f"^{NAME}$")).distinct()
    order = Window.partitionBy("song").orderBy(F.asc_nulls_last("at_ms"), "ord")
    e = e.withColumn("name", F.nullif(F.regexp_extract("text", ONE_LABEL, 1), F.lit("")))
    e = e.join(explicit.withColumn("known", F.lit(True)), ["song", "name"], "left")
    sung = ~F.coalesce("meta", F.lit(False)) & F.col("name").isNull()
    e = e.withColumn("next_ms", F.lead("at_ms").over(order)).withColumn("next_sung", F.lead(sung).over(order))
    gap = F.col("next_ms") - F.col("at_ms")
    fits = F.coalesce((gap > 0) & (gap <= within_ms) & F.col("next_sung"), F.lit(False))
    proved = e.where("known").groupBy("song").agg(F.count_distinct("name").alias("n")).where(F.col("n") >= least).select("song")
    alone = e.where("name IS NOT NULL AND known IS NULL").groupBy("song", "name").agg(F.count("*").alias("n"), F.count_if(fits).alias("n_fit")).where("n >= 2 AND n_fit = n")
    inferred = alone.join(proved, "song", "left_semi").select("song", "name", F.lit("inferred").alias("proof"))
    return explicit.select("song", "name", F.lit("explicit").alias("proof")).union(inferred)


SLACK = 1e-12


def gate_results(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """Each gate (candidate, split, scope, metric, kind, bound) with `passed`. metrics: candidate, split, scope, metric, baseline, value.

    floor: at least the bound; ceiling: at most; regression: no more than the bound below the baseline; improvement: at least the bound above it. A
    gate without its metric fails.
    """
    v, b, base = F.col("value"), F.col("bound"), F.col("baseline")
    ok = F.when(F.col("kind") == "floor", v + SLACK >= b).when(F.col("kind") == "ceiling", v <= b + SLACK).when(F.col("kind") == "regression", v + SLACK >= base - b).when(F.col("kind") == "improvement", v - base + SLACK >= b)
    keys = ["candidate", "split", "scope", "metric"]
    return gates.join(metrics, keys, "left").withColumn("passed", F.coalesce(ok, F.lit(False))).select(*keys, "kind", "passed")


def eligible_scopes(selections: DataFrame, evaluations: DataFrame, results: DataFrame) -> DataFrame:
    """(candidate, revision, scope) of language scopes in which a candidate may be trusted.

    selections: candidate, revision, dataset, calibration_truth, blind_truth; evaluations: candidate, revision, split, dataset, truth, isolated;
    results: gate_results. Both splits must have been evaluated at the selected revision, isolated, on the locked truth, and pass all their gates; of
    the blind split's scopes those count that begin with "language:".
    """
    want = F.when(F.col("split") == "calibration", F.col("calibration_truth")).when(F.col("split") == "blind", F.col("blind_truth"))
    fine = evaluations.join(selections, ["candidate", "revision", "dataset"]).where(F.col("isolated") & (F.col("truth") == want)).select("candidate", "revision", "split").distinct()
    passed = results.groupBy("candidate", "split").agg(F.bool_and("passed").alias("all")).where("all").select("candidate", "split")
    locked = fine.join(passed, ["candidate", "split"]).groupBy("candidate", "revision").agg(F.count_distinct("split").alias("n")).where("n = 2")
    scopes = results.where((F.col("split") == "blind") & F.col("scope").rlike("^language:.")).groupBy("candidate", "scope").agg(F.bool_and("passed").alias("all")).where("all")
    return locked.select("candidate", "revision").join(scopes.select("candidate", "scope"), "candidate").select("candidate", "revision", "scope")


def trusted(decisions: DataFrame, lines: DataFrame, scopes: DataFrame, human: DataFrame | None = None) -> DataFrame:
    """(task, cue, status, reason, source) of each decided cue: the decision where calibration covers it, unknown where not, and people's word over both.

    decisions: task, cue, candidate, revision, scope, status, reason; lines: task, cue, language, level; scopes: eligible_scopes; human: task, cue, status, reason.
    A cue that two decisions name, or whose decision names another language than its line, is invalid.
    """
    times = Window.partitionBy("task", "cue")
    bound = lines.groupBy("task", "cue").agg(F.count("*").alias("n_lines"), F.first("language").alias("language"), F.first("level").alias("level"))
    d = decisions.withColumn("_n", F.count("*").over(times)).join(bound, ["task", "cue"], "left").join(scopes.withColumn("_ok", F.lit(True)), ["candidate", "revision", "scope"], "left")
    steps: list[tuple[Column, Column | str, Column | str]] = [
        (F.col("_n") > 1, "invalid", "duplicate_decision"),
        (~F.col("status").isin("trusted", "untrusted", "unknown"), "invalid", "unknown_status"),
        (F.coalesce("n_lines", F.lit(0)) != 1, "unknown", "ambiguous_or_missing_p9_editor_binding"),
        (F.col("scope") != F.concat(F.lit("language:"), F.trim("language")), "invalid", "scope_does_not_match_language"),
        (F.col("_ok").isNull(), "unknown", "blind_gate_does_not_cover_language_scope"),
        ((F.col("level") == "CONFLICT") & (F.col("status") == "trusted"), "unknown", "p9_conflict_cannot_be_auto_trusted"),
    ]
    status, reason = F.col("status"), F.col("reason")
    for when, s, r in reversed(steps):
        status, reason = F.when(when, F.lit(s)).otherwise(status), F.when(when, F.lit(r)).otherwise(reason)
    own = d.select("task", "cue", status.alias("status"), reason.alias("reason"), F.lit("calibrated_policy").alias("source")).distinct()
    if human is None:
        return own
    said = human.select("task", "cue", "status", "reason", F.lit("human_review").alias("source"))
    return own.join(said, ["task", "cue"], "left_anti").union(said)
