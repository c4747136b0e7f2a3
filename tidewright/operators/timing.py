"""Timing repair of cue streams: graded observations, robust models of each source, a ladder of decisions, and guards.

Tables: `cues` (task, cue, start_ms, end_ms; cues of a task are numbered from 0 without gaps), `observations` (task, cue, source, line,
source_ms, grade, and optionally `inside`: a cue inside a line of which only the onset is known), `priors` (task, source, rate).
A source's observations within a task are one group (lines of one song); everything else is joins, windows and expressions.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators import folds


@dataclass(frozen=True)
class Policy:
    """The thresholds of the ladder, in milliseconds and ratios."""

    preserve_ms: int = 350
    repair_ms: int = 900
    limit_ms: int = 8000
    min_anchors: int = 4
    inlier_ms: int = 750
    residual_ms: int = 450
    inlier_share: float = 0.70
    least_gap_ms: int = 3000
    rates: tuple[float, float] = (0.5, 2.0)
    prior_drift: float = 0.03


def grade(one_to_one: Column, action: Column, score: Column, exact: Column, line_times: Column, cue_times: Column) -> Column:
    """A: exact, unchanged and unique on both sides; B: a strong match of a unique line; C: all else."""
    c = F.lit("C")
    return (
        F.when(~F.coalesce(one_to_one, F.lit(False)) | (action == "review"), c)
        .when(exact & (score >= 0.995) & (line_times == 1) & (cue_times == 1) & (action == "unchanged"), "A")
        .when((score >= 0.92) & (line_times == 1) & action.isin("unchanged", "replace"), "B")
        .otherwise(c)
    )


class Slopes:
    """The slopes between all pairs of a source's anchors that may tell its rate, sorted once; any anchors may be left out.

    Memory is that of the pairs, some 20 bytes for each: 10,000 anchors of one source take about 1 GB.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, p: Policy):
        self.x, self.y, self.p = x, y, p
        n, found = len(x), []
        for k in range(n - 1):
            dx, dy = x[k + 1 :] - x[k], y[k + 1 :] - y[k]
            ok = np.flatnonzero((dx >= p.least_gap_ms) & (dy > 0))
            s = dy[ok] / dx[ok]
            good = (s >= p.rates[0]) & (s <= p.rates[1])
            found.append((np.full(good.sum(), k, np.int32), (ok[good] + k + 1).astype(np.int32), s[good]))
        i, j, s = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))
        order = np.argsort(s, kind="stable")
        self.i, self.j, self.s = i[order], j[order], s[order]
        self.at = np.full((n, n), -1, np.int32)  # the place of each pair's slope
        self.at[self.i, self.j] = self.at[self.j, self.i] = np.arange(len(s), dtype=np.int32)

    def among(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slopes between the anchors used, sorted, and for each slope its place among them."""
        both = use[self.i] & use[self.j]
        return self.s[both], (np.cumsum(both) - 1).astype(np.int32)

    def rate(self, among: tuple[np.ndarray, np.ndarray], use: np.ndarray, without: np.ndarray) -> float | None:
        """The median slope between the anchors used but for some of them, whose slopes' places are skipped in the sorted rest."""
        s, place = among
        own = self.at[np.ix_(without, np.flatnonzero(use))]
        gone = np.sort(place[own[own >= 0]])
        gone = gone[np.diff(gone, prepend=-1) > 0]  # a pair of two that are left out counts once
        n = len(s) - len(gone)
        if not n:
            return None
        ahead = gone - np.arange(len(gone))  # how many of the rest come before each that is gone
        low, high = (k + int(np.searchsorted(ahead, k, "right")) for k in ((n - 1) // 2, n // 2))
        return float((s[low] + s[high]) / 2)


#: Pairs of anchors times models up to which all models of a source are found at once, by matrices.
AT_ONCE = 1 << 21


def pairs_of(x: np.ndarray, y: np.ndarray, p: Policy) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, slope) of the pairs of anchors that may tell the rate, sorted by slope."""
    i, j = np.triu_indices(len(x), 1)
    dx, dy = x[j] - x[i], y[j] - y[i]
    ok = np.flatnonzero((dx >= p.least_gap_ms) & (dy > 0))
    s = dy[ok] / dx[ok]
    good = (s >= p.rates[0]) & (s <= p.rates[1])
    ok, s = ok[good], s[good]
    order = np.argsort(s, kind="stable")
    return i[ok[order]], j[ok[order]], s[order]


def middles(values: np.ndarray, use: np.ndarray) -> np.ndarray:
    """The median of each row's values that are used; rows without any give infinity."""
    v = np.sort(np.where(use, values, np.inf), axis=1)
    n, rows = use.sum(1), np.arange(len(v))
    return (v[rows, np.maximum(n - 1, 0) // 2] + v[rows, np.minimum(n // 2, v.shape[1] - 1)]) / 2


def middle_slopes(s: np.ndarray, use: np.ndarray) -> np.ndarray:
    """The median of each row's slopes that are used, these being sorted; rows without any give NaN."""
    if not len(s):
        return np.full(len(use), np.nan)
    n, upto = use.sum(1), np.cumsum(use, axis=1)
    low, high = ((upto > k[:, None]).argmax(1) for k in ((n - 1) // 2, n // 2))
    return np.where(n > 0, (s[low] + s[high]) / 2, np.nan)


def models_at_once(x: np.ndarray, y: np.ndarray, prior: float | None, p: Policy, leave: list[int | None]) -> list[tuple[str, float, float]]:
    """What `models` gives, by one matrix with a row for each model."""
    m, n = len(leave), len(x)
    if prior is not None and not p.rates[0] <= prior <= p.rates[1]:
        return [("invalid_rate_prior", prior, 0.0) if n - (k is not None) >= p.min_anchors else ("insufficient_anchors", 1.0, 0.0) for k in leave]
    use = np.ones((m, n), bool)
    for row, k in enumerate(leave):
        if k is not None:
            use[row, k] = False
    enough = use.sum(1) >= p.min_anchors
    if not enough.any():
        return [("insufficient_anchors", 1.0, 0.0)] * m
    i, j, s = pairs_of(x, y, p)
    told = middle_slopes(s, use[:, i] & use[:, j])
    rate = told if prior is None else np.full(m, prior)
    known = ~np.isnan(rate)
    rate = np.where(known, rate, 1.0)
    rest = lambda r: y[None, :] - r[:, None] * x[None, :]
    away = lambda r, offset: np.abs(y[None, :] - (offset[:, None] + r[:, None] * x[None, :]))
    offset = middles(rest(rate), use)
    off = away(rate, offset)
    near = use & (off <= p.inlier_ms)
    if prior is None:
        better = middle_slopes(s, near[:, i] & near[:, j])
        again = (near.sum(1) >= p.min_anchors) & ~np.isnan(better)
        if again.any():
            rate = np.where(again, better, rate)
            offset = np.where(again, middles(rest(rate), near), offset)
            off = np.where(again[:, None], away(rate, offset), off)
            near = np.where(again[:, None], use & (off <= p.inlier_ms), near)
    unstable = (middles(off, use) > p.residual_ms) | (near.sum(1) / np.maximum(use.sum(1), 1) < p.inlier_share)
    conflict = np.zeros(m, bool) if prior is None else np.abs(told - prior) / prior > p.prior_drift  # never with NaN
    out: list[tuple[str, float, float]] = []
    for e, k, u, c, r, o in zip(enough.tolist(), known.tolist(), unstable.tolist(), conflict.tolist(), rate.tolist(), offset.tolist(), strict=True):
        status = "rate_prior_conflict" if c else "unstable" if u else "ready"
        out.append(("insufficient_anchors", 1.0, 0.0) if not e else ("insufficient_rate_evidence", 1.0, 0.0) if not k else (status, r, o))
    return out


def models(x: np.ndarray, y: np.ndarray, prior: float | None, policy: Policy, leave: list[int | None]) -> list[tuple[str, float, float]]:
    """(status, rate, offset) of the model over all anchors of a source but one (None: over all): source = offset + rate * mix.

    Without a prior the rate is found again among those near a first model; their union over all that are left out is sorted once.
    """
    if len(leave) * len(x) * (len(x) + 1) // 2 <= AT_ONCE:
        return models_at_once(x, y, prior, policy, leave)
    p, slopes, every = policy, Slopes(x, y, policy), np.ones(len(x), bool)
    whole = slopes.among(every)
    out: list[tuple[str, float, float]] = [("insufficient_anchors", 1.0, 0.0)] * len(leave)

    def placed(rate: float, among: np.ndarray) -> tuple[float, np.ndarray]:
        offset = float(np.median(y[among] - rate * x[among]))
        return offset, np.abs(y - (offset + rate * x))

    first: dict[int, tuple] = {}
    for k, gone in enumerate(leave):
        use = every.copy()
        if gone is not None:
            use[gone] = False
        if use.sum() < p.min_anchors:
            continue
        told = slopes.rate(whole, every, np.flatnonzero(~use))
        rate = told if prior is None else prior
        if prior is not None and not p.rates[0] <= prior <= p.rates[1]:
            out[k] = "invalid_rate_prior", prior, 0.0
        elif rate is None:
            out[k] = "insufficient_rate_evidence", 1.0, 0.0
        else:
            offset, off = placed(rate, use)
            first[k] = use, told, rate, offset, off, use & (off <= p.inlier_ms)
    close = np.zeros(len(x), bool)
    for *_, near in first.values():
        close |= near
    among = slopes.among(close) if prior is None else None
    for k, (use, told, rate, offset, off, near) in first.items():
        if among is not None and near.sum() >= p.min_anchors and (better := slopes.rate(among, close, np.flatnonzero(close & ~near))) is not None:
            rate = better
            offset, off = placed(rate, near)
            near = use & (off <= p.inlier_ms)
        status = "ready"
        if np.median(off[use]) > p.residual_ms or near.sum() / use.sum() < p.inlier_share:
            status = "unstable"
        if prior is not None and told is not None and abs(told - prior) / prior > p.prior_drift:
            status = "rate_prior_conflict"
        out[k] = status, rate, offset
    return out


def left_out_models(x: np.ndarray, y: np.ndarray, prior: float | None, policy: Policy = Policy()) -> tuple[tuple, list[tuple]]:
    """The model over all anchors of a source, and for each anchor the model without it (the whole one where that isn't ready)."""
    whole, *rest = models(x, y, prior, policy, [None, *range(len(x))])
    if whole[0] != "ready":
        return whole, [whole] * len(x)
    return whole, [r if r[0] == "ready" else whole for r in rest]


def source_models(observations: DataFrame, cues: DataFrame, priors: DataFrame | None = None, policy: Policy = Policy()) -> DataFrame:
    """(task, source, n_anchors, status, rate, offset) of every source with observations, over its A anchors: with an inlier refit, or at the prior's rate."""
    o = observations.join(cues.select("task", "cue", "start_ms"), ["task", "cue"])
    o = o.withColumn("prior", F.lit(None).cast("double")) if priors is None else o.join(priors.select("task", "source", F.col("rate").alias("prior")), ["task", "source"], "left")

    def run(cue: list, grade: list, start_ms: list, source_ms: list, prior: list) -> list[tuple]:
        a = [k for k, g in enumerate(grade) if g == "A"]
        x, y = (np.array([c[k] for k in a], np.float64) for c in (start_ms, source_ms))
        return [(len(a), *models(x, y, prior[0], policy, [None])[0])]

    return folds.by_sorted(o, ["task", "source"], ["cue"], ["cue", "grade", "start_ms", "source_ms", "prior"], run, "n_anchors int, status string, rate double, offset double")


def supports(cue: Sequence, line: Sequence, anchor: Sequence) -> tuple[list[int], list[int]]:
    """For each row, anchors before it and after it in both orders, counted in one walk each way over rows sorted by cue."""
    out = []
    for way in (1, -1):
        seen: list = []
        n, held = [0] * len(cue), []
        order = range(len(cue)) if way == 1 else range(len(cue) - 1, -1, -1)
        last = None
        for k in order:
            if cue[k] != last:
                for x in held:
                    insort(seen, x)
                last, held = cue[k], []
            n[k] = bisect_left(seen, way * line[k])
            if anchor[k]:
                held.append(way * line[k])
        out.append(n)
    return out[0], out[1]


def judged(observations: DataFrame, cues: DataFrame, priors: DataFrame | None = None, policy: Policy = Policy()) -> DataFrame:
    """Each observation with its source's model, the model that judges it (for an A anchor one without it), and A anchors on both sides.

    The A anchors of a source in a task meet in one task: their pairs are the group's memory.
    """
    o = observations.join(cues.select("task", "cue", "start_ms"), ["task", "cue"])
    o = o.withColumn("prior", F.lit(None).cast("double")) if priors is None else o.join(priors.select("task", "source", F.col("rate").alias("prior")), ["task", "source"], "left")

    def run(cue: list, line: list, grade: list, start_ms: list, source_ms: list, prior: list) -> list[tuple]:
        is_a = [g == "A" for g in grade]
        x, y = (np.array([v for v, a in zip(c, is_a, strict=True) if a], np.float64) for c in (start_ms, source_ms))
        whole, each = left_out_models(x, y, prior[0], policy)
        models = iter(each)
        left, right = supports(cue, line, is_a)
        return [(k, whole[0], *(next(models) if a else whole), n, m) for k, a, n, m in zip(cue, is_a, left, right, strict=True)]

    kind = dict(o.dtypes)["cue"]
    told = folds.by_sorted(o, ["task", "source"], ["cue", "line"], ["cue", "line", "grade", "start_ms", "source_ms", "prior"], run, f"cue {kind}, model_status string, judge_status string, rate double, offset double, n_left int, n_right int")
    return o.drop("start_ms").join(told, ["task", "cue", "source"])


def plan(cues: DataFrame, observations: DataFrame, priors: DataFrame | None = None, policy: Policy = Policy()) -> DataFrame:
    """One decision for each cue: preserve, repair or review, with its reason and, where there is one, the proposed interval.

    The ladder: cues without an observation, then those inside a line, then those whose model isn't ready; then by the distance from
    the model; a repair needs grade A, a ready model, support (two A anchors on both sides, or three on one at an edge and a known
    rate), a shift within the limit, and a place between its neighbours.
    """
    o = judged(observations, cues, priors, policy)
    if "inside" not in o.columns:
        o = o.withColumn("inside", F.lit(False))
    order = Window.partitionBy("task").orderBy("cue")
    c = cues.select("task", "cue", "start_ms", "end_ms", F.lag("start_ms").over(order).alias("_before"), F.lead("start_ms").over(order).alias("_next"), F.lead("end_ms").over(order).alias("_next_end"))
    d = c.join(o, ["task", "cue"], "left")
    new = F.rint((F.col("source_ms") - F.col("offset")) / F.col("rate")).cast("long")
    d = d.withColumn("_new", new).withColumn("_new_end", new + F.col("end_ms") - F.col("start_ms")).withColumn("_off", F.col("start_ms") - new)
    shift = F.abs("_off")
    edge = F.col("prior").isNotNull() & (((F.col("n_left") >= 3) & (F.col("n_right") == 0)) | ((F.col("n_right") >= 3) & (F.col("n_left") == 0)))
    supported = ((F.col("n_left") >= 2) & (F.col("n_right") >= 2)) | edge
    fits = (F.col("_new") >= 0) & (F.col("_new_end") > F.col("_new")) & F.coalesce(F.col("_new") > F.col("_before"), F.lit(True)) & F.coalesce((F.col("_new") < F.col("_next")) & (F.col("_new_end") < F.col("_next_end")), F.lit(True))
    steps = [
        (F.col("source").isNull(), "preserve", "no_unique_timed_canonical_mapping"),
        (F.coalesce("inside", F.lit(False)), "review", "segmentation_internal_boundary_unvalidated"),
        (F.col("model_status") != "ready", "preserve", "timing_model_not_ready"),
        (shift <= policy.preserve_ms, "preserve", "timing_matches_anchor_model"),
        (shift < policy.repair_ms, "preserve", "timing_deviation_below_repair_threshold"),
        (F.col("grade") != "A", "review", "non_A_identity_not_auto_repairable"),
        (~supported, "review", "insufficient_independent_neighbor_support"),
        (shift > policy.limit_ms, "review", "shift_exceeds_auto_limit"),
        (~fits, "review", "proposed_shift_breaks_timeline_structure"),
        (F.lit(True), "repair", "multi_evidence_timing_outlier"),
    ]
    action = reason = None
    for when, a, r in steps:
        action, reason = (F.when(when, a), F.when(when, r)) if action is None else (action.when(when, a), reason.when(when, r))
    judged_by = F.col("model_status").eqNullSafe("ready") & ~F.coalesce("inside", F.lit(False))
    far = judged_by & (shift > policy.preserve_ms)
    return d.select(
        "task", "cue", "source", "line", F.coalesce("grade", F.lit("C")).alias("grade"), action.alias("action"), reason.alias("reason"), "start_ms", "end_ms",
        F.when(far, F.col("_new")).alias("new_start_ms"), F.when(far, F.col("_new_end")).alias("new_end_ms"), F.when(judged_by, F.col("_off")).alias("residual_ms"),
        F.when(judged_by, F.col("judge_status")).otherwise(F.col("model_status")).alias("model_status"),
    )


def hardened(decisions: DataFrame) -> DataFrame:
    """Decisions after the guards: no repair may overlap a neighbour that it left alone before, what nothing validates goes to review.

    Then all repairs together: a repair beside a gap whose overlap they would make larger goes to review.
    """
    order = Window.partitionBy("task").orderBy("cue")
    d = decisions.withColumn("_before", F.lag("end_ms").over(order)).withColumn("_next", F.lead("start_ms").over(order))
    overlaps = F.coalesce((F.col("_before") <= F.col("start_ms")) & (F.col("_before") > F.col("new_start_ms")), F.lit(False)) | F.coalesce((F.col("end_ms") <= F.col("_next")) & (F.col("new_end_ms") > F.col("_next")), F.lit(False))
    repair, preserve = F.col("action") == "repair", F.col("action") == "preserve"
    open_ = F.col("reason").isin("timing_model_not_ready", "no_unique_timed_canonical_mapping")
    reason = (
        F.when(repair & overlaps, "proposed_shift_creates_new_overlap")
        .when(preserve & open_, F.concat(F.lit("unresolved_"), "reason"))
        .when(preserve & (F.col("grade") == "C"), "non_A_identity_not_validated")
    )
    d = d.withColumns({"action": F.when(reason.isNotNull(), "review").otherwise(F.col("action")), "reason": F.coalesce(reason, "reason")})
    moved = F.col("action") == "repair"
    d = d.withColumn("_a", F.when(moved, F.col("new_start_ms")).otherwise(F.col("start_ms"))).withColumn("_b", F.when(moved, F.col("new_end_ms")).otherwise(F.col("end_ms")))
    over = lambda end, start: F.greatest(F.lit(0), F.col(end) - F.lead(start).over(order))
    d = d.withColumn("_worse", F.coalesce(over("_b", "_a") > over("end_ms", "start_ms"), F.lit(False)))
    worse = moved & (F.col("_worse") | F.coalesce(F.lag("_worse").over(order), F.lit(False)))
    d = d.withColumn("_worse", worse)
    d = d.withColumn("action", F.when(F.col("_worse"), "review").otherwise(F.col("action"))).withColumn("reason", F.when(F.col("_worse"), "proposed_shift_increases_overlap").otherwise(F.col("reason")))
    return d.drop("_before", "_next", "_a", "_b", "_worse")


def repaired(decisions: DataFrame) -> DataFrame:
    """(task, cue, start_ms, end_ms) with the repairs made."""
    moved = F.col("action") == "repair"
    return decisions.select("task", "cue", F.when(moved, F.col("new_start_ms")).otherwise(F.col("start_ms")).alias("start_ms"), F.when(moved, F.col("new_end_ms")).otherwise(F.col("end_ms")).alias("end_ms"))
