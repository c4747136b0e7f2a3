"""Evaluation of predicted cues and cuts against the truth, by case and by scope."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from itertools import pairwise
from math import inf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import matching
from tidewright.functions import text as tx
from tidewright.operators import lattices
from tidewright.operators.folds import by_blocks, nearest_pairs
from tidewright.operators.intervals import overlap_join
from tidewright.operators.sequences import said_score


def cut_errors(cuts: DataFrame, cases: DataFrame) -> DataFrame:
    """(case, error) of cuts matched one to one within a case's tolerance, the nearest first. cuts: case, expected, at_ms; cases: case, tolerance_ms.

    A case's cuts are one group: those of one file.
    """
    rows = cuts.join(cases.select("case", "tolerance_ms"), "case")

    def run(t: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.sort(t.at_ms[t.expected == x].to_numpy(np.float64)) for x in (True, False))
        pairs = nearest_pairs(a, b, float(t.tolerance_ms.iloc[0]))
        return pd.DataFrame({"case": t.case.iloc[0], "error": [abs(a[i] - b[j]) for i, j in pairs]})

    return rows.groupBy("case").applyInPandas(run, f"case {dict(cases.dtypes)['case']}, error double")


def cut_metrics(cases: DataFrame, errors: DataFrame) -> DataFrame:
    """Boundary metrics of each scope: overall and every language.

    cases: case, language, timed (it has timed cuts), legacy (it has ids of cuts only); errors: case, error of timed cases. Percentiles are exact, from counts
    of distinct errors that are summed before they meet.
    """
    scope = F.explode(F.array(F.lit("overall"), F.concat(F.lit("language:"), F.coalesce(F.nullif("language", F.lit("")), F.lit("unknown"))))).alias("scope")
    by_scope = cases.select(scope, "timed", "legacy").groupBy("scope").agg(F.count_if("timed").alias("timed_cases"), F.count_if(F.col("legacy") & ~F.col("timed")).alias("legacy_cases"))
    e = errors.join(cases.where("timed").select("case", "language"), "case").select(scope, "error")
    share = lambda ms: F.coalesce(F.round(F.avg((F.col("error") <= ms).cast("double")), 6), F.lit(0.0))
    at = lambda q: F.round(F.percentile("error", F.lit(q)), 3)
    m = e.groupBy("scope").agg(F.count("*").alias("n_matched"), F.round(F.avg("error"), 3).alias("mae_ms"), at(0.5).alias("p50_ms"), at(0.9).alias("p90_ms"), at(0.95).alias("p95_ms"), share(250).alias("within_250"), share(500).alias("within_500"))
    return by_scope.join(m, "scope", "left").na.fill(0)


@lru_cache(1 << 12)
def counted(text: str) -> dict[str, int]:
    return dict(Counter(text))


def group_alignment(reference: list[tuple[int, int, str]], predicted: list[tuple[int, int, str]], most: int = 3) -> list[tuple[int, int, int, int]]:
    """(i, i2, j, j2) of groups of up to `most` cues (start, end, text) on either side that belong together, at the least cost in order.

    A cue without a partner costs 1; a group 1.55 for unlike texts, 0.35 for unlike times, and 0.08 for each cue beyond two. Texts are compared only where
    the bound on their likeness by letters leaves a chance.
    """
    n, m = len(reference), len(predicted)
    joined = lambda rows, a, b: " ".join(r[2] for r in rows[a:b])
    group = lambda rows: {(i, k): (t := joined(rows, i, i + k), counted(t), min(r[0] for r in rows[i : i + k]), max(r[1] for r in rows[i : i + k])) for i in range(len(rows)) for k in range(1, min(most, len(rows) - i) + 1)}
    left, right = group(reference), group(predicted)
    cost = [[inf] * (m + 1) for _ in range(n + 1)]
    back: dict[tuple[int, int], tuple[int, int]] = {}
    cost[0][0] = 0.0

    def step(i: int, j: int, k: int, h: int, value: float) -> None:
        if value < cost[i + k][j + h]:
            cost[i + k][j + h] = value
            back[i + k, j + h] = k, h

    def apart(i: int, j: int, k: int, h: int) -> float:
        """What a group costs beside the likeness of its texts."""
        (_, _, a0, a1), (_, _, b0, b1) = left[i, k], right[j, h]
        hull = max(a1, b1) - min(a0, b0)
        return 0.35 * (1 - (max(0, min(a1, b1) - max(a0, b0)) / hull if hull else 0.0)) + 0.08 * (k + h - 2)

    for i in range(n + 1):
        for j in range(m + 1):
            base = cost[i][j]
            if i < n:
                step(i, j, 1, 0, base + 1.0)
            if j < m:
                step(i, j, 0, 1, base + 1.0)
            for k in range(1, min(most, n - i) + 1):
                a, na, *_ = left[i, k]
                for h in range(1, min(most, m - j) + 1):
                    b, nb, *_ = right[j, h]
                    rest = apart(i, j, k, h)
                    size, now = len(a) + len(b), cost[i + k][j + h]
                    # First by lengths, which costs nothing, then by letters.
                    if base + 1.55 * (1 - (2 * min(len(a), len(b)) / size if size else 1.0)) + rest >= now:
                        continue
                    bound = 2 * sum(min(c, nb[x]) for x, c in na.items() if x in nb) / size if size else 1.0
                    if base + 1.55 * (1 - bound) + rest < now:
                        step(i, j, k, h, base + 1.55 * (1 - tx.often(a, b)) + rest)
    out, i, j = [], n, m
    while i or j:
        k, h = back[i, j]
        if k and h:
            out.append((i - k, i, j - h, j))
        i, j = i - k, j - h
    return out[::-1]


#: Cues of a side, and characters of joined texts, up to which groups are aligned many at a time.
CUES, LETTERS = 16, 255


def group_alignments(groups: list[tuple[list, list]], most: int = 3) -> list[list[tuple[int, int, int, int]]]:
    """`group_alignment` of each (reference, predicted). Small ones are aligned side by side."""
    small = lambda rows: 0 < len(rows) <= CUES and most * (max(len(r[2]) for r in rows) + 1) <= LETTERS
    sizes = {g: (len(a), len(b)) for g, (a, b) in enumerate(groups) if small(a) and small(b)}
    out: list = [None] * len(groups)
    for n, m, own in lattices.shaped(sizes, most):
        for g, got in zip(own, side_by_side([groups[g] for g in own], n, m, most), strict=True):
            out[g] = got
    return [group_alignment(*groups[g], most) if x is None else x for g, x in enumerate(out)]


def side_by_side(groups: list[tuple[list, list]], n: int, m: int, most: int) -> list[list[tuple[int, int, int, int]]]:
    """The alignments of groups of up to n and m cues."""
    ends = np.array([[len(s) for s in g] for g in groups]).T
    steps = lattices.moves(n, m, most, n + m)
    shape = (len(steps), len(groups))
    low, rest = np.ones(shape), np.zeros(shape)
    side = []
    for s, size in enumerate((n, m)):
        rows = [r for g in groups for r in (*g[s], *[(0, 0, "")] * (size - len(g[s])))]
        start, end = (np.array([r[c] for r in rows]).reshape(-1, size).T for c in (0, 1))
        length = np.array([len(r[2]) for r in rows]).reshape(-1, size).T
        letters = lattices.spans(lattices.counts([r[2] for r in rows], size), most, ord(" ") % lattices.CLASSES)
        number = {ip: k for k, ip in enumerate(letters)}
        of = lambda fn: np.array([fn(i, p) for i, p in letters])  # noqa: E731, B023
        side.append((number, of(lambda i, p: start[i:p].min(axis=0)), of(lambda i, p: end[i:p].max(axis=0)), of(lambda i, p: length[i:p].sum(axis=0) + p - i - 1), np.array(list(letters.values()))))  # noqa: B023
    is_span = lattices.spanning(steps)
    u, v = (np.array([side[s][0][x, y] for x, y in steps[is_span][:, [s, s + 2]].tolist()]) for s in (0, 1))
    (_, a0, a1, na, a), (_, b0, b1, nb, b) = side
    hull, over = np.maximum(a1[u], b1[v]) - np.minimum(a0[u], b0[v]), np.maximum(0, np.minimum(a1[u], b1[v]) - np.maximum(a0[u], b0[v]))
    taken = (steps[is_span][:, 2:] - steps[is_span][:, :2]).sum(axis=1)[:, None]
    rest[is_span] = 0.35 * (1 - np.where(hull != 0, over / np.where(hull != 0, hull, 1), 0.0)) + 0.08 * (taken - 2)
    size = na[u] + nb[v]
    low[is_span] = 1.55 * (1 - np.where(size > 0, 2.0 * lattices.in_common(a, u, b, v) / np.maximum(1, size), 1.0))
    text = lambda rows, a, b: " ".join([r[2] for r in rows[a:b]])

    def exact(k: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        pairs = [(text(groups[g][0], i, p), text(groups[g][1], j, q)) for (i, j, p, q), g in zip(steps[k].tolist(), lattice.tolist(), strict=True)]
        return 1.55 * (1 - np.array(matching.ratios(pairs)))

    taken, _ = lattices.least(ends, steps, low, rest, exact)
    taken = taken[::-1]
    at, span = steps[taken], (taken >= 0) & is_span[taken]
    out: list[list] = [[] for _ in groups]
    lattice, turn = np.nonzero(span.T)
    for g, (i, j, p, q) in zip(lattice.tolist(), at[turn, lattice].tolist(), strict=True):
        out[g].append((i, p, j, q))
    return out


def aligned_groups(cues: DataFrame, by: str) -> DataFrame:
    """(by, ref_from, ref_to, pred_from, pred_to) of each `by`. cues: by, expected, start_ms, end_ms, text (as it is compared). One file's cues are one group."""

    def run(starts: list[int], expected: list[bool], *cue: list) -> tuple[list[int], list[list]]:
        rows = list(zip(*cue, strict=True))
        side = lambda a, b, x: [r for r, e in zip(rows[a:b], expected[a:b], strict=True) if e == x]
        found = group_alignments([(side(a, b, True), side(a, b, False)) for a, b in pairwise(starts)])
        made = [(at, *x) for at, got in zip(starts, found) for x in got]
        number, *columns = map(list, zip(*made, strict=True)) if made else [[]] * 5
        return number, columns

    order = ["start_ms", "end_ms", "text"]
    return by_blocks(cues, [by], order, ["expected", *order], run, "ref_from int, ref_to int, pred_from int, pred_to int")


def collapsed_after_unmapped(rows: DataFrame, by: str, gap_ms: int = 1200, least: float = 0.40) -> DataFrame:
    """(by, cue, next_cue) where a cue that stayed as it was seems to be in the text of the next one, which has several lines.

    rows: by, cue, track, status, start_ms, end_ms, original, text, n_lines. Only pairs that meet the other conditions are compared as texts.
    """
    order = Window.partitionBy(by).orderBy("start_ms", "cue")
    ahead = {c: F.lead(c).over(order).alias(f"_{c}") for c in ("cue", "track", "start_ms", "text", "n_lines")}
    pairs = rows.select(by, "cue", "track", "status", "end_ms", "original", *ahead.values())
    pairs = pairs.where(f"status = 'keep_existing' AND track = _track AND _n_lines > 1 AND _cue = cue + 1 AND _start_ms - end_ms <= {gap_ms}")
    return pairs.where(said_score(F.coalesce("original", F.lit("")), F.coalesce("_text", F.lit("")))["score"] >= least).select(by, "cue", F.col("_cue").alias("next_cue"))


def regression_cases(cases: DataFrame, cues: DataFrame, width: int = 60_000) -> DataFrame:
    """(task, case, kind, passed) of confirmed cases over final cues.

    cases: task, case, kind, start_ms, end_ms, tolerance_ms, max_gap_ms, key; cues: task, cue, start_ms, end_ms, key (texts as they are compared). interval_timing: a
    cue begins and ends there, within the tolerance; interval_text: one with this text does; continuous_coverage: cues leave no longer gap from start to end; absent_text: no
    cue in between holds the text. Other kinds fail. Cues meet cases by time buckets.
    """
    c = cases.select("task", "case", "kind", F.col("start_ms").alias("a"), F.coalesce("end_ms", "start_ms").alias("b"), F.coalesce("tolerance_ms", F.lit(0)).alias("tol"), F.coalesce("max_gap_ms", F.lit(0)).alias("gap"), F.coalesce("key", F.lit("")).alias("want"))
    q = cues.select("task", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), F.coalesce("key", F.lit("")).alias("have"))
    near = c.where("kind IN ('interval_text', 'interval_timing')").withColumn("l_start", F.col("a") - F.col("tol")).withColumn("l_end", F.col("a") + F.col("tol"))
    starts = q.withColumn("end", F.col("r_end")).withColumn("r_end", F.col("r_start"))
    met = overlap_join(near, starts, ["task"], width, strict=False).where(F.abs(F.col("end") - F.col("b")) <= F.col("tol"))
    good = met.where((F.col("kind") == "interval_timing") | (F.col("have") == F.col("want"))).select("task", "case").distinct().withColumn("passed", F.lit(True))

    over = c.where("kind IN ('continuous_coverage', 'absent_text')").withColumn("l_start", F.col("a")).withColumn("l_end", F.col("b"))
    met = overlap_join(over, q, ["task"], width)
    bad = met.where((F.col("kind") == "absent_text") & F.col("have").contains(F.col("want"))).select("task", "case").distinct().withColumn("held", F.lit(True))
    order = Window.partitionBy("task", "case").orderBy("r_start", "r_end")
    before = F.greatest("a", F.coalesce(F.max("r_end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("a")))
    cover = met.where("kind = 'continuous_coverage'").withColumn("open", F.col("r_start") - before > F.col("gap"))
    cover = cover.groupBy("task", "case").agg((~F.bool_or("open") & (F.max("r_end") >= F.first("b"))).alias("covered"))

    all_ = c.join(good, ["task", "case"], "left").join(bad, ["task", "case"], "left").join(cover, ["task", "case"], "left")
    kind = F.col("kind")
    ok = F.when(kind.isin("interval_text", "interval_timing"), F.coalesce("passed", F.lit(False))).when(kind == "absent_text", F.col("held").isNull()).when(kind == "continuous_coverage", F.coalesce("covered", F.col("b") <= F.col("a"))).otherwise(False)
    return all_.select("task", "case", "kind", ok.alias("passed"))
