"""Repair plans: which lines of a cue stream take the text of the canonical lines that they are aligned with, and which need a review.

A group (one document against one canonical text) is aligned and decided in one task.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import matching
from tidewright.functions import text as tx
from tidewright.operators import folds, lattices

#: Least score and least ratio of lengths of a match, what short texts need, how near a rival may come and how far off it is sought.
LEAST, RATIO, SHORT, SHORT_SCORE, RIVAL, RADIUS, GUARD = 0.78, 0.60, 3, 0.84, 0.06, 3, 0.96
REASONS = (
    "unmatched_subtitle_cue", "low_or_structurally_unsafe_similarity", "adjacent_alignment_gap_requires_review", "ambiguous_nearby_canonical_match",
    "segmentation_boundary_insertion_requires_review", "layout_boundary_insertion_requires_review", "segmentation_would_empty_existing_cue",
)


@lru_cache(1 << 12)
def layout(c: str) -> bool:
    """Punctuation, separators and controls: the layout of a text, which repairs leave alone."""
    return c.isspace() or unicodedata.category(c)[0] in "PZC"


def content(text: str) -> str:
    return kept_content(text) if len(text) <= tx.KEPT else bared(text)


def bared(text: str) -> str:
    return "".join([c for c in text if not layout(c)])


kept_content = lru_cache(1 << 14)(bared)


def key(text: str) -> str:
    return kept_key(text) if len(text) <= tx.KEPT else content(tx.fold(text))


@lru_cache(1 << 15)
def kept_key(text: str) -> str:
    return content(tx.fold(text))


def landed(old: str, new: str) -> list[tuple[int, str, bool]]:
    """(place in `old`, character, whether it is put in before that place) of each character of `new`, by a least edit."""
    if old == new:
        return [(at, c, False) for at, c in enumerate(old)]
    return kept_edit(old, new) if len(old) + len(new) <= tx.KEPT else edited(old, new)


def edited(old: str, new: str) -> list[tuple[int, str, bool]]:
    out, at = [], 0
    for op, had, got in tx.script_of_edits(list(old), list(new)):
        if got is not None:
            out.append((at, got, op == "insert"))
        at += had is not None
    return out


kept_edit = lru_cache(1 << 12)(edited)


def shared_out(parts: list[str], target: str) -> tuple[list[str], str | None]:
    """The characters of `target` dealt to the parts that own the places where they land, and why that is in doubt, if it is.

    Characters put in between two parts, or at a gap in a part's layout, could belong to either side.
    """
    bare = [content(p) for p in parts]
    if "".join(bare) == target:
        return bare, None
    ends = list(accumulate(map(len, bare)))
    edges = {e for e in ends[:-1] if 0 < e < ends[-1]}
    gaps, base = set(), 0
    for p, b in zip(parts, bare, strict=True):
        gaps |= {base + n for n in accumulate(len(content(w)) for w in p.split()) if 0 < n < len(b)}
        base += len(b)
    out = [""] * len(parts)
    doubt: set[str] = set()
    for at, c, inserted in landed("".join(bare), target):
        owner = min(bisect_right(ends, at), len(parts) - 1) if at < ends[-1] else max((i for i, b in enumerate(bare) if b), default=0)
        out[owner] += c
        if inserted and at in edges | gaps:
            doubt.add(REASONS[4] if at in edges else REASONS[5])
    return out, min(doubt, key=REASONS.index, default=None)


def rendered(original: str, target: str) -> str:
    """`target` in the layout of `original`: its punctuation, spaces and breaks stay where they are."""
    bare = content(original)
    if bare == target:
        return original
    slots = [""] * (len(bare) + 1)
    for at, c, _ in landed(bare, target):
        slots[at] += c
    out, at = [], 0
    for c in original:
        if layout(c):
            out.append(c)
        else:
            out.append(slots[at])
            at += 1
    return "".join([*out, slots[at]])


def safe(a: str, b: str, score: float, least: float = LEAST) -> bool:
    if not a or not b or score < least:
        return False
    short, long = sorted((len(a), len(b)))
    return short / long >= RATIO and (short > SHORT or score >= max(least, SHORT_SCORE))


def rivals(source: str, keys: list[str], start: int, end: int, score: float, least: float = LEAST, most: int = 4) -> tuple[float, list[str]]:
    """(what a rival scores at least, texts of other runs of lines nearby whose lengths allow it)."""
    chosen, enough, size = "".join(keys[start:end]), max(least, score - RIVAL), len(source)
    found, first, last = [], max(0, start - RADIUS), min(len(keys), end + RADIUS)
    sizes, slack = [len(k) for k in keys[first : last + most]], 1e-6 * (size + 1)
    low, high = size * enough / (2 - enough) - slack, size * (2 - enough) / enough + slack  # beyond these the ratio can't be `enough`
    for a in range(first, last):
        length = 0
        for b in range(a + 1, min(a + most, len(keys)) + 1):
            length += sizes[b - 1 - first]
            if length > high:
                break
            if length >= low and (a, b) != (start, end) and tx.pair_bound(size, length) >= enough and (other := "".join(keys[a:b])) != chosen:
                found.append(other)
    return enough, found


def rivalled(source: str, keys: list[str], start: int, end: int, score: float, least: float = LEAST, most: int = 4) -> bool:
    """Whether another run of lines nearby, of other text, comes within RIVAL of the chosen run's score."""
    enough, found = rivals(source, keys, start, end, score, least, most)
    return any(tx.pair(source, other) >= enough for other in found)


def doubtful(steps: list[tuple], n: int, source: str, target: str, least: float) -> str | None:
    """Why a step is in doubt, its rivals aside."""
    kind, *_, s = steps[n]
    if kind == "left_gap":
        return REASONS[0]
    if not safe(source, target, s, least):
        return REASONS[1]
    return REASONS[2] if s < GUARD and any(steps[k][0] != "match" for k in (n - 1, n + 1) if 0 <= k < len(steps)) else None


def settled(cues: list[str], lines: list[str], steps: list[tuple], reasons: dict[int, str | None]) -> list[tuple]:
    """What is decided of each cue; reasons: of the steps that are in doubt."""
    out = []
    for n, (kind, a, b, i, j, s) in enumerate(steps):
        if kind == "right_gap":
            continue
        reason, targets = reasons.get(n), []
        if not reason:
            targets, reason = shared_out(cues[a:b], content("".join(lines[i:j])))
            if not reason and b - a > 1 and not all(targets):
                reason = REASONS[6]
        for k in range(a, b):
            new = cues[k] if reason else rendered(cues[k], targets[k - a])
            action = "review" if reason else "unchanged" if new == cues[k] else "replace"
            why = reason or ("canonical_content_matches_source_segmentation" if action == "unchanged" else "high_confidence_span_preserving_match")
            out.append((k, action, why, float(s), a, b, i, j, new))
    return out


def decided(cues: list[str], lines: list[str], least: float = LEAST, score: Callable[[str, str], float] = tx.pair) -> list[tuple]:
    """(cue, action, reason, score, cue_from, cue_to, line_from, line_to, text) of each cue, in order."""
    keys, wants = [key(c) for c in cues], [key(x) for x in lines]
    steps = folds.span_alignment(keys, wants, score, bound=tx.pair_bound if score is tx.pair else lambda n, m: 1.0)
    reasons = {}
    for n, (kind, a, b, i, j, s) in enumerate(steps):
        if kind != "right_gap":
            source = "".join(keys[a:b])
            reasons[n] = doubtful(steps, n, source, "".join(wants[i:j]), least) or (REASONS[3] if rivalled(source, wants, i, j, s, least) else None)
    return settled(cues, lines, steps, reasons)


#: Lines of a side, and characters of joined lines, up to which groups are aligned many at a time.
LINES, LETTERS = 16, 255


def alignments(groups: list[tuple[list[str], list[str]]], most: int = 4, gap: float = 0.48, span: float = 0.02, band: int = 8) -> list[list[tuple]]:
    """`folds.span_alignment` of each (left, right) by `text.pair`. Small ones are aligned side by side."""
    small = lambda rows: 0 < len(rows) <= LINES and most * max(map(len, rows)) <= LETTERS
    sizes = {g: (len(a), len(b)) for g, (a, b) in enumerate(groups) if small(a) and small(b)}
    out: list = [None] * len(groups)
    for n, m, own in lattices.shaped(sizes, most):
        for g, got in zip(own, side_by_side([groups[g] for g in own], n, m, most, gap, span, band), strict=True):
            out[g] = got
    return [folds.span_alignment(*groups[g], tx.pair, most, gap, span, band, tx.pair_bound) if x is None else x for g, x in enumerate(out)]


def side_by_side(groups: list[tuple[list[str], list[str]]], n: int, m: int, most: int, gap: float, span: float, band: int) -> list[list[tuple] | None]:
    """The alignments of groups of up to n and m lines; none where the best path touches the edge of the band."""
    steps = lattices.moves(n, m, most, n + m)
    ends = np.array([[len(s) for s in g] for g in groups]).T
    is_span = lattices.spanning(steps)
    low, side = np.full((len(steps), len(groups)), gap), []
    for s, size in enumerate((n, m)):
        rows = [x for g in groups for x in (*g[s], *[""] * (size - len(g[s])))]
        length = np.array([len(x) for x in rows]).reshape(-1, size).T
        letters = lattices.spans(lattices.counts(rows, size), most, None)
        number = {ip: k for k, ip in enumerate(letters)}
        of = np.array([number[x, y] for x, y in steps[is_span][:, [s, s + 2]].tolist()])
        side.append((np.array(list(letters.values())), of, np.array([length[i:p].sum(axis=0) for i, p in letters])[of]))
    (a, u, x), (b, v, y) = side
    extra = np.zeros(len(steps))
    extra[is_span] = span * ((steps[is_span][:, 2:] - steps[is_span][:, :2]).sum(axis=1) - 2)
    short, long = np.minimum(x, y), np.maximum(x, y)
    bound = 2.0 * lattices.in_common(a, u, b, v) / np.maximum(1, x + y) * (0.85 + 0.15 * short / np.maximum(1, long))
    low[is_span] = 1 - np.where(long > 0, bound, 1.0) + extra[is_span][:, None]
    beside = np.abs(steps[:, 1][:, None] - steps[:, 0][:, None] * ends[1] // ends[0])
    low[beside > band] = np.inf
    score = np.zeros(low.shape)

    def exact(k: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        pairs = [("".join(groups[g][0][i:p]), "".join(groups[g][1][j:q])) for (i, j, p, q), g in zip(steps[k].tolist(), lattice.tolist(), strict=True)]
        score[k, lattice] = matching.scores(pairs)
        return (1 - score[k, lattice]) + extra[k]

    taken, _ = lattices.least(ends, steps, low, np.zeros(low.shape), exact, 1e-12, turns=2)
    out: list = [[] for _ in groups]
    lattice, turn = np.nonzero((taken[::-1] >= 0).T)
    move = taken[::-1][turn, lattice]
    for g, k, (i, j, p, q), s in zip(lattice.tolist(), move.tolist(), steps[move].tolist(), score[move, lattice].tolist(), strict=True):
        kind = "match" if is_span[k] else "left_gap" if p > i else "right_gap"
        out[g].append((kind, i, p, j, q, round(s, 6)))
    edge = (beside >= band)[move, lattice] & (steps[move, 0] > 0) & (steps[move, 0] < ends[0, lattice]) & (band < ends.max(axis=0)[lattice])
    for g in set(lattice[edge].tolist()):
        out[g] = None
    return out


def decisions(groups: list[tuple[list[str], list[str]]], least: float = LEAST) -> list[list[tuple]]:
    """`decided` of each (cues, lines). Texts are compared many at a time."""
    keys = [([key(c) for c in cues], [key(x) for x in lines]) for cues, lines in groups]
    found = alignments(keys)
    reasons: list[dict[int, str | None]] = [{} for _ in groups]
    near = []
    for g, steps in enumerate(found):
        own, wants = keys[g]
        for n, (kind, a, b, i, j, s) in enumerate(steps):
            if kind != "right_gap":
                source = "".join(own[a:b])
                reasons[g][n] = doubtful(steps, n, source, "".join(wants[i:j]), least)
                if not reasons[g][n]:
                    enough, others = rivals(source, wants, i, j, s, least)
                    near += [(g, n, enough, source, x) for x in others]
    for (g, n, enough, *_), s in zip(near, matching.scores([x[3:] for x in near]), strict=True):
        if s >= enough:
            reasons[g][n] = REASONS[3]
    return [settled(*groups[g], steps, reasons[g]) for g, steps in enumerate(found)]


SCHEMA = "cue int, action string, reason string, score double, cue_from int, cue_to int, line_from int, line_to int, text string"


def repair_plan(rows: DataFrame, by: str, side: str, order: list[str], text: str, least: float = LEAST) -> DataFrame:
    """The decisions of each group; `side` is true for cues and false for canonical lines."""

    def run(starts: list[int], is_cue: list[bool], texts: list[str]) -> tuple[list[int], list[list]]:
        pick = lambda a, b, x: [t for s, t in zip(is_cue[a:b], texts[a:b], strict=True) if s == x]
        found = decisions([(pick(a, b, True), pick(a, b, False)) for a, b in pairwise(starts)], least)
        made = [(at, *x) for at, got in zip(starts, found) for x in got]
        number, *columns = map(list, zip(*made, strict=True)) if made else [[]] * 10
        return number, columns

    return folds.by_blocks(rows, [by], [F.asc_nulls_last(c) for c in order], [side, text], run, SCHEMA)
