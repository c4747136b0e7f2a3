"""Matching blocks of many pairs of texts at a time, with the results of `text.matched`."""

from __future__ import annotations

import numpy as np

from tidewright.functions import text as tx

#: Characters of a text up to which it is compared among many, pairs and sub-pairs at a time, and scores that are kept for the next time.
WIDE, PAIRS, KEPT = 255, 1 << 14, 1 << 16
CELLS = 1 << 19

_kept: dict[tuple[str, str], float] = {}


def ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """`text.ratio` of each pair. Equal pairs are compared once, and scores of short ones are kept, a bounded number of them."""
    known = {p: _kept.get(p) for p in pairs}
    new = [p for p, s in known.items() if s is None]
    todo = []
    for p in new:
        a, b = p
        if a == b:
            known[p] = 1.0
        elif not a or not b:
            known[p] = 0.0
        elif max(len(a), len(b)) > WIDE:
            known[p] = tx.ratio(a, b)
        else:
            todo.append(p)
    todo.sort(key=lambda p: len(p[0]))
    for at in range(0, len(todo), PAIRS):
        some = todo[at : at + PAIRS]
        sizes = np.array([len(a) + len(b) for a, b in some], np.float64)
        known.update(zip(some, (2.0 * matched(some) / sizes).tolist(), strict=True))
    if len(_kept) > KEPT:
        _kept.clear()
    for p in new[: KEPT if len(new) > KEPT else None]:
        if len(p[0]) + len(p[1]) <= tx.KEPT:
            _kept[p] = known[p]
    return [known[p] for p in pairs]


def scores(pairs: list[tuple[str, str]]) -> list[float]:
    """`text.pair` of each pair."""
    damp = lambda n, m: 0.85 + 0.15 * min(n, m) / max(n, m)
    return [1.0 if a == b else 0.0 if not a or not b else r * damp(len(a), len(b)) for (a, b), r in zip(pairs, ratios(pairs), strict=True)]


def codes(texts: list[str]) -> np.ndarray:
    """Code points of each text, a row each, filled up with zeros."""
    wide = max(map(len, texts))
    return np.array(texts, f"U{wide}").view(np.uint32).reshape(len(texts), wide)


def matched(pairs: list[tuple[str, str]]) -> np.ndarray:
    """`text.matched` of each pair of texts that aren't empty.

    All sub-pairs that are left of a turn are searched side by side: a row of each first text after the other, against the whole second text. Of runs of the greatest
    length that which begins first in a is found first, and of these the first in b.
    """
    a, b = codes([p[0] for p in pairs]), codes([p[1] for p in pairs])
    letters = np.unique(np.concatenate([a.ravel(), b.ravel()]))
    kind = np.uint8 if len(letters) <= 250 else np.uint32
    a, b = (np.searchsorted(letters, x).astype(kind) for x in (a, b))
    total = np.zeros(len(pairs), np.int64)
    # Number of the pair, where each side begins, and its length.
    left = np.array([[k, 0, len(p), 0, len(q)] for k, (p, q) in enumerate(pairs)], np.int64)
    while len(left):
        made = []
        left = left[np.lexsort((left[:, 4], left[:, 2]))]
        at = 0
        while at < len(left):
            some = left[at : at + max(64, min(PAIRS, CELLS // int(left[at : at + 64, 4].max())))]
            at += len(some)
            most, first, place = longest(a, b, some)
            some, most, first, place = (x[most > 0] for x in (some, most, first, place))
            k, a0, na, b0, nb = some.T
            total += np.bincount(k, most, len(total)).astype(np.int64)
            made.append(np.stack([k, a0, first, b0, place], 1)[(first > 0) & (place > 0)])
            to_a, to_b = first + most, place + most
            made.append(np.stack([k, a0 + to_a, na - to_a, b0 + to_b, nb - to_b], 1)[(to_a < na) & (to_b < nb)])
        left = np.concatenate(made)
    return total


def longest(a: np.ndarray, b: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, place in a, place in b) of the longest common run of each sub-pair, places from its own beginnings."""
    k, a0, na, b0, nb = some.T
    n, m = int(na.max()), int(nb.max())

    def own(x: np.ndarray, at: np.ndarray, size: np.ndarray, wide: int, other: int) -> np.ndarray:
        rows = np.arange(wide)[:, None]
        got = x.take((k * x.shape[1] + at) + rows, mode="clip")
        got[rows >= size] = other % (1 << 8 * x.itemsize)  # equal to no letter
        return got

    x, y = own(a, a0, na, n, -1), own(b, b0, nb, m, -2)
    run, before = np.zeros((m + 1, len(k)), np.uint8), np.zeros((m + 1, len(k)), np.uint8)
    best, first, place = np.zeros(len(k), np.uint8), np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
    same = np.empty((m, len(k)), np.bool_)
    for i in range(n):
        np.equal(y, x[i], out=same)
        np.add(before[:-1], 1, out=run[1:])
        np.multiply(run[1:], same.view(np.uint8), out=run[1:])
        top = run.max(axis=0)
        up = np.flatnonzero(top > best)
        if len(up):
            best[up] = top[up]
            first[up] = i + 1 - top[up].astype(np.int64)
            place[up] = run[1:, up].argmax(axis=0) + 1 - top[up].astype(np.int64)
        run, before = before, run
    return best.astype(np.int64), first, place
