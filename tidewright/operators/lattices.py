"""Least paths through many small lattices side by side.

A lattice has places (i, j) up to its end; smaller ones lie in the corner of one shape, and what is beyond their ends doesn't touch them. A move takes up to `most` items of each side, or one item of either alone. A move costs `first` + `rest`, two numbers that
are added to what the path costs so far one after the other. Moves are taken in the order of their beginnings, gaps before spans; of paths that cost the same
the one found first stays, so that results are those of a plain loop to the last bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

from tidewright.functions import matching

#: Fixed value: classes of letters that are counted to bound what two texts have in common.
CLASSES = 32
#: Lattices of one shape from which they are not laid into larger ones, and moves of all lattices that are done at a time.
ALIKE, MOVES = 100, 1 << 20


def shaped(sizes: dict[int, tuple[int, int]], most: int) -> Iterator[tuple[int, int, list[int]]]:
    """(n, m, numbers) of lattices that are done side by side; those of rare shapes share larger ones."""
    own: dict[tuple[int, int], list[int]] = {}
    for g, size in sizes.items():
        own.setdefault(size, []).append(g)
    out: dict[tuple[int, int], list[int]] = {}
    for (n, m), gs in own.items():
        out.setdefault((n, m) if len(gs) >= ALIKE else (-(-n // 4) * 4, -(-m // 4) * 4), []).extend(gs)
    for gs in out.values():
        n, m = (max(sizes[g][s] for g in gs) for s in (0, 1))
        some = max(1, MOVES // ((n + 1) * (m + 1) * most**2))
        yield from ((n, m, gs[at : at + some]) for at in range(0, len(gs), some))


@lru_cache(1 << 10)
def moves(n: int, m: int, most: int, band: int) -> np.ndarray:
    """(i, j, p, q) of each move, a row each, that begins at most `band` places beside the diagonal."""
    out = []
    for i in range(n + 1):
        centre = i * m // max(1, n)
        for j in range(max(0, centre - band), min(m, centre + band) + 1):
            out += [(i, j, i + 1, j)] * (i < n) + [(i, j, i, j + 1)] * (j < m)
            out += [(i, j, p, q) for p in range(i + 1, min(n, i + most) + 1) for q in range(j + 1, min(m, j + most) + 1)]
    return np.array(out, np.int64).reshape(-1, 4)


def forth(ends: np.ndarray, steps: np.ndarray, first: np.ndarray, rest: np.ndarray, margin: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """What the best path to each place costs, and its last move. first, rest: a row for each move, a column for each lattice."""
    n, m = steps[:, 2:].max(axis=0)
    cost = np.full(((n + 1) * (m + 1), first.shape[1]), np.inf)
    back = np.full(cost.shape, -1, np.int16)
    cost[0] = 0.0
    for at, end, place, to in places(steps):  # a place's moves lead to different places
        value = cost[place] + first[at:end]
        value += rest[at:end]
        had = cost[to]
        better = value < (had - margin if margin else had)
        cost[to] = np.where(better, value, had)
        back[to] = np.where(better, np.arange(at, end, dtype=np.int16)[:, None], back[to])
    return cost.reshape(n + 1, m + 1, -1), back.reshape(n + 1, m + 1, -1)


def places(steps: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
    """(first move, move after the last, place, places where they lead) of each place from which moves begin; places are numbered by rows."""
    wide = int(steps[:, 3].max()) + 1
    begin, to = steps[:, 0] * wide + steps[:, 1], steps[:, 2] * wide + steps[:, 3]
    at = np.flatnonzero(np.diff(begin, prepend=-1))
    return [(a, b, int(begin[a]), to[a:b]) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(steps)], strict=True)]


def to_go(ends: np.ndarray, steps: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """What the best path from each place to its lattice's end costs."""
    n, m = steps[:, 2:].max(axis=0)
    left = np.full(((n + 1) * (m + 1), whole.shape[1]), np.inf)
    left[ends[0] * (m + 1) + ends[1], np.arange(whole.shape[1])] = 0.0
    for at, end, place, to in reversed(places(steps)):
        np.minimum(left[place], (whole[at:end] + left[to]).min(axis=0), out=left[place])
    return left.reshape(n + 1, m + 1, -1)


def path(ends: np.ndarray, steps: np.ndarray, back: np.ndarray) -> np.ndarray:
    """The moves of each lattice's best path from its end, a row each, -1 beyond its beginning."""
    many = back.shape[2]
    (i, j), each, out = ends, np.arange(many), []
    while (i + j).any():
        k = back[i, j, each].astype(np.int64)
        out.append(k)
        on = k >= 0
        i, j = np.where(on, steps[k, 0], 0), np.where(on, steps[k, 1], 0)
    return np.array(out, np.int64).reshape(-1, many)


def spanning(steps: np.ndarray) -> np.ndarray:
    """Which moves take items of both sides."""
    return (steps[:, 2] > steps[:, 0]) & (steps[:, 3] > steps[:, 1])


def counts(texts: list[str], size: int) -> np.ndarray:
    """(item, class, lattice): how many letters of each class each item has; `size` items of a lattice follow each other. Texts have up to 255 letters."""
    if not any(texts):
        return np.zeros((size, CLASSES, len(texts) // size), np.uint8)
    at = matching.codes(texts) % CLASSES + CLASSES * np.arange(len(texts))[:, None]
    inside = np.arange(at.shape[1]) < np.fromiter(map(len, texts), np.int64, len(texts))[:, None]
    found = np.bincount(at[inside], minlength=CLASSES * len(texts)).astype(np.uint8)
    return np.ascontiguousarray(found.reshape(-1, size, CLASSES).transpose(1, 2, 0))


def spans(letters: np.ndarray, most: int, between: int | None) -> dict[tuple[int, int], np.ndarray]:
    """(from, to): letters of each class of the items in between, joined by nothing or by a letter of the class `between`."""
    out = {}
    for i in range(len(letters)):
        out[i, i + 1] = at = letters[i]
        for p in range(i + 2, min(len(letters), i + most) + 1):
            at = at + letters[p - 1]
            if between is not None:
                at[between] += 1
            out[i, p] = at
    return out


def in_common(a: np.ndarray, u: np.ndarray, b: np.ndarray, v: np.ndarray) -> np.ndarray:
    """How many letters spans u of a and spans v of b have in common at most. a, b: span, class, lattice."""
    out = np.empty((len(u), a.shape[2]), np.uint16)
    some = max(1, (1 << 20) // max(1, a[0].size))
    for at in range(0, len(u), some):
        np.minimum(a[u[at : at + some]], b[v[at : at + some]]).sum(axis=1, dtype=np.uint16, out=out[at : at + some])
    return out


def least(ends: np.ndarray, steps: np.ndarray, low: np.ndarray, rest: np.ndarray, exact: Callable[[np.ndarray, np.ndarray], np.ndarray], margin: float = 0.0, turns: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(moves of the best paths, their `first`), where spans' first costs are at least `low` and exact(move, lattice) tells them. ends: the places where the lattices end, a column each.

    A few times the path that is best by what is known is priced exactly, which makes it the bound; then only those moves are that may be on a path which costs no more.
    """
    is_span = spanning(steps)[:, None]
    first, known = low.copy(), np.broadcast_to(~is_span, low.shape).copy()
    total = np.full(low.shape[1], np.inf)
    i, j, p, q = steps.T
    for _ in range(turns):
        cost, back = forth(ends, steps, first, rest, margin)
        taken = path(ends, steps, back)
        turn, at = np.nonzero(taken >= 0)
        k = taken[turn, at]
        new = ~known[k, at]
        if new.any():
            first[k[new], at[new]] = exact(k[new], at[new])
        known[k, at] = True
        total = np.minimum(total, np.bincount(at, first[k, at] + rest[k, at], low.shape[1]))
        if not new.any():
            break
    cost, _ = forth(ends, steps, first, rest, margin)
    may = cost[i, j] + first + rest + to_go(ends, steps, first + rest)[p, q] <= total + 1e-9
    k, at = np.nonzero(may & ~known)
    if len(k):
        first[k, at] = exact(k, at)
    first[~may] = np.inf
    _, back = forth(ends, steps, first, rest, margin)
    return path(ends, steps, back), first
