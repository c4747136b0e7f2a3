"""Order-dependent operators. None of these takes a whole table as one group.

`sorted_fold` reads each key's rows in order, as they come from Spark's sort, and holds no more than its state: a key may have any
number of rows. `by_sorted` holds a group's rows as lists (`by_blocks` those of many small groups), `by_group` holds a group (a conversation, a user, a document pair) as one small table in one task; there a group is
the unit that bounds memory.
"""

from __future__ import annotations

import gc
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame


def by_group(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return dealt_by(df, keys).groupBy(*keys).applyInPandas(fn, schema)


def dealt_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys in one part. The number of parts is named, since what costs here is time, not bytes: adaptive execution would join small parts to a few long tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def by_merge(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that goes through Spark's sort. Tables that grow with the input look small while they are compressed; what Spark broadcasts of them goes through the driver whole."""
    return df.hint("merge")


def by_sorted(df: DataFrame, keys: list[str], order: list[str | Column], values: list[str], fn: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """What `fn` makes of each key's rows, which it gets in order, as one list for each of `values`; its rows follow the keys in `schema`.

    Rows come from Spark's sort; one group is held at a time, as plain lists, so a table of many small groups costs little for each.
    """
    n = len(keys)
    dealt = dealt_by(df, keys).sortWithinPartitions(*keys, *order).select(*keys, *values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def done() -> list[tuple]:
            return [last + x for x in fn(*map(list, zip(*held, strict=True)))]

        for batch in batches:
            made = []
            columns = [c.to_pylist() for c in batch.columns]
            for key, row in zip(zip(*columns[:n], strict=True), zip(*columns[n:], strict=True), strict=True):
                if key != last:
                    if held:
                        made += done()
                    last, held = key, []
                held.append(row)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names)
        if held and (made := done()):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names)

    whole = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + [schema])
    names = [x.split()[0] for x in whole.split(", ")]
    return dealt.mapInArrow(typed(run, whole), whole)


def listed(column: pa.ChunkedArray) -> list:
    """`column.to_pylist()`, sooner; equal texts are one object."""
    kind = column.type
    if pa.types.is_string(kind):
        coded = column.combine_chunks().dictionary_encode()
        texts = np.array([*coded.dictionary.to_pylist(), None], object)
        return texts[coded.indices.fill_null(len(texts) - 1).to_numpy(zero_copy_only=False)].tolist()
    if not (pa.types.is_integer(kind) or pa.types.is_float64(kind) or pa.types.is_boolean(kind)):
        return column.to_pylist()
    plain = (column.fill_null(False if pa.types.is_boolean(kind) else 0) if column.null_count else column).to_numpy().tolist()
    for k in np.flatnonzero(column.is_null().to_numpy()).tolist() if column.null_count else ():
        plain[k] = None
    return plain


#: Fixed value: rows of whole groups that are taken at a time.
BLOCK = 1 << 16


def by_blocks(df: DataFrame, keys: list[str], order: list[str | Column], values: list[str], fn: Callable[..., tuple[list[int], list[list]]], schema: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """As `by_sorted`, many groups at a time: fn(starts, *values) gets the rows of some whole groups, one list for each of `values`, and where each group starts (and the last ends).

    It gives for each row that it makes the number of a row whose keys, and columns `kept`, go before it, and the columns of `schema`. About BLOCK rows, or one
    group if that has more, are held at a time.
    """
    n, both = len(keys), [*keys, *kept]
    dealt = dealt_by(df, keys).sortWithinPartitions(*keys, *order).select(*keys, *dict.fromkeys([*kept, *values]))

    def starts(t: pa.Table) -> np.ndarray:
        fresh = np.zeros(t.num_rows, bool)
        fresh[:1] = True
        for c in t.columns[:n]:
            a, b = c.slice(1), c.slice(0, t.num_rows - 1)
            unlike = pc.fill_null(pc.not_equal(a, b), pc.not_equal(pc.is_null(a), pc.is_null(b)))
            fresh[1:] |= unlike.to_numpy()
        return np.flatnonzero(fresh)

    def done(t: pa.Table, at: np.ndarray) -> pa.RecordBatch | None:
        gc.disable()  # what a block makes is no garbage, but would be searched for it again and again
        try:
            number, made = fn([*at.tolist(), t.num_rows], *(listed(t.column(c)) for c in values))
        finally:
            gc.enable()
        if not len(number):
            return None
        own = t.select(both).take(pa.array(number, pa.int64()))
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in own.columns), *map(pa.array, made)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK:
                t = pa.Table.from_batches(held)
                at = starts(t)
                if len(at) > 1 and (got := done(t.slice(0, at[-1]), at[:-1])) is not None:
                    yield got
                held = t.slice(at[-1]).to_batches()
                rows = t.num_rows - at[-1] if len(at) > 1 else 0  # a group that fills a block is sought for its end after another block only
        if held and (t := pa.Table.from_batches(held)).num_rows and (got := done(t, starts(t))) is not None:
            yield got

    whole = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in both] + [schema])
    names = [x.split()[0] for x in whole.split(", ")]
    return dealt.mapInArrow(typed(run, whole), whole)


def sorted_fold(df: DataFrame, keys: list[str], order: list[str | Column], values: list[str], start: Callable[[], Any], step: Callable[..., tuple | None], schema: str) -> DataFrame:
    """The rows of each key in order: `step(state, *values)` gives what follows the keys in a row of `schema`, or None for no row."""
    n = len(keys)
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, start()
        for batch in batches:
            made = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != last:
                    last, state = row[:n], start()
                if (got := step(state, *row[n:])) is not None:
                    made.append(row[:n] + got)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names)

    whole = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + [schema])
    names = [x.split()[0] for x in whole.split(", ")]
    return dealt.mapInArrow(typed(run, whole), whole)


def typed(run: Callable, schema: str) -> Callable:
    """`run` with its batches cast to the schema's types."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    want = to_arrow_schema(_parse_datatype_string(schema))
    return lambda batches: (b.cast(want) for b in run(batches))


def near(a: np.ndarray, b: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs within the tolerance, by i; only these are held, not all pairs."""
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a - tolerance, "left"), np.searchsorted(b[order], a + tolerance, "right")
    n = high - low
    i = np.repeat(np.arange(len(a)), n)
    return i, order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]


def nearest_pairs(a: np.ndarray, b: np.ndarray, tolerance: float) -> list[tuple[int, int]]:
    """Pairs within the tolerance, least distance first, each side once (ties by place)."""
    i, j = near(a, b, tolerance)
    order = np.lexsort((j, i, np.abs(a[i] - b[j])))
    left, right, out = set(), set(), []
    for p, q in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if p not in left and q not in right:
            left.add(p)
            right.add(q)
            out.append((p, q))
    return out


def ordered_pairs(a: np.ndarray, b: np.ndarray, tolerance: float) -> list[tuple[int, int]]:
    """In the order of a, the nearest b that is still free."""
    i, j = near(a, b, tolerance)
    order = np.lexsort((j, np.abs(a[i] - b[j]), i))
    left, right, out = set(), set(), []
    for p, q in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if p not in left and q not in right:
            left.add(p)
            right.add(q)
            out.append((p, q))
    return out


def most_pairs(a: np.ndarray, b: np.ndarray, tolerance: float) -> list[tuple[int, int]]:
    """Most pairs within the tolerance, then least total distance; both sides sorted, pairs don't cross."""
    n, m = len(a), len(b)
    best = [[(0, 0.0)] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            options = [best[i + 1][j], best[i][j + 1]]
            gap = abs(float(a[i]) - float(b[j]))
            if gap <= tolerance:
                c, e = best[i + 1][j + 1]
                options.append((c - 1, e + gap))
            best[i][j] = min(options)
    out, i, j = [], 0, 0
    while i < n and j < m:
        gap = abs(float(a[i]) - float(b[j]))
        if gap <= tolerance and best[i][j] == (best[i + 1][j + 1][0] - 1, best[i + 1][j + 1][1] + gap):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


#: Pairs of points whose slopes are held at a time.
PAIRS = 1 << 21


def middle(values: np.ndarray) -> float:
    """The median as SQL interpolates it."""
    v, n = np.sort(values), len(values)
    return float(v[n // 2] if n % 2 else 0.5 * v[n // 2 - 1] + 0.5 * v[n // 2])


def slopes(x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
    """The slopes between all pairs of points that differ in x, which rises; some points against all those after them at a time."""
    n = len(x)
    step = max(1, PAIRS // max(1, n))
    with np.errstate(all="ignore"):
        for at in range(0, n, step):
            dx, dy = x[None, at + 1 :] - x[at : at + step, None], y[None, at + 1 :] - y[at : at + step, None]
            yield dy[dx > 0] / dx[dx > 0]


def median_slope(x: np.ndarray, y: np.ndarray) -> float | None:
    """The median of `slopes`, None where there are none.

    Where they are too many to be held, their places are counted by 16 bits of their binary form after the other; time is that of the pairs, memory isn't.
    """
    if len(x) ** 2 <= PAIRS:
        found = next(slopes(x, y), np.zeros(0))
        return middle(found) if len(found) else None

    def keys(s: np.ndarray) -> np.ndarray:  # whole numbers in the order of the values, NaN last
        k = np.where(np.isnan(s), np.nan, s + 0.0).view(np.uint64)
        return np.where(k >> np.uint64(63), ~k, k | np.uint64(1 << 63))

    def nth(rank: int) -> float:
        known = 0
        for shift in (48, 32, 16, 0):
            counts = np.zeros(1 << 16, np.int64)
            for s in slopes(x, y):
                k = keys(s) >> np.uint64(shift)
                if shift < 48:
                    k = k[k >> np.uint64(16) == np.uint64(known)]
                counts += np.bincount((k & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            upto = np.cumsum(counts)
            at = int(np.searchsorted(upto, rank, "right"))
            rank -= int(upto[at] - counts[at])
            known = known << 16 | at
        bits = known ^ (1 << 63) if known >> 63 else known ^ ((1 << 64) - 1)
        return float(np.array([bits], np.uint64).view(np.float64)[0])

    n = sum(len(s) for s in slopes(x, y))
    return (nth(n // 2) if n % 2 else 0.5 * nth(n // 2 - 1) + 0.5 * nth(n // 2)) if n else None


def suppressed(score: np.ndarray, centre: np.ndarray, distance: float, keep: int) -> list[int]:
    """Places of the best rows, none within `distance` of a better one."""
    out: list[int] = []
    for i in np.lexsort((np.arange(len(score)), -score)):
        if all(abs(centre[i] - centre[k]) >= distance for k in out):
            out.append(int(i))
            if len(out) == keep:
                break
    return out


def cluster_step(width: float) -> Callable[[list, float], tuple[int]]:
    """Numbers runs in which each row is within `width` of the run's first. The state is [first, number]."""

    def step(state: list, x: float) -> tuple[int]:
        if not state:
            state[:] = [x, 0]
        elif x - state[0] > width:
            state[:] = [x, state[1] + 1]
        return (state[1],)

    return step


def rising_step(*more: int) -> Callable[[list, int], tuple[int | None]]:
    """The row's index, or the least of index + `more` that isn't below the last one given, or none. The state is [last]."""

    def step(state: list, x: int) -> tuple[int | None]:
        last = state[0] if state else x
        got = x if x >= last else min((x + m for m in more if x + m >= last), default=None)
        if got is not None:
            state[:] = [got]
        return (got,)

    return step


def session_step(gap: float, off: float) -> Callable[[list, float, float], tuple[int]]:
    """Numbers runs; a run ends at a time gap, or at a value too far from the run's own median. The state is [number, last time, sorted values]."""

    def step(state: list, time: float, value: float) -> tuple[int]:
        if not state:
            state[:] = [0, time, []]
        own = state[2]
        if own:
            m = len(own) // 2
            middle = own[m] if len(own) % 2 else (own[m - 1] + own[m]) / 2
            if time - state[1] > gap or abs(value - middle) > off:
                state[0], state[2] = state[0] + 1, []
        insort(state[2], value)
        state[1] = time
        return (state[0],)

    return step


def apart_step(distance: float, most: int) -> Callable[[list, float], tuple[int] | None]:
    """Of rows from the best down the first `most` that keep their distance from all better ones kept, numbered. The state are their places."""

    def step(state: list, at: float) -> tuple[int] | None:
        if len(state) >= most or any(abs(at - x) < distance for x in state):
            return None
        state.append(at)
        return (len(state),)

    return step


def below_step(state: list, seen: bool, value: float, row: object) -> tuple | None:
    """Of rows seen before, how many have a smaller value. The state holds one number for each row seen, sorted."""
    if seen:
        insort(state, value)
        return None
    return row, bisect_left(state, value)


def latest_step(state: tuple[list, list], seen: bool, value: float, row: object) -> tuple | None:
    """Of rows seen before, the last one with a smaller value. Of two rows that of a smaller value, or the later of equals, hides those before it with a
    greater one, so values held rise in the order of rows."""
    values, rows = state
    if seen:
        k = bisect_left(values, value)
        del values[k:], rows[k:]
        values.append(value)
        rows.append(row)
        return None
    k = bisect_left(values, value)
    return row, rows[k - 1] if k else None


def free_step(state: list, start: float, end: float, *rest: object) -> tuple | None:
    """Of rows from the best down those that overlap none that is kept. The state are the kept intervals, which are disjoint, in order."""
    i = bisect_right(state, (start, end))
    if (i and state[i - 1][1] > start and end > state[i - 1][0]) or (i < len(state) and state[i][0] < end and state[i][1] > start):
        return None
    insort(state, (start, end))
    return rest


def replaced(rows: list[tuple[float, float, int]], start: float, end: float, key: int, shortest: float) -> list[tuple[float, float, int]] | None:
    """Rows with [start, end) given to `key`: contained rows go, neighbours are cropped, short rests go; a row that spans it all is refused."""
    out = []
    for a, b, k in rows:
        if a < start and b > end:
            return None
        if (a >= start and b <= end) or (k == key and a < end and start < b):
            continue
        if a < start < b:
            b = start
        elif a < end < b:
            a = end
        if b - a >= shortest:
            out.append((a, b, k))
    return sorted([*out, (start, end, key)])


def weighted_line(x: np.ndarray, y: np.ndarray, prior: float | None = None, strength: float = 1.0, turns: int = 5) -> tuple[float, float]:
    """Iteratively reweighted least squares: weight 1 / max(1, |residual|), a soft prior row for the slope."""
    a = np.column_stack([np.ones(len(x)), x])
    w, sol = np.ones(len(x)), np.zeros(2)
    for _ in range(turns):
        m, v = (a * w[:, None]).T @ a, (a * w[:, None]).T @ y
        if prior is not None:
            m[1, 1] += strength
            v[1] += strength * prior
        sol = np.linalg.lstsq(m, v, rcond=None)[0]
        w = 1 / np.maximum(1, np.abs(y - a @ sol))
    return float(sol[0]), float(sol[1])


def hinges(x: np.ndarray, y: np.ndarray, most: int = 2, least: int = 3, gain: float = 0.8) -> tuple[list[float], np.ndarray, float]:
    """A continuous line with at most `most` breaks among the points, each added only if it takes the error to `gain` of what it was."""
    from itertools import combinations

    places, ordered = np.unique(x)[least:-least] if len(x) > 2 * least else np.empty(0), np.sort(x)
    before = np.searchsorted(ordered, places)

    def solve(breaks: tuple[float, ...]) -> tuple[np.ndarray, float]:
        a = np.column_stack([np.ones(len(x)), x, *[np.maximum(0, x - b) for b in breaks]])
        sol = np.linalg.lstsq(a, y, rcond=None)[0]
        return sol, float(np.abs(y - a @ sol).mean())

    best = ((), *solve(()))
    for n in range(1, most + 1):
        found = None
        chosen = nearly_best(x, y, places, before, n, least) if n <= 2 else combinations(range(len(places)), n)
        for at in chosen:
            breaks = tuple(places[k] for k in at)
            if np.diff([0, *before[list(at)], len(x)]).min() >= least:
                sol, err = solve(breaks)
                if found is None or err < found[2]:
                    found = (breaks, sol, err)
        if found and found[2] < gain * best[2]:
            best = found
    return [float(b) for b in best[0]], best[1], best[2]


def nearly_best(x: np.ndarray, y: np.ndarray, places: np.ndarray, before: np.ndarray, n: int, least: int, slack: float = 1e-6, block: int = 1 << 20) -> list[tuple[int, ...]]:
    """Of all choices of one or two breaks, in order, those whose error may be the least, to be solved exactly: within `slack` of the least, or too nearly dependent to tell.

    Hinges are freed of their line once, so that a choice is a system of one or two unknowns; many of them are solved at a time.
    """
    i, j = (np.arange(len(places)),) * 2 if n == 1 else np.triu_indices(len(places), 1)
    ok = (before[i] >= least) & (len(x) - before[j] >= least) & ((before[j] - before[i] >= least) if n == 2 else True)
    i, j = i[ok], j[ok]
    if not len(i):
        return []
    line = np.linalg.qr(np.column_stack([np.ones(len(x)), x]))[0]
    free = lambda v: v - line @ (line.T @ v)
    h, rest = free(free(np.maximum(0, x[:, None] - places))), free(free(y))
    norm = np.sqrt((h * h).sum(0))
    weak = norm <= 1e-9 * max(1.0, float(np.abs(x).max()))
    h = (h / np.where(weak, 1.0, norm)).T
    gram, own = h @ h.T, h @ rest
    error, unsure = np.empty(len(i)), weak[i] | weak[j]
    for a in range(0, len(i), max(1, block // len(x))):
        p, q = i[a : a + max(1, block // len(x))], j[a : a + max(1, block // len(x))]
        if n == 1:
            left = rest - own[p, None] * h[p]
        else:
            det = 1 - gram[p, q] ** 2
            unsure[a : a + len(p)] |= det < 1e-9
            det = np.where(det < 1e-9, 1.0, det)
            u, v = (own[p] - gram[p, q] * own[q]) / det, (own[q] - gram[p, q] * own[p]) / det
            left = rest - u[:, None] * h[p] - v[:, None] * h[q]
        error[a : a + len(p)] = np.abs(left).mean(1)
    sure = error[~unsure]
    most = sure.min() + slack * max(sure.min(), 1e-3 * float(np.abs(rest).mean())) if len(sure) else np.inf
    return [(a,) if n == 1 else (a, b) for a, b in zip(i[unsure | (error <= most)].tolist(), j[unsure | (error <= most)].tolist(), strict=True)]


def left_out(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each point, how far it is from the median line of all others.

    The slopes of all pairs are sorted once; a point's own are passed over when the median is looked up.
    """
    out = np.full(len(x), np.nan)
    i, j = np.triu_indices(len(x), 1)
    ok = x[i] != x[j]
    i, j = i[ok], j[ok]
    slope = (y[j] - y[i]) / (x[j] - x[i])
    order = np.argsort(slope)
    slope = slope[order]
    owner = np.concatenate([i[order], j[order]])
    place = np.tile(np.arange(len(slope)), 2)
    by = np.lexsort((place, owner))
    cut = np.searchsorted(owner[by], np.arange(len(x) + 1))
    for k in range(len(x)):
        own = place[by[cut[k] : cut[k + 1]]]
        left = len(slope) - len(own)
        if left:
            # The m-th of the others stands at m plus the number of own slopes before it.
            middle = [m + np.searchsorted(own - np.arange(len(own)), m, "right") for m in ((left - 1) // 2, left // 2)]
            s = (slope[middle[0]] + slope[middle[1]]) / 2
            rest = np.delete(np.arange(len(x)), k)
            out[k] = y[k] - (s * x[k] + np.median(y[rest] - s * x[rest]))
    return out


def simplified(x: np.ndarray, y: np.ndarray, tolerance: float) -> list[int]:
    """Knots of a polyline (Ramer, Douglas, Peucker) by vertical distance."""
    keep, todo = {0, len(x) - 1}, [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        line = y[a] + (y[b] - y[a]) * (x[a + 1 : b] - x[a]) / (x[b] - x[a] if x[b] != x[a] else 1)
        gap = np.abs(y[a + 1 : b] - line)
        k = int(gap.argmax())
        if gap[k] > tolerance:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return sorted(keep)


def monotone_path(score: list[np.ndarray], place: list[np.ndarray], penalty: float = 0.05, skip: float = 0.2) -> list[int | None]:
    """The best choice for each step such that places never fall; a step may have none, at a price."""
    # States, one for each last place: value, place and number in `nodes`; they stand in the order in which their places were first reached, and of equal
    # values the one reached first counts. Steps without a choice leave no node.
    nodes: list[tuple[int, int, int]] = []  # node before, step, choice
    values, lasts, ends = np.zeros(1), np.full(1, -np.inf), np.full(1, -1)
    for n, (s, p) in enumerate(zip(score, place, strict=True)):
        found: dict[float, list] = {}  # place: when first reached, best value, when it was reached
        for k, at in enumerate(p.tolist()):
            open_ = np.flatnonzero(lasts <= at)
            if not len(open_):
                continue
            was = lasts[open_]
            got = values[open_] + float(s[k]) - np.where(was == -np.inf, 0.0, penalty * np.abs(at - was) / (1 + abs(at)))
            top = int(got.argmax())
            now = [(int(open_[0]), k + 1), float(got[top]), (int(open_[top]), k + 1)]
            if (had := found.get(at)) is None:
                found[at] = now
            else:
                had[0] = min(had[0], now[0])
                if (-now[1], now[2]) < (-had[1], had[2]):
                    had[1:] = now[1:]
        values = values - skip
        keep, put = np.ones(len(values), bool), []
        for at, (first, value, (e, k)) in found.items():
            end = -1
            for own in np.flatnonzero(lasts == at).tolist():
                keep[own], first = False, min(first, (own, 0))
                if (-values[own], (own, 0)) < (-value, (e, k)):
                    value, end = values[own], int(ends[own])
                    k = 0
            if k:
                nodes.append((int(ends[e]), n, k - 1))
                end = len(nodes) - 1
            put.append((first, value, at, end))
        put.sort()
        where = [e + (k > 0) for (e, k), *_ in put]
        keep = np.insert(keep, where, True)
        values, lasts, ends = (np.insert(old, where, [x[c] for x in put])[keep] for c, old in ((1, values), (2, lasts), (3, ends)))
    out: list[int | None] = [None] * len(score)
    at = int(ends[values.argmax()])
    while at >= 0:
        at, n, choice = nodes[at]
        out[n] = choice
    return out


def longest_chain(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of a longest run, in the order of a, along which b rises strictly (earlier places win ties)."""
    order = np.argsort(a, kind="stable")
    tree: list[tuple[int, int]] = [(0, 1)] * (len(b) + 1)  # length, minus place
    rank = {v: i + 1 for i, v in enumerate(np.unique(b))}
    back: dict[int, int] = {}
    best = (0, 1)
    for k in order.tolist():
        r, found = rank[b[k]] - 1, (0, 1)
        while r > 0:
            found = max(found, tree[r])
            r -= r & -r
        back[k] = -found[1] if found[0] else -1
        mine = (found[0] + 1, -k)
        best = max(best, mine)
        r = rank[b[k]]
        while r <= len(b):
            tree[r] = max(tree[r], mine)
            r += r & -r
    out, k = [], -best[1] if best[0] else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def span_alignment(left: list[str], right: list[str], score: Callable[[str, str], float], most: int = 4, gap: float = 0.48, span: float = 0.02, band: int = 8, bound: Callable[[int, int], float] = lambda n, m: 1.0) -> list[tuple[str, int, int, int, int, float]]:
    """Monotone alignment of runs of up to `most` lines by least cost; the band is widened until the best path keeps off its edge.

    Rows are (kind, left start, left end, right start, right end, score), kind match, left_gap or right_gap. No score of texts of lengths n and m is above bound(n, m).
    """
    n, m = len(left), len(right)
    known: dict[tuple[int, int, int, int], float] = {}
    ends = [list(accumulate(map(len, side), initial=0)) for side in (left, right)]

    def simple(band: int) -> float:
        """What a path of single lines and gaps costs: no move beyond it is on the best path."""
        costs: dict[tuple[int, int], float] = {(0, 0): 0.0}
        for i in range(n + 1):
            centre = i * m // max(1, n)
            for j in range(max(0, centre - band), min(m, centre + band) + 1):
                if (here := costs.get((i, j))) is None:
                    continue
                for to, add in (((i + 1, j), gap), ((i, j + 1), gap), ((i + 1, j + 1), 1 - of(i, i + 1, j, j + 1) if i < n and j < m else np.inf)):
                    if to[0] <= n and to[1] <= m and here + add < costs.get(to, np.inf):
                        costs[to] = here + add
        return costs.get((n, m), np.inf) + 1e-9

    def of(i: int, p: int, j: int, q: int) -> float:
        key = (i, p, j, q)
        if key not in known:
            known[key] = score("".join(left[i:p]), "".join(right[j:q]))
        return known[key]

    while True:
        cost, back = {(0, 0): 0.0}, {}
        edge = False
        most_cost = simple(band)
        for i in range(n + 1):
            centre = i * m // max(1, n)
            for j in range(max(0, centre - band), min(m, centre + band) + 1):
                here = cost.get((i, j))
                if here is None:
                    continue
                if here > most_cost:
                    continue
                moves = [((i + 1, j), gap, "left_gap", 0.0)] if i < n else []
                moves += [((i, j + 1), gap, "right_gap", 0.0)] if j < m else []
                for p in range(i + 1, min(n, i + most) + 1):
                    for q in range(j + 1, min(m, j + most) + 1):
                        extra = span * (p - i + q - j - 2)
                        least = here + extra + 1 - bound(ends[0][p] - ends[0][i], ends[1][q] - ends[1][j])
                        if least > most_cost or least > cost.get((p, q), np.inf):
                            continue
                        s = of(i, p, j, q)
                        moves.append(((p, q), (1 - s) + extra, "match", s))
                for to, add, kind, s in moves:
                    if here + add < cost.get(to, np.inf) - 1e-12:
                        cost[to] = here + add
                        back[to] = ((i, j), kind, s)
        if (n, m) in cost:
            out, at = [], (n, m)
            while at != (0, 0):
                was, kind, s = back[at]
                edge |= abs(was[1] - was[0] * m // max(1, n)) >= band and 0 < was[0] < n
                out.append((kind, was[0], at[0], was[1], at[1], round(s, 6)))
                at = was
            if not edge or band >= max(n, m):
                return out[::-1]
        band *= 2
