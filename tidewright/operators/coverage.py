"""Which observed rows cover a line: by the indices they carry or by time, and by the part of the line that they are likest to."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import text as tx
from tidewright.operators.intervals import overlap_join
from tidewright.operators.recovery import each_row, spread

#: The reach of time, what counts as a longer line, and least scores.
NEAR_MS, LEXICAL, LEAST_SCORE, LEAST_COVER, LEAST_SHORT = 3000, 12, 0.70, 0.65, 0.55
HANGUL = re.compile("[가-힣]")


@lru_cache(1 << 15)
def kept_plain(text: str) -> str:
    return "".join(c for c in tx.fold(text) if c.isalnum())


def plain(text: str) -> str:
    """Folded letters and digits. Those of short texts, which come again and again, are kept, a bounded number of them."""
    return kept_plain(text) if len(text) <= tx.KEPT else "".join(c for c in tx.fold(text) if c.isalnum())


def similarity(a: str, b: str) -> tuple[float, float]:
    """(score, coverage) of two plain texts: the ratio, raised where one holds the other; the ratio of lengths."""
    if not a or not b:
        return 0.0, 0.0
    cover = min(len(a), len(b)) / max(len(a), len(b))
    score = tx.often(a, b)
    return (max(score, 0.45 + 0.5 * cover) if a in b or b in a else score), cover


def bound(a: Counter, n: int, b: str, held: bool) -> float:
    """No score of texts with these characters is higher."""
    return limit(sum((a & Counter(b)).values()), n, len(b)) if held else 2 * sum((a & Counter(b)).values()) / (n + len(b))


def limit(common: int, n: int, m: int) -> float:
    """No score of texts of n and m characters, `common` of them in both, is higher. Only where that is all of one text may the other hold it."""
    return max(2 * common / (n + m), 0.45 + 0.5 * min(n, m) / max(n, m) if common >= min(n, m) else 0.0)


def in_order(o: str, words: list[str], least: int, most: int) -> list[tuple[float, int, int, int]]:
    """(limit of the score, number, start, end) of each run of `least` to `most` words, by length and start: what a run and `o` have in common in order bounds it.

    The runs of one start are lengthened a character at a time (as in `tx.common_subsequence`), so that they share this work.
    """
    places: dict[str, int] = {}
    for j, c in enumerate(o):
        places[c] = places.get(c, 0) | 1 << j
    full, n, found = (1 << len(o)) - 1, len(o), []
    for start in range(len(words) - least + 1):
        row, size = full, 0
        for end in range(start + 1, min(len(words), start + most) + 1):
            for c in words[end - 1]:
                if hit := row & places.get(c, 0):
                    row = (row + hit | row - hit) & full
            size += len(words[end - 1])
            if end - start >= least:
                found.append((end - start, start, limit(n - row.bit_count(), n, size)))
    return [(bound, k, start, start + length) for k, (length, start, bound) in enumerate(sorted(found))]


def best_run(observed: str, line: str) -> tuple[str, float, float, str]:
    """(run, score, coverage, mode) of the run of the line's words that is likest to what was observed, the whole line first.

    Runs have two words less to three more than what was observed. A run whose characters can't reach the best score so far isn't compared.
    Hangul is compared as it sounds too, where that is likelier.
    """
    o = plain(observed)
    words = line.split()

    def scored(run: str, text: str) -> tuple[float, float, str]:
        best = (*similarity(o, text), "text")
        if HANGUL.search(run) and (sounds := similarity(o, plain(tx.romanised(run))))[0] > best[0]:
            best = (*sounds, "korean_pronunciation")
        return best

    best = (line, *scored(line, plain(line)))
    if len(words) < 2:
        return best
    n = max(1, len(observed.split()))
    least, most, parts = max(1, n - 2), min(len(words), n + 3), [plain(w) for w in words]
    run_of = lambda a, b: (" ".join(words[a:b]), "".join(parts[a:b]))
    if not o or HANGUL.search(line):
        for size in range(least, most + 1):
            for start in range(len(words) - size + 1):
                run, text = run_of(start, start + size)
                if (got := scored(run, text))[:2] > best[1:3]:
                    best = (run, *got)
        return best
    # The likeliest runs first; of equals the first by length and start counts, and the whole line before any run.
    top, first, at = best[1:3], -1, (0, 0)
    for bound_, k, a, b in sorted(in_order(o, parts, least, most), key=lambda x: (-x[0], x[1])):
        if bound_ < top[0]:
            break
        got = similarity(o, run_of(a, b)[1])
        if got > top or (got == top and k < first):
            top, first, at = got, k, (a, b)
    return best if first < 0 else (run_of(*at)[0], *top, "text")


def coverage_pairs(events: DataFrame, rows: DataFrame, near_ms: int = NEAR_MS, width: int = 60_000) -> DataFrame:
    """(track, event, row, linked, near): rows that carry an event's index, or lie within `near_ms` of it, each pair once.

    events: track, event, idx, at_ms; rows: track, row, start_ms, end_ms, indices. The disjunction is a union of two hash joins, one by index and
    one by time buckets, so no join compares all rows of a track.
    """
    linked = events.select("track", "event", "idx").join(rows.select("track", "row", F.explode(F.array_distinct("indices")).alias("idx")), ["track", "idx"])
    a = events.select("track", "event", F.col("at_ms").alias("l_start"), F.col("at_ms").alias("l_end"))
    b = rows.select("track", "row", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    near = overlap_join(a, b, ["track"], width, near_ms, strict=False)
    both = linked.select("track", "event", "row", F.lit(True).alias("linked"), F.lit(False).alias("near")).union(near.select("track", "event", "row", F.lit(False), F.lit(True)))
    return both.groupBy("track", "event", "row").agg(F.max("linked").alias("linked"), F.max("near").alias("near"))


def covered(line: str, linked: list[str], near: list[str]) -> tuple[bool, bool, float, float, bool, float, float, bool]:
    """(covered, linked, and of linked and of near rows: score, coverage, exact) of a line by texts in order of time, one by one and together."""
    whole = plain(line)
    known: dict[str, tuple[float, float]] = {}  # a row may be linked and near

    def evidence(texts: list[str]) -> tuple[float, float, bool]:
        if not texts:
            return 0.0, 0.0, False
        seen = [*texts, " ".join(texts)]
        for x in seen:
            if x not in known:
                known[x] = best_run(x, line)[1:3]
        score, cover = max(known[x] for x in seen)
        return score, cover, any(whole in plain(x) for x in seen)

    a, b = evidence(linked), evidence(near)
    if len(whole) >= LEXICAL:
        ok = a[2] or b[2] or any(s >= LEAST_SCORE and c >= LEAST_COVER for s, c, _ in (a, b))
    else:
        ok = bool(linked) or b[0] >= LEAST_SHORT
    return ok, bool(linked), *a, *b


COVERED = "covered boolean, linked boolean, linked_score double, linked_coverage double, linked_exact boolean, near_score double, near_coverage double, near_exact boolean"


def coverage(events: DataFrame, rows: DataFrame, near_ms: int = NEAR_MS) -> DataFrame:
    """(track, event, COVERED) of every event (with its `text`) by the rows (with theirs). An event's rows are those that meet it; they are few."""
    pairs = coverage_pairs(events, rows, near_ms).join(rows.select("track", "row", "start_ms", "end_ms", F.coalesce("text", F.lit("")).alias("said")), ["track", "row"])
    held = lambda flag, out: F.transform(F.array_sort(F.collect_list(F.when(F.col(flag), F.struct("start_ms", "end_ms", "row", "said")))), lambda x: x["said"]).alias(out)
    seen = pairs.groupBy("track", "event").agg(held("linked", "of_index"), held("near", "of_time"))
    whole = events.select("track", "event", F.coalesce("text", F.lit("")).alias("text")).join(seen, ["track", "event"], "left")
    kinds = dict(events.dtypes)
    return each_row(spread(whole), lambda r: [(r["track"], r["event"], *covered(r["text"], r["of_index"] or [], r["of_time"] or []))], f"track {kinds['track']}, event {kinds['event']}, {COVERED}")
