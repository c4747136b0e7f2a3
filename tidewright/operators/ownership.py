"""Which of two neighbouring cues owns the characters at their boundary: a fold from left to right that may rewrite the row before.

`adjacent_fold` reads each key's rows in order, as they come from Spark's sort, and holds two of them whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import text as tx
from tidewright.operators import folds
from tidewright.operators.repair import key

#: Characters of a fragment, and what a change must gain in score.
FRAGMENT, GAIN, CAPPED = (2, 6), 0.05, 0.90
RESTORED, BY_SEQUENCE = "editor_boundary_ownership_restored", "sequence_projection_confirms_"


def adjacent_fold(df: DataFrame, keys: list[str], order: list[str | Column], step: Callable[[dict, dict], None]) -> DataFrame:
    """The rows of `df` after `step` has met each two neighbours of a key, from left to right, and changed them as it likes."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict | None = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if last is not None:
                    if all(last[k] == row[k] for k in keys):
                        step(last, row)
                    done.append(last)
                last = row
            yield pa.RecordBatch.from_pylist(done, schema=kinds)
        if last is not None:
            yield pa.RecordBatch.from_pylist([last], schema=kinds)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, df.schema)


def changes(was_left: str, was_right: str, left: str, right: str, drops: bool, moves: bool) -> Iterator[tuple[str, str, str]]:
    """(kind, left, right) after each change at the boundary that the original texts speak for.

    A fragment of 2 to 6 characters that ends the original left text, or begins the original right one, goes back to its
    side (move), or is taken from the other side where both have it (drop). No side becomes empty.
    """
    ends, starts, a, b = was_left.strip(), was_right.strip(), left.strip(), right.strip()
    sizes = range(FRAGMENT[0], FRAGMENT[1] + 1)
    tails = [ends[-n:] for n in sizes if n <= len(ends) and len(key(ends[-n:])) >= FRAGMENT[0]]
    heads = [starts[:n] for n in sizes if n <= len(starts) and len(key(starts[:n])) >= FRAGMENT[0]]
    found: list[tuple[str, str, str]] = []
    if drops:
        found += [("drop", left, b[len(t) :].lstrip()) for t in tails if a.endswith(t) and b.startswith(t) and not starts.startswith(t)]
        found += [("drop", a[: -len(h)].rstrip(), right) for h in heads if a.endswith(h) and b.startswith(h) and not ends.endswith(h)]
    if moves:
        found += [("move", left.rstrip() + t, b[len(t) :].lstrip()) for t in tails if b.startswith(t) and not a.endswith(t)]
        found += [("move", a[: -len(h)].rstrip(), h + right.lstrip()) for h in heads if a.endswith(h) and not b.startswith(h)]
    yield from (x for x in found if x[1] and x[2])


def settled(was_left: str, was_right: str, left: str, right: str, drops: bool, moves: bool) -> tuple[str, str] | None:
    """Both texts after the change that gains most (the first of equals), None where none gains enough or it breaks the joint text."""
    like = lambda a, b: tx.pair(key(was_left), key(a)) + tx.pair(key(was_right), key(b))
    now, best = like(left, right) / 2, None
    for kind, a, b in changes(was_left, was_right, left, right, drops, moves):
        gain = like(a, b) / 2 - now
        if gain >= GAIN and (best is None or gain > best[0]):
            best = gain, kind, a, b
    if best is None:
        return None
    _, kind, a, b = best
    old, new = key(left + right), key(a + b)
    fine = old == new if kind == "move" else FRAGMENT[0] <= len(old) - len(new) <= FRAGMENT[1]
    return (a, b) if fine else None


def guard(left: dict, right: dict) -> None:
    """One step: rows (text, key, action, reason, score, line, n_lines, new_text) of two neighbouring cues; `new_text` is what is decided so far."""
    if left["action"] is None or right["action"] is None:
        return

    def made(row: dict) -> bool:
        """Whether the decision itself changed the text to what it is."""
        return row["action"] == "replace" and bool(row["new_text"]) and key(row["now"]) != row["key"] and key(row["new_text"]) == key(row["now"])

    sequence = any(x["reason"].startswith(BY_SEQUENCE) for x in (left, right))
    got = settled(left["text"], right["text"], left["now"], right["now"], sequence or made(left) or made(right), sequence)
    if got is not None:
        for row, text in zip((left, right), got, strict=True):
            row |= {"now": text, "new_text": text, "reason": RESTORED, "score": min(row["score"], CAPPED), "line": None, "n_lines": None, "action": "unchanged" if key(text) == row["key"] else "replace"}


def ownership_restored(cues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (task, cue, action, reason, score, line, n_lines, text) after characters at boundaries have gone back to the cue that had them.

    Moves need a decision made by sequence on either side; a copy is dropped also where either side's own replacement explains it.
    Texts keep their joint characters, but for one dropped copy; times and numbers of cues don't change.
    """
    d = cues.select("task", "cue", "text", "key").join(folds.by_merge(decisions.select("task", "cue", "action", "reason", "score", "line", "n_lines", F.col("text").alias("new_text"))), ["task", "cue"], "left")
    d = d.withColumn("now", F.coalesce("new_text", "text"))
    out = adjacent_fold(d, ["task"], ["cue"], guard).where("action IS NOT NULL")
    return out.select("task", "cue", "action", "reason", "score", "line", "n_lines", F.col("new_text").alias("text"))
