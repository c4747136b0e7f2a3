"""Recovery of cues under review from lines with known times, between and beyond cues whose identity is sure.

Tables: `cues` (task, cue, start_ms, end_ms, key, text; cues of a task are numbered from 0 without gaps), `lines` (task, source, line, at_ms, key, text;
numbered likewise over a task), `decisions` (task, cue, action, reason, score, line, n_lines; line and n_lines null where nothing is claimed). A `key` is a text as it is compared.
What comes back are decisions of the same columns, with the new `text` where one was found.

Runs of cues and their brackets are found by windows over a task. Only islands reach Python: one row for a run of at most a few cues with the few
lines that may be theirs, so no task or source has to fit anywhere as a whole. The fit of a source's rate takes its anchors as one group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import text as tx
from tidewright.operators import folds
from tidewright.operators.timing import AT_ONCE, Policy, Slopes, pairs_of
from tidewright.sources.shared import written

STRONG, EXACT, CAPPED = 0.92, 0.995, 0.91
CONFIRMED, EDGE = "timing_model_confirms_canonical_sequence", "timing_model_confirms_song_edge_canonical"
BOUNDED, FRONTIER = "sequence_projection_confirms_bounded_canonical", "sequence_projection_confirms_frontier_canonical"
#: Reasons of decisions that weaker evidence must not touch.
PROTECTED = (CONFIRMED, EDGE)
MOST_LINES = 4
DECISION = ["action", "reason", "score", "line", "n_lines"]


def each_row(df: DataFrame, fn: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """The rows that `fn` makes of each row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [x for row in b.to_pylist() for x in fn(row)]
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, x, strict=True)) for x in made], schema=kinds)

    return df.mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly, for work that costs much for each row: few bytes would otherwise be few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def by_task() -> object:
    return Window.partitionBy("task").orderBy("cue")


def positioned(lines: DataFrame) -> DataFrame:
    """Lines with their position within their source."""
    return lines.withColumn("pos", F.row_number().over(Window.partitionBy("task", "source").orderBy("line")) - 1)


def stated(cues: DataFrame, lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each cue with its decision and, for a claim of one line, that line's source, position, time and key."""
    one = positioned(lines).select("task", "line", "source", "pos", "at_ms", F.col("key").alias("line_key"))
    d = cues.join(folds.by_merge(decisions.select("task", "cue", *DECISION)), ["task", "cue"], "left")
    claim = (F.col("action") != "review") & (F.col("n_lines") == 1)
    d = d.withColumn("_line", F.when(claim, F.col("line")))
    return d.join(folds.by_merge(one.withColumnRenamed("line", "_line")), ["task", "_line"], "left")


def mix_ms(at: Column | str, m: str = "") -> Column:
    """Where a model puts a source time: source = offset + rate * mix."""
    return F.rint(((F.col(at) if isinstance(at, str) else at) - F.col(f"{m}offset")) / F.col(f"{m}rate")).cast("long")


def untouched(kept: DataFrame, found: DataFrame) -> DataFrame:
    """All decisions, those in `found` (task, cue, action, reason, score, line, n_lines, text) replaced by it."""
    new = found.select("task", "cue", F.struct(*DECISION, "text").alias("_new"))
    out = kept.join(folds.by_merge(new), ["task", "cue"], "left")
    pick = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in DECISION]
    text = F.col("text") if "text" in kept.columns else F.lit(None).cast("string")
    return out.select("task", "cue", *pick, F.coalesce("_new.text", text).alias("text"))


# Projections of sources from sure identities, and what they recover.


def text_anchors(cues: DataFrame, lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """(task, cue, source, pos, start_ms, at_ms, grade) of cues with a strong claim of one line. A: exact, unchanged and unique on both sides."""
    s = stated(cues, lines, decisions).where(F.col("source").isNotNull() & ~F.coalesce(F.col("reason").isin(*PROTECTED), F.lit(False)))
    times = lines.groupBy("task", "source", "key").agg(F.count("*").alias("line_times"))
    s = s.withColumn("cue_times", F.count("*").over(Window.partitionBy("task", "source", "key")))
    s = s.join(folds.by_merge(times.withColumnRenamed("key", "line_key")), ["task", "source", "line_key"])
    exact = (F.col("action") == "unchanged") & (F.col("score") >= EXACT) & (F.col("key") == F.col("line_key")) & (F.col("line_times") == 1) & (F.col("cue_times") == 1)
    return s.where(F.col("score") >= STRONG).select("task", "cue", "source", "pos", "start_ms", "at_ms", F.when(exact, "A").otherwise("B").alias("grade"))


MODEL = "rate double, offset double, rate_source string, n_anchors int, n_exact int, n_inliers int, residual double, inlier_share double, status string"


def projected(x: np.ndarray, y: np.ndarray, exact: int, prior: float | None, policy: Policy = Policy(), residual_ms: float = 450, share: float = 0.75, span_ms: int = 8000) -> tuple:
    """The projection (as in MODEL) of a source with anchors at mix times x and source times y."""
    n = len(x)
    none = lambda why, rate=1.0, told="none": (rate, 0.0, told, n, exact, 0, None, 0.0, why)
    if not (n >= 2 and exact >= 2 if prior is not None else n >= 4 and exact >= 3):
        return none("insufficient_strong_anchors")
    if np.ptp(x) < span_ms or np.ptp(y) < span_ms:
        return none("insufficient_anchor_span")
    s = pairs_of(x, y, policy)[2] if n * n <= AT_ONCE else Slopes(x, y, policy).s
    told = float(np.median(s)) if len(s) else None
    rate, how = (told, "robust_strong_text_anchors") if prior is None else (prior, "exact_rate_prior")
    if rate is None:
        return none("insufficient_rate_evidence")
    if prior is not None and not policy.rates[0] <= prior <= policy.rates[1]:
        return none("invalid_rate_prior", 1.0, how)
    offset = float(np.median(y - rate * x))
    off = np.abs(y - (offset + rate * x))
    near, middle = int((off <= policy.inlier_ms).sum()), float(np.median(off))
    status = "ready" if middle <= residual_ms and near / n >= share else "unstable"
    if prior is not None and told is not None and abs(told - prior) / prior > policy.prior_drift:
        status = "rate_prior_conflict"
    return rate, offset, how, n, exact, near, middle, near / n, status


def projections(anchors: DataFrame, lines: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """(task, source, MODEL) of every source that has lines. priors: (task, source, rate)."""
    sources = lines.select("task", "source").distinct()
    prior = sources.withColumn("prior", F.lit(None).cast("double")) if priors is None else sources.join(folds.by_merge(priors.select("task", "source", F.col("rate").alias("prior"))), ["task", "source"], "left")
    rows = prior.join(folds.by_merge(anchors), ["task", "source"], "left")

    def run(cue: list, start_ms: list, at_ms: list, grade: list, prior: list) -> list[tuple]:
        if cue[0] is None:  # no anchor
            start_ms, at_ms = [], []
        return [projected(np.array(start_ms, np.float64), np.array(at_ms, np.float64), grade.count("A"), prior[0])]

    return folds.by_sorted(rows, ["task", "source"], ["cue"], ["cue", "start_ms", "at_ms", "grade", "prior"], run, MODEL)


def dealt(cues: list[dict], lines: list[dict], right_start: int, right_at: int, most: int = MOST_LINES, start_ms: int = 1300, boundary_ms: int = 2500, over_ms: int = 1500, unit: float = 900.0) -> list[int] | None:
    """How many of a gap's lines each of its cues takes, all of them in order, at the least cost of onsets, boundaries and lengths; None if they can't be dealt.

    cues: start_ms, end_ms, key; lines: mix_ms, key. A programme over (cue, line), from the last cue on; among equals a cue takes fewer lines.
    """
    n, m = len(cues), len(lines)
    if not n or not n <= m <= n * most:
        return None
    starts, at = [c["start_ms"] for c in cues] + [right_start], [x["mix_ms"] for x in lines] + [right_at]
    if any(b <= a for a, b in zip(starts[:-1], starts[1:-1])) or any(b <= a for a, b in zip(at[:-1], at[1:-1])):
        return None
    upto = np.cumsum([0] + [len(x["key"]) for x in lines]).tolist()
    rest: list[tuple[float, int] | None] = [None] * m + [(0.0, 0)]
    takes = []
    for i in range(n - 1, -1, -1):
        row: list[tuple[float, int] | None] = [None] * (m + 1)
        own = max(1, len(cues[i]["key"]))
        for j in range(m):
            onset = abs(at[j] - starts[i])
            if onset > start_ms:
                continue
            for k in range(j + 1, min(m, j + most) + 1):
                bound = abs(at[k] - starts[i + 1])
                if rest[k] is None or at[k - 1] > cues[i]["end_ms"] + over_ms or bound > boundary_ms:
                    continue
                cost = onset / unit + bound / unit + 0.35 * abs(math.log(max(1, upto[k] - upto[j]) / own)) + rest[k][0]
                if row[j] is None or cost < row[j][0]:
                    row[j] = cost, k - j
        takes.append(row)
        rest = row
    out, j = [], 0
    for row in reversed(takes):
        if row[j] is None:
            return None
        out.append(row[j][1])
        j += row[j][1]
    return out


def claimed(cue: dict, lines: list[dict], reason: str, cap: float | None = None, by: str = "key") -> tuple:
    """The decision that a cue is these lines."""
    text = " ".join(x["text"] for x in lines)
    same = cue["key"] == "".join(x["key"] for x in lines) if by == "key" else cue["text"] == text
    score = cue["score"] if cap is None else min(cue["score"], cap)
    return cue["cue"], "unchanged" if same else "replace", reason, score, lines[0]["line"], len(lines), text


FOUND = "action string, reason string, score double, line long, n_lines int, text string"
CUE = ["cue", "start_ms", "end_ms", "key", "text", "action", "reason", "score", "line", "n_lines"]


def structs(columns: list[str], by: str, out: str) -> Column:
    """A group's rows as an array of structs in order of `by`."""
    return F.array_sort(F.collect_list(F.struct(by, *[c for c in columns if c != by]))).alias(out)


def gap_lines(islands: DataFrame, lines: DataFrame, first: Column, last: Column, keys: list[str], at: str = "pos") -> DataFrame:
    """Each island with the lines from `first` to `last` of its task (and source, where `at` is pos) that exist, as an array."""
    on = ["task", "source", "pos"] if at == "pos" else ["task", "line"]
    wanted = islands.select(*dict.fromkeys([*on[:-1], *keys]), F.explode(F.sequence(first, last)).alias(at))
    cols = ["pos", "line", "source", "at_ms", "key", "text"]
    got = wanted.join(folds.by_merge(lines.select("task", *cols)), on).groupBy(*keys).agg(structs(cols, at, "gap"))
    return islands.join(folds.by_merge(got), keys, "left")


def bounded(state: DataFrame, sure: DataFrame, models: DataFrame, lines: DataFrame, most_cues: int = 16) -> DataFrame:
    """Decisions for regions between two sure cues of a source. sure: (task, cue, source, pos, start_ms) of consistent anchors."""
    kinds = dict(state.dtypes)
    mark = sure.select("task", "cue", F.struct("cue", "source", "pos", "start_ms", "at_ms").alias("_sure"))
    order = by_task()
    s = state.select("task", *CUE).join(folds.by_merge(mark), ["task", "cue"], "left")
    s = s.withColumn("_left", F.last("_sure", True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("_right", F.first("_sure", True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    s = s.where("_sure IS NULL AND _left.source = _right.source AND _right.pos > _left.pos + 1")
    # A region is counted before it is gathered, so a long one is never held.
    one = Window.partitionBy("task", "_left.cue")
    s = s.withColumn("_n", F.count("*").over(one)).withColumn("_ok", F.max(F.col("action").eqNullSafe("review")).over(one) & ~F.max(F.coalesce(F.col("reason").isin(*PROTECTED), F.lit(False))).over(one) & (F.min(F.col("action").isNotNull()).over(one)))
    s = s.where(F.col("_ok") & (F.col("_n") <= most_cues) & (F.col("_right.pos") - F.col("_left.pos") - 1 <= MOST_LINES * F.col("_n")))
    islands = s.groupBy("task", F.col("_left.cue").alias("left_cue")).agg(structs(CUE, "cue", "cues"), F.first("_left.source").alias("source"), F.first("_left.pos").alias("low"), F.first("_right").alias("right"))
    islands = gap_lines(islands, lines, F.col("low") + 1, F.col("right.pos") - 1, ["task", "left_cue"])
    islands = islands.join(folds.by_merge(models.select("task", "source", "rate", "offset")), ["task", "source"])
    islands = islands.withColumn("gap", F.transform("gap", lambda x: F.struct(x["line"], x["key"], x["text"], mix_ms(x["at_ms"]).alias("mix_ms")))).withColumn("right_mix", mix_ms(F.col("right.at_ms")))

    def run(row: dict) -> list[tuple]:
        right, gap = row["right"], row["gap"] or []
        if abs(row["right_mix"] - right["start_ms"]) > 750 or (takes := dealt(row["cues"], gap, right["start_ms"], row["right_mix"])) is None:
            return []
        ends = np.cumsum(takes).tolist()
        return [(row["task"], *claimed(c, gap[e - k : e], BOUNDED, CAPPED)) for c, k, e in zip(row["cues"], takes, ends, strict=True)]

    return each_row(islands, run, f"task {kinds['task']}, cue {kinds['cue']}, {FOUND}")


def frontier_step(cue: dict, lines: list[dict], next_start: int | None, backward: bool, most: int = MOST_LINES) -> tuple[int, int | None] | None:
    """How many of the next lines (nearest first) a cue beyond the last sure one takes, and how far the boundary after them is off."""
    best = None
    own = max(1, len(cue["key"]))
    for k in range(1, min(most, len(lines)) + 1):
        took = lines[:k][::-1] if backward else lines[:k]
        onset = abs(took[0]["mix_ms"] - cue["start_ms"])
        if onset > 900 or took[-1]["mix_ms"] > cue["end_ms"] + 1200:
            continue
        target = "".join(x["key"] for x in took)
        like = tx.pair(cue["key"], target)
        if (k > 1 and like < 0.42) or (len(cue["key"]) <= 2 and like < 0.80):
            continue
        bound = abs(lines[k]["mix_ms"] - next_start) if next_start is not None and len(lines) > k else None
        cost = onset / 900 + 0.5 * (1 - like) + 0.25 * abs(math.log(max(1, len(target)) / own)) + (0.0 if bound is None else min(bound, 2500) / 1200)
        if best is None or cost < best[0]:
            best = cost, k, bound
    return best and best[1:]


def frontiers(state: DataFrame, sure: DataFrame, models: DataFrame, lines: DataFrame) -> DataFrame:
    """Decisions beyond the first and the last sure cue of each source, walking outward until timing or text stops agreeing.

    A walk sees no more cues than its source has lines left, and none from the next sure cue on. Of two walks that reach one cue, that of the
    source whose first sure cue is later counts, and of one source the backward one.
    """
    kinds = dict(state.dtypes)
    ends = sure.groupBy("task", "source").agg(F.min(F.struct("cue", "pos")).alias("lo"), F.max(F.struct("cue", "pos")).alias("hi"))
    ends = ends.join(folds.by_merge(lines.groupBy("task", "source").agg((F.max("pos") + 1).alias("n_pos"))), ["task", "source"]).withColumn("first_cue", F.col("lo.cue"))
    walks = ends.select("task", "source", "first_cue", F.lit(1).alias("way"), F.col("hi.cue").alias("from_cue"), F.col("hi.pos").alias("from_pos"), (F.col("n_pos") - 1 - F.col("hi.pos")).alias("n_left"))
    walks = walks.union(ends.select("task", "source", "first_cue", F.lit(-1), F.col("lo.cue"), F.col("lo.pos"), F.col("lo.pos"))).where("n_left > 0")
    # The cues of a walk: a step further than its lines for the next start, up to the next sure cue.
    order = by_task()
    s = state.join(folds.by_merge(sure.select("task", "cue", F.lit(True).alias("_sure"))), ["task", "cue"], "left")
    s = s.withColumn("before_ms", F.lag("start_ms").over(order)).withColumn("after_ms", F.lead("start_ms").over(order))
    step = walks.select("task", "source", "first_cue", "way", "from_pos", "n_left", F.explode(F.sequence(F.lit(1), F.col("n_left"))).alias("step"), "from_cue")
    seen = step.withColumn("cue", (F.col("from_cue") + F.col("way") * F.col("step")).cast(kinds["cue"])).join(folds.by_merge(s.select("task", *CUE, "_sure", "before_ms", "after_ms")), ["task", "cue"])
    seen = seen.groupBy("task", "source", "first_cue", "way", "from_pos", "n_left").agg(structs([*CUE, "_sure", "before_ms", "after_ms"], "step", "cues"))
    first = F.when(F.col("way") == 1, F.col("from_pos") + 1).otherwise(F.lit(0))
    last = F.when(F.col("way") == 1, F.col("from_pos") + F.col("n_left")).otherwise(F.col("from_pos") - 1)
    seen = gap_lines(seen, lines, first, last, ["task", "source", "way"]).join(folds.by_merge(models.select("task", "source", "rate", "offset")), ["task", "source"])
    seen = seen.withColumn("gap", F.transform("gap", lambda x: F.struct(x["line"], x["key"], x["text"], mix_ms(x["at_ms"]).alias("mix_ms"))))

    def run(row: dict) -> list[tuple]:
        way, out = row["way"], []
        lines = (row["gap"] or [])[::way]
        for n, c in enumerate(row["cues"]):
            if c["step"] != n + 1 or c["_sure"] or c["action"] is None or c["reason"] in PROTECTED or not lines:
                break
            other = c["before_ms"] if way == 1 else c["after_ms"]
            if other is not None and (c["start_ms"] - other) * way <= 0:
                break
            after = c["after_ms"] if way == 1 and c["after_ms"] is not None and c["after_ms"] > c["start_ms"] else None
            if (got := frontier_step(c, lines, after, way == -1)) is None:
                break
            took = lines[: got[0]][::way]
            out.append((row["task"], *claimed(c, took, FRONTIER, CAPPED), row["first_cue"], way))
            lines = lines[got[0] :]
            if got[1] is not None and got[1] > 1600:
                break
        return out

    found = each_row(seen, run, f"task {kinds['task']}, cue {kinds['cue']}, {FOUND}, first_cue long, way int")
    last_wins = Window.partitionBy("task", "cue").orderBy(F.desc("first_cue"), F.asc("way"))
    return found.withColumn("_r", F.row_number().over(last_wins)).where("_r = 1").drop("_r", "first_cue", "way")


def sequence_recovered(cues: DataFrame, lines: DataFrame, decisions: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """Decisions after recovery from sequence and time: regions between sure cues, then frontiers. Scores are capped below a strong one."""
    anchors = written(text_anchors(cues, lines, decisions), "anchors")  # read three times, as are the models
    ready = written(projections(anchors, lines, priors).where("status = 'ready'").select("task", "source", "rate", "offset"), "models")
    sure = anchors.join(folds.by_merge(ready), ["task", "source"]).where(F.abs(F.col("start_ms") - mix_ms("at_ms")) <= 750).select("task", "cue", "source", "pos", "start_ms", "at_ms")
    state, placed = stated(cues, lines, decisions).drop("_line", "source", "pos", "at_ms", "line_key"), positioned(lines)
    regions, walks = bounded(state, sure, ready, placed), frontiers(state, sure, ready, placed)
    return untouched(untouched(decisions, regions), walks)


# Recovery between validated anchors of a timing model that is ready by itself.


def gap_by_starts(cues: list[dict], lines: list[dict], right_start: int, start_ms: int = 750, guard_ms: int = 250, most: int = MOST_LINES) -> list[int] | None:
    """How many lines each cue takes: it begins with one at its start and goes on while the next cue isn't due; None if any is left."""
    starts, at = [c["start_ms"] for c in cues] + [right_start], [x["mix_ms"] for x in lines]
    n, m = len(cues), len(lines)
    if not n <= m <= n * most or any(b <= a for a, b in zip(starts, starts[1:])) or any(b <= a for a, b in zip(at, at[1:])):
        return None
    out, j = [], 0
    for i in range(n):
        if j >= m or abs(starts[i] - at[j]) > start_ms:
            return None
        k = j + 1
        while k < m and k - j < most and m - k > n - i - 1 and at[k] < starts[i + 1] - guard_ms:
            k += 1
        out.append(k - j)
        j = k
    return out if j == m else None


def edge_steps(cues: list[dict], lines: list[dict], start_ms: int = 500, skips: int = 3) -> list[tuple[dict, dict]]:
    """Pairs of cues and lines (both nearest to the anchor first) whose times agree; a cue that claims no line may be passed over."""
    out, passed = [], 0
    lines = list(lines)
    for c in cues:
        if not lines:
            break
        if abs(c["start_ms"] - lines[0]["mix_ms"]) <= start_ms:
            out.append((c, lines.pop(0)))
            passed = 0
        elif c["line"] is None and c["n_lines"] is None and passed < skips:
            passed += 1
        else:
            break
    return out


def review_blocks(state: DataFrame, models: DataFrame, most_cues: int, chain: int) -> DataFrame:
    """Runs of cues under review, at most `most_cues` long, with the anchors beside them and whether these end validated chains of `chain` anchors."""
    order = by_task()
    s = state.join(folds.by_merge(models.select("task", "source", "rate", "offset")), ["task", "source"], "left")
    anchor = F.col("source").isNotNull() & (F.col("score") >= STRONG)
    fits = anchor & F.coalesce(F.abs(F.col("start_ms") - mix_ms("at_ms")) <= 750, F.lit(False))
    s = s.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    links = {}
    for way, shift in ((1, F.lead), (-1, F.lag)):
        ok = F.col("_fits")
        for k in range(1, chain):
            # Each further anchor is of the same source and its position follows.
            ok = ok & F.coalesce(shift("_fits", k).over(order) & (shift("source", k).over(order) == F.col("source")) & (shift("pos", k).over(order) == F.col("pos") + way * k) & (shift("cue", k).over(order) == F.col("cue") + way * k), F.lit(False))
        links[way] = ok
    side = lambda way: F.when(anchor, F.struct("source", "pos", F.col("_line").alias("line"), "start_ms", "_fits", links[way].alias("chained"), "rate", "offset"))
    s = s.withColumn("_l", side(-1)).withColumn("_r", side(1))
    under = F.coalesce(F.col("action") == "review", F.lit(False))
    s = s.withColumn("_run", F.count_if(~under).over(order)).withColumn("left", F.lag("_l").over(order)).withColumn("right", F.lead("_r").over(order)).where(under)
    s = s.withColumn("_n", F.count("*").over(Window.partitionBy("task", "_run"))).where(F.col("_n") <= most_cues)
    return s.groupBy("task", "_run").agg(structs(CUE, "cue", "cues"), F.min_by("left", "cue").alias("left"), F.max_by("right", "cue").alias("right"))


def timing_recovered(cues: DataFrame, lines: DataFrame, decisions: DataFrame, models: DataFrame, most_cues: int = 8, chain: int = 2, edge_lines: int = 4) -> DataFrame:
    """Decisions after recovery of reviews by ready models (task, source, status, rate, offset).

    First whole blocks between two anchors of a source that its model confirms, all lines between them dealt; then, from what that gives, blocks at the
    beginning or end of a source beside a chain of confirmed anchors, where onsets agree more closely.
    """
    ready = models.where((F.col("status") == "ready") & F.col("rate").between(0.5, 2.0))
    placed, kinds = positioned(lines), dict(cues.dtypes)
    schema = f"task {kinds['task']}, cue {kinds['cue']}, {FOUND}"
    mixed = lambda side: F.transform("gap", lambda x: F.struct(x["line"], x["pos"], x["source"], x["key"], x["text"], F.rint((x["at_ms"] - F.col(f"{side}.offset")) / F.col(f"{side}.rate")).cast("long").alias("mix_ms")))

    blocks = review_blocks(stated(cues, lines, decisions), ready, most_cues, chain)
    both = blocks.where("left._fits AND right._fits AND left.source = right.source AND right.line > left.line + 1")
    both = both.where(F.col("right.line") - F.col("left.line") - 1 <= MOST_LINES * F.size("cues")).withColumn("source", F.col("left.source"))
    both = gap_lines(both, placed, F.col("left.line") + 1, F.col("right.line") - 1, ["task", "_run"], at="line").withColumn("gap", mixed("left"))

    def inner(row: dict) -> list[tuple]:
        gap, at = row["gap"] or [], 0
        if not gap or any(x["source"] != row["source"] for x in gap):
            return []
        out = []
        for c, k in zip(row["cues"], gap_by_starts(row["cues"], gap, row["right"]["start_ms"]) or [], strict=False):
            out.append((row["task"], *claimed(c, gap[at : at + k], CONFIRMED, by="text")))
            at += k
        return out

    first = written(untouched(decisions, each_row(both, inner, schema)), "decisions")  # read four times

    blocks = review_blocks(stated(cues, lines, first), ready, most_cues, chain)
    size = placed.groupBy("task", "source").agg((F.max("pos") + 1).alias("n_pos"))
    start = blocks.where(f"right.chained AND right.pos BETWEEN 1 AND {edge_lines}").withColumn("source", F.col("right.source"))
    start = gap_lines(start, placed, F.lit(0), F.col("right.pos") - 1, ["task", "_run"]).withColumn("gap", mixed("right"))
    end = blocks.where("left.chained").withColumn("source", F.col("left.source")).join(folds.by_merge(size), ["task", "source"]).where(f"n_pos - 1 - left.pos BETWEEN 1 AND {edge_lines}")
    end = gap_lines(end, placed, F.col("left.pos") + 1, F.col("n_pos") - 1, ["task", "_run"]).withColumn("gap", mixed("left"))

    def walked(way: int) -> Callable[[dict], list[tuple]]:
        return lambda row: [(row["task"], *claimed(c, [x], EDGE, by="text"), row["_run"]) for c, x in edge_steps(row["cues"][::way], (row["gap"] or [])[::way])]

    at_start, at_end = (each_row(df.select("task", "_run", "cues", "gap"), walked(way), f"{schema}, _run long") for df, way in ((start, -1), (end, 1)))
    at_end = at_end.join(folds.by_merge(at_start.select("task", "_run").distinct()), ["task", "_run"], "left_anti")
    return untouched(first, at_start.unionByName(at_end).drop("_run"))
