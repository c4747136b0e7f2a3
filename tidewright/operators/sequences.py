"""Ordered observations against ordered events: one best path through both, and words that move between neighbouring cues until none gains.

`aligned` first finds the spans of events near each observation in time (a join by time buckets) and scores them, so the path is sought among few
edges. `resegmented` takes turns over each key's cues, or over a table for long keys: each turn looks only at pairs of cues of which one changed in the turn before.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from tidewright.functions import matching
from tidewright.functions import text as tx
from tidewright.operators import folds
from tidewright.operators.coverage import HANGUL, plain, similarity
from tidewright.operators.intervals import overlap_join
from tidewright.operators.recovery import each_row, spread, structs
from tidewright.sources.shared import written

#: The reach of time, events of a span, and what skipping costs (a vocalisation, anything else).
REACH_MS, SPAN, SKIP_SEEN, SKIP_EVENT = 5500, 3, (0.06, 0.34), (0.18, 0.62)
#: Syllables without meaning.
LATIN_SOUNDS, HAN_SOUNDS = frozenset("ah ha hey huh la na oh ooh uh yeah".split()), frozenset("啊阿哈啦拉呐哪哦噢喔吧诶哎")
WORDLIKE = r"[A-Za-z0-9]+(?:['’][A-Za-z0-9]+)?|[가-힣]+"
UNIT = re.compile(WORDLIKE + r"|[一-鿿]|[^\W_]")


def vocal(text: str) -> bool:
    """Only syllables without meaning."""
    found, whole = re.findall("[a-z]+", tx.fold(text)), plain(text)
    return bool(whole) and ((bool(found) and whole == "".join(found) and LATIN_SOUNDS.issuperset(found)) or HAN_SOUNDS.issuperset(whole))


def said(observed: str, text: str) -> tuple[float, float, str]:
    """(score, coverage, mode) of a text for what was observed; Hangul as it is written or as it sounds, whichever is likelier."""
    o = plain(observed)
    best = (*similarity(o, plain(text)), "text")
    if HANGUL.search(text) and (sounds := similarity(o, plain(tx.romanised(text))))[0] > best[0]:
        best = (*sounds, "korean_pronunciation")
    return best


@F.pandas_udf(StructType([StructField("score", DoubleType()), StructField("cover", DoubleType())]))
def said_score(observed: pd.Series, text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([said(a, b)[:2] for a, b in zip(observed, text, strict=True)], columns=["score", "cover"])


@F.pandas_udf(BooleanType())
def is_vocal(text: pd.Series) -> pd.Series:
    return text.map(vocal)


@F.pandas_udf(IntegerType())
def plain_length(text: pd.Series) -> pd.Series:
    return text.map(lambda t: len(plain(t)))


def edges(observations: DataFrame, events: DataFrame, by: str) -> DataFrame:
    """Steps that a path may take: (by, i, low, high, reused, gain): observation i consumes events [low, high), after the one before them where reused.

    observations: by, i, start_ms, end_ms, text; events: by, j, at_ms, text; i and j number each side of `by` from 0. `gain` is what the step
    brings over skipping what it consumes. Times of events rise with j, or nearly so.
    """
    order = Window.partitionBy(by).orderBy("j")
    e = events.select(by, "j", "at_ms", "text", F.when(is_vocal("text"), SKIP_EVENT[0]).otherwise(SKIP_EVENT[1]).alias("lost"))
    ahead = order.rowsBetween(0, SPAN - 1)
    e = e.withColumn("run", F.collect_list(F.struct("at_ms", "text", "lost")).over(ahead)).withColumn("n", F.explode(F.sequence(F.lit(1), F.size("run"))))
    run = F.slice("run", 1, F.col("n"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    spans = e.select(by, "j", "n", F.col("at_ms").alias("first_ms"), F.element_at(run, -1)["at_ms"].alias("last_ms"), F.array_join(F.transform(run, lambda x: x["text"]), " ").alias("span"), total(F.transform(run, lambda x: x["lost"])).alias("lost"), F.col("lost").alias("lost_first"))
    spans = spans.withColumn("r_start", F.least("first_ms", "last_ms")).withColumn("r_end", F.greatest("first_ms", "last_ms"))
    seen = observations.select(by, "i", F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"), "text", F.when((plain_length("text") < 2) | is_vocal("text"), SKIP_SEEN[0]).otherwise(SKIP_SEEN[1]).alias("lost_seen"))
    met = overlap_join(seen, spans, [by], 60_000, REACH_MS, strict=False, dear=True)
    off = F.when(F.col("last_ms") < F.col("l_start"), F.col("l_start") - F.col("last_ms")).when(F.col("first_ms") > F.col("l_end"), F.col("first_ms") - F.col("l_end")).otherwise(0)
    met = met.withColumn("off", off).where(F.col("off") <= REACH_MS)
    met = met.select(by, "i", "j", "n", "off", "lost", "lost_first", "lost_seen", said_score("text", "span").alias("s"))
    timing = lambda inside, near: F.when(F.col("off") == 0, inside).otherwise(F.greatest(F.lit(-1.25), near - F.col("off") / 3500.0))
    reward = 3.25 * F.col("s.score") + 0.80 * F.col("s.cover")
    step = lambda low, reused, gain: F.struct(low.alias("low"), (F.col("j") + F.col("n")).alias("high"), F.lit(reused).alias("reused"), gain.alias("gain"))
    new = F.when((F.col("off") == 0) | (F.col("s.score") >= 0.25) | (F.col("s.cover") >= 0.24), step(F.col("j"), False, reward + timing(1.05, 0.20) - 0.16 * (F.col("n") - 1) + F.col("lost") + F.col("lost_seen")))
    # The event before may be used again, alone or with new ones.
    again = F.when((F.col("s.score") >= 0.48) & (F.col("s.cover") >= 0.32), step(F.col("j") + 1, True, reward + timing(0.85, 0.10) - 0.28 - 0.16 * (F.col("n") - 1) + F.col("lost") - F.col("lost_first") + F.col("lost_seen")))
    # Both steps come from one row: as a union, or by filters on the score, Spark would compare the texts once for each.
    return met.select(by, "i", F.inline(F.filter(F.array(new, again), lambda x: x.isNotNull())))


def heaviest(i: list[int], low: list[int], high: list[int], gain: list[float]) -> list[int]:
    """The numbers of the steps of the path that gains most: i rises, and low never falls below the high before it.

    Steps are taken by i; a tree of greatest gains by `high` tells the best path that a step may follow. Time grows with the logarithm of the places.
    """
    places = sorted({*low, *high})
    rank = {p: k + 1 for k, p in enumerate(places)}
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(places) + 1)
    before, best = [-1] * len(i), (0.0, -1)
    order = sorted(range(len(i)), key=lambda k: (i[k], low[k], high[k], -gain[k]))
    at = 0
    while at < len(order):
        end = at
        while end < len(order) and i[order[end]] == i[order[at]]:
            end += 1
        made = []
        for k in order[at:end]:
            p, top = rank[low[k]], (0.0, -1)
            while p:
                if tree[p][0] > top[0]:
                    top = tree[p]
                p -= p & -p
            before[k] = top[1]
            if top[0] + gain[k] > 0:
                made.append((top[0] + gain[k], k))
        for value, k in made:  # steps of one observation don't follow each other
            best = max(best, (value, k), key=lambda x: x[0])
            p = rank[high[k]]
            while p <= len(places):
                if value > tree[p][0]:
                    tree[p] = value, k
                p += p & -p
        at = end
    out, k = [], best[1]
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def aligned(observations: DataFrame, events: DataFrame, by: str) -> DataFrame:
    """(by, i, low, high, reused, gain) of the best path of each `by`. What no step consumes is skipped. Only steps near in time are held for a group."""
    e = edges(observations, events, by)

    def run(*columns: list) -> list[tuple]:
        rows = list(zip(*columns, strict=True))
        return [rows[k] for k in heaviest(*(columns[c] for c in (0, 1, 2, 4)))]

    return folds.by_sorted(e, [by], ["i", "low", "high", F.desc("gain"), "reused"], ["i", "low", "high", "reused", "gain"], run, ", ".join(f"{c} {t}" for c, t in e.dtypes[1:]))


# Words between neighbouring cues.


def joined(units: list[str]) -> str:
    out = ""
    for u in units:
        out += (" " if out and re.fullmatch(WORDLIKE, u) and re.search("[A-Za-z0-9가-힣]$", out) else "") + u
    return out


def resplit(left: str, right: str, seen_left: str, seen_right: str) -> tuple[str, str, float] | None:
    """(left, right, gain) where another cut of the joint words is clearly likelier to what was observed on both sides, else None."""
    a, b = UNIT.findall(left), UNIT.findall(right)
    units, now = a + b, len(a)
    o, q = plain(seen_left), plain(seen_right)
    if len(o) < 2 or len(q) < 2 or not a or not b:
        return None
    best = None
    # Texts in ASCII sound as they are written, and are compared as the letters of their words one after the other.
    forms = [plain(u) for u in units] if left.isascii() and right.isascii() else None
    most = lambda n, m: 2.0 * min(n, m) / (n + m)
    for mode in ("text",) if forms else ("text", "korean_pronunciation"):
        form = (lambda t: plain(tx.romanised(t))) if mode != "text" else plain
        cut_at = (lambda k: ("".join(forms[:k]), "".join(forms[k:]))) if forms else lambda k: (form(joined(units[:k])), form(joined(units[k:])))
        sides = lambda k: tuple(map(tx.often, (o, q), cut_at(k)))
        start = sum(sides(now)) / 2
        top = start, now
        upto = [*accumulate(map(len, forms))] if forms else None
        for k in range(1, len(units)):
            if forms and (most(len(o), upto[k - 1]) + most(len(q), upto[-1] - upto[k - 1])) / 2 <= top[0]:
                continue
            x, y = cut_at(k)
            if (most(len(o), len(x)) + most(len(q), len(y))) / 2 > top[0] and (s := (tx.often(o, x) + tx.often(q, y)) / 2) > top[0]:
                top = s, k
        got = (top[0] - start, top[0], top[1], mode, min(sides(top[1])))
        if best is None or got[:2] > best[:2]:
            best = got
    gain, score, cut, mode, least = best
    sure = taken(cut, now, gain, score, least) if mode == "text" else cut != now and score >= 0.78 and gain >= 0.18
    return (joined(units[:cut]), joined(units[cut:]), gain) if sure else None


def measured(text: str) -> tuple[list[str], str, list[int]]:
    """(units, their letters and digits one after the other, where each unit's end) of a text in ASCII."""
    units = UNIT.findall(text)
    whole = "".join(units)
    sizes = map(len, units) if "'" not in whole else (len(u) - u.count("'") for u in units)
    return units, whole.replace("'", "").lower(), [*accumulate(sizes)]


kept_measures = lru_cache(1 << 14)(measured)


def resplits(asked: list[tuple[str, str, str, str]]) -> list[tuple[str, str, float] | None]:
    """`resplit` of each (left, right, seen left, seen right); texts are compared many at a time.

    Cuts are scored where lengths leave a chance that the best of them is taken.
    """
    out: dict[tuple, tuple[str, str, float] | None] = {}
    now, pairs = [], []
    for x in dict.fromkeys(asked):
        left, right, seen_left, seen_right = x
        if not (left.isascii() and right.isascii()):
            out[x] = resplit(*x)
            continue
        out[x] = None
        a, b = (kept_measures(s) if len(s) <= tx.KEPT else measured(s) for s in (left, right))
        o, q = plain(seen_left), plain(seen_right)
        if len(o) >= 2 and len(q) >= 2 and a[0] and b[0]:
            now.append((x, o, q, a, b))
            pairs += [(o, a[1]), (q, b[1])]
    scores = matching.ratios(pairs)
    start = (np.array(scores[::2]) + np.array(scores[1::2])) / 2
    open_ = np.flatnonzero(start <= 0.9801)
    many = [len(now[k][3][0]) + len(now[k][4][0]) - 1 for k in open_.tolist()]
    size = np.array([e for k in open_.tolist() for at in (len(now[k][3][1]),) for e in (*now[k][3][2], *[at + e for e in now[k][4][2][:-1]])], np.float64)
    n, m, whole = (np.repeat([f(now[k]) for k in open_.tolist()], many) for f in (lambda x: len(x[1]), lambda x: len(x[2]), lambda x: len(x[3][1]) + len(x[4][1])))
    which = np.repeat(open_, many)
    bound = np.minimum(n, size) / (n + size) + np.minimum(m, whole - size) / (m + whole - size)
    cut = np.arange(len(size)) - np.repeat(np.cumsum([0, *many])[:-1], many) + 1
    bound[cut == np.repeat([len(now[k][3][0]) for k in open_.tolist()], many)] = -1.0
    may = np.flatnonzero(bound >= np.maximum(start[which] + 0.0199, 0.7899))
    may = may[np.lexsort((cut[may], -bound[may], which[may]))]
    ahead = np.diff(which[may], prepend=-1) > 0
    best: dict[int, tuple[float, int, float]] = {}
    # First the likeliest cut of each, then those that may be as good.
    for some in (may[ahead], may[~ahead]):
        least = np.array([best[k][0] if k in best else 0.0 for k in which[some].tolist()])
        some = some[bound[some] >= least]
        tried, pairs = list(zip(which[some].tolist(), cut[some].tolist(), strict=True)), []
        for (k, _), s in zip(tried, size[some].astype(int).tolist(), strict=True):
            _, o, q, a, b = now[k]
            text = a[1] + b[1]
            pairs += [(o, text[:s]), (q, text[s:])]
        scores = matching.ratios(pairs)
        for (k, c), s, r in zip(tried, scores[::2], scores[1::2], strict=True):
            best[k] = max(best.get(k, (0.0,)), ((s + r) / 2, -c, min(s, r)))
    for k, (score, c, least) in best.items():
        x, _, _, (a, *_), (b, *_) = now[k]
        if taken(-c, len(a), score - float(start[k]), score, least):
            out[x] = joined((a + b)[:-c]), joined((a + b)[-c:]), score - float(start[k])
    return [out[x] for x in asked]


def taken(cut: int, now: int, gain: float, score: float, least: float) -> bool:
    """Whether another cut of texts as they are written is clearly likelier."""
    return cut != now and ((gain >= 0.02 and 1 <= abs(cut - now) <= 3 and least >= 0.96) or (score >= 0.79 and gain >= 0.15))


def preferences(rows: list[tuple[str | None, str | None, float | None, str | None]]) -> list[str]:
    """`preferred` of each (seen, again, sure, text); texts are compared many at a time."""
    out, open_, pairs = [], [], []
    for k, (first, second, sure, text) in enumerate(rows):
        first, second, text = first or "", (second or "").strip(), text or ""
        if second and (sure or 0.0) >= 0.60 and first != second:
            if not text.isascii() and HANGUL.search(text):
                first = preferred({"c_seen": first, "c_again": second, "c_sure": sure, "c_text": text}, "c")
            else:
                open_.append((k, second))
                pairs += [(plain(second), plain(text)), (plain(first), plain(text))]
        out.append(first)
    scores = [0.0 if not a or not b else max(s, 0.45 + 0.5 * (min(len(a), len(b)) / max(len(a), len(b)))) if a in b or b in a else s for (a, b), s in zip(pairs, matching.ratios(pairs), strict=True)]
    for (k, second), fit, other in zip(open_, scores[::2], scores[1::2], strict=True):
        if fit >= 0.50 and fit >= other + 0.04:
            out[k] = second
    return out


def preferred(row: dict, side: str) -> str:
    """What was observed of a cue: a second observation where it is sure and fits the text clearly better."""
    first, second = row[f"{side}_seen"] or "", (row[f"{side}_again"] or "").strip()
    if not second or (row[f"{side}_sure"] or 0.0) < 0.60:
        return first
    fit, other = said(second, row[f"{side}_text"])[0], said(first, row[f"{side}_text"])[0]
    return second if fit >= 0.50 and fit >= other + 0.04 else first


def apart(pairs: list[dict]) -> list[dict]:
    """Of pairs of neighbours those that gain most, no cue in two of them."""
    out, used = [], set()
    for p in sorted(pairs, key=lambda p: (-p["gain"], p["cue"])):
        if not {p["cue"], p["cue"] + 1} & used:
            used |= {p["cue"], p["cue"] + 1}
            out.append(p)
    return out


#: Cues of a key up to which it is one list in one task. Longer keys turn over a table, where no task holds a key.
WHOLE = 10_000
CUE = ["cue", "start_ms", "end_ms", "text", "seen", "again", "sure", "fixed"]


def settled_turns(starts: list[int], cues: dict[str, list], turns: int, gap_ms: int) -> tuple[list[str], list[int]]:
    """(texts, turns in which they changed) after all turns over the cues of some keys, each key's in order of `cue` from one of `starts` to the next."""
    texts, moved, fixed, cue, first = [*cues["text"]], [0] * len(cues["text"]), cues["fixed"], cues["cue"], set(starts)
    heard: dict[int, str] = {}
    near = [
        k for k, (end, start) in enumerate(zip(cues["end_ms"], cues["start_ms"][1:]))
        if k + 1 not in first and cue[k] + 1 == cue[k + 1] and fixed[k] is False and fixed[k + 1] is False and None not in (end, start) and start - end <= gap_ms
    ]
    pairs = near
    for _ in range(turns):
        new = [k for k in dict.fromkeys(x for k in pairs for x in (k, k + 1)) if k not in heard]
        heard.update(zip(new, preferences([(cues["seen"][k], cues["again"][k], cues["sure"][k], texts[k]) for k in new]), strict=True))
        got = resplits([(texts[k] or "", texts[k + 1] or "", heard[k], heard[k + 1]) for k in pairs])
        found = [{"cue": k, "left": x[0], "right": x[1], "gain": x[2]} for k, x in zip(pairs, got, strict=True) if x]
        changed = set()
        for p in apart(found):  # cues of two keys are never in one pair
            for k, side in ((p["cue"], "left"), (p["cue"] + 1, "right")):
                texts[k], moved[k] = p[side], moved[k] + 1
                heard.pop(k)
                changed.add(k)
        pairs = [k for k in near if k in changed or k + 1 in changed]
        if not pairs:
            break
    return texts, moved


def resegmented(cues: DataFrame, by: str, turns: int = 6, gap_ms: int = 1200) -> DataFrame:
    """`cues` (by, cue, start_ms, end_ms, text, seen, again, sure, fixed) with texts after at most `turns` turns, and `moved`: the turns in which a cue changed.

    seen is what was observed, again and sure a second observation and its score; fixed cues stay. A key of at most WHOLE cues takes all its turns in one task; cues of
    longer ones turn over a table.
    """
    out = cues.select(by, *CUE).withColumn("moved", F.lit(0))
    sized = written(cues.select(by, *CUE).withColumn("_n", F.count("*").over(Window.partitionBy(by))), "cues")

    def run(starts: list[int], *columns: list) -> tuple[range, list[list]]:
        return range(starts[-1]), [*settled_turns(starts, dict(zip(CUE, columns, strict=True)), turns, gap_ms)]

    short = sized.where((F.col("_n") <= WHOLE) & F.col(by).isNotNull()).withColumnRenamed("text", "_text")
    own = ["_text" if c == "text" else c for c in CUE]
    done = folds.by_blocks(short, [by], ["cue"], own, run, "text string, moved int", tuple(c for c in CUE if c != "text")).select(*out.columns)
    large = sized.where((F.col("_n") > WHOLE) | F.col(by).isNull()).drop("_n")
    return done if large.isEmpty() else done.union(by_turns(large, by, turns, gap_ms))


def by_turns(cues: DataFrame, by: str, turns: int, gap_ms: int) -> DataFrame:
    """`resegmented` for keys of any number of cues. Between turns the table is written out; it stops when nothing changes."""
    side = lambda x: F.struct("start_ms", "end_ms", "text", "seen", "again", "sure", "fixed").alias(x)
    kinds = dict(cues.dtypes)
    state = written(cues.withColumn("moved", F.lit(0)).withColumn("_changed", F.lit(True)), "cues")
    for turn in range(turns):
        near = state.where("_changed").select(by, F.explode(F.array((F.col("cue") - 1).cast(kinds["cue"]), "cue")).alias("cue")).distinct()
        left, right = state.select(by, "cue", side("l")), state.select(by, (F.col("cue") - 1).cast(kinds["cue"]).alias("cue"), side("r"))
        pairs = near.join(left, [by, "cue"]).join(right, [by, "cue"]).where(f"NOT l.fixed AND NOT r.fixed AND r.start_ms - l.end_ms <= {gap_ms}")
        pairs = pairs.select(by, "cue", *[F.coalesce(f"{s}.text", F.lit("")).alias(f"{s}_text") for s in "lr"], *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "lr" for c in ("seen", "again", "sure")])

        def better(row: dict) -> list[tuple]:
            got = resplit(row["l_text"], row["r_text"], preferred(row, "l"), preferred(row, "r"))
            return [(row[by], row["cue"], *got)] if got else []

        found = written(each_row(spread(pairs), better, f"{by} {kinds[by]}, cue {kinds['cue']}, left string, right string, gain double"), "pairs")
        if found.isEmpty():
            break
        # Pairs that share cues form runs; of each run some are taken.
        runs = found.withColumn("_run", F.col("cue") - F.row_number().over(Window.partitionBy(by).orderBy("cue"))).groupBy(by, "_run").agg(structs(["cue", "left", "right", "gain"], "cue", "pairs"))
        texts = each_row(runs, lambda r: [(r[by], p["cue"] + k, p[s]) for p in apart(r["pairs"]) for k, s in enumerate(("left", "right"))], f"{by} {kinds[by]}, cue {kinds['cue']}, _new string")
        state = state.join(texts, [by, "cue"], "left").withColumn("_changed", F.col("_new").isNotNull())
        state = state.withColumn("moved", F.col("moved") + F.col("_changed").cast("int")).withColumn("text", F.coalesce("_new", "text")).drop("_new")
        state = written(state, "cues")
    return state.drop("_changed")
