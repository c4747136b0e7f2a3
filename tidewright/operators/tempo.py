"""Recovery of reviews where a source's rate is known from its tempo: single lines, and streams of characters dealt to consecutive cues.

Tables as in `recovery`; decisions have the `text` decided so far, priors (task, source, rate) come from tempos. Everything about a single cue is
windows, joins and expressions. A region between two inliers of one source reaches Python as one row; its lines are counted, by their running length
within the source, before they are gathered.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tidewright.functions import text as tx
from tidewright.operators import folds
from tidewright.operators.recovery import CUE, FOUND, by_task, each_row, gap_lines, mix_ms, positioned, structs, untouched
from tidewright.operators.repair import content, key, rendered, shared_out
from tidewright.operators.timing import AT_ONCE, Policy, Slopes, pairs_of
from tidewright.sources.shared import written

#: Reasons of decisions that may tell the offset, and syllables without meaning.
SAFE = ("canonical_content_matches_source_segmentation", "high_confidence_span_preserving_match")
HAN_SOUNDS = frozenset("哦噢啊阿耶呀哎哟呃呜喔嘿哈啦嗯哼唔诶哒")
LATIN_SOUNDS = frozenset("oh ooh ah uh huh hey yeah ya yo woo woah whoa hmm mm na la".split())
EDGE_MARKS = " ,，。.!！?？、-—"
MAPPED, TRIMMED, STREAM = "bpm_projection_confirms_mapped_canonical", "bpm_projection_trims_optional_vocalization", "sequence_projection_confirms_bpm_bounded_stream"
MOST_CUES, LEAST_RATIO, LEAST_UNMAPPED, LEAST_SHORT = 12, 0.45, 0.25, 0.80
LATIN = re.compile("[A-Za-z]+")


def vocal(text: str) -> bool:
    """Only syllables without meaning: Han ones, or Latin words and nothing else."""
    k = key(text)
    if not k:
        return False
    words = LATIN.findall(text.casefold())
    return HAN_SOUNDS.issuperset(k) or (bool(words) and not re.search("[^a-z]", k) and LATIN_SOUNDS.issuperset(words))


def without_sounds(text: str) -> str:
    """The text without such syllables at its ends."""
    t = text.strip()
    while t and t[0] in HAN_SOUNDS:
        t = t[1:].lstrip(EDGE_MARKS)
    while t and t[-1] in HAN_SOUNDS:
        t = t[:-1].rstrip(EDGE_MARKS)
    t = t.strip()
    for edge in (r"^\s*([A-Za-z]+)(?:\s+|[,，。.!！?？、—-]+\s*)", r"(?:\s+|\s*[,，。.!！?？、—-]+\s*)([A-Za-z]+)\s*$"):
        while (m := re.search(edge, t)) and m[1].casefold() in LATIN_SOUNDS:
            t = (t[: m.start()] + t[m.end() :]).strip()
    return t


def trims(text: str, line: str) -> bool:
    """Whether syllables at its ends are all that tells the text from the line."""
    t = without_sounds(text)
    return key(text) != key(line) and bool(t) and t != text.strip() and key(t) == key(line)


def shared_end(a: str, b: str, most: int = 8) -> bool:
    """Whether either text begins or ends with 2 to 8 characters with which the other begins or ends."""
    sizes = range(2, min(most, len(a), len(b)) + 1)
    return any(a.startswith(b[:n]) or a.endswith(b[-n:]) for n in sizes)


def continued(cue: str, line: str, before: str | None, after: str | None) -> bool:
    """Whether the rest of the line seems to be in the next cue or the one before."""
    if not cue or not line or cue == line:
        return False
    rest = [(after, line[len(cue) :])] if line.startswith(cue) else []
    rest += [(before, line[: len(line) - len(cue)])] if line.endswith(cue) else []
    return any(x is not None and shared_end(x, y) for x, y in rest)


def owns_more(cue: str, before: str | None, after: str | None, most: int = 8) -> bool:
    """Whether the cue begins with the end of the line before, or ends with the beginning of the one after."""
    head = any(cue.startswith(before[-n:]) for n in range(2, min(most, len(before), len(cue)) + 1)) if before else False
    return head or (any(cue.endswith(after[:n]) for n in range(2, min(most, len(after), len(cue)) + 1)) if after else False)


@F.pandas_udf(BooleanType())
def is_vocal(text: pd.Series) -> pd.Series:
    return text.map(vocal, na_action="ignore")


@F.pandas_udf(StructType([StructField(c, BooleanType()) for c in ("trims", "guarded")]))
def compared(text: pd.Series, cue: pd.Series, line_text: pd.Series, line: pd.Series, cue_before: pd.Series, cue_after: pd.Series, line_before: pd.Series, line_after: pd.Series) -> pd.DataFrame:
    rows = zip(text, cue, line_text, line, cue_before, cue_after, line_before, line_after, strict=True)
    return pd.DataFrame([(trims(t, u), continued(c, x, cb, ca) or owns_more(c, lb, la)) for t, c, u, x, cb, ca, lb, la in rows], columns=["trims", "guarded"])


MODEL = "rate double, offset double, n_anchors int, n_inliers int, residual double, inlier_share double, rate_error double, status string, first_cue long, last_cue long, first_line long, last_line long, first_pos long"


def fitted(cue: list, line: list, lex: list, start_ms: list, at_ms: list, rate: float | None, p: Policy = Policy()) -> tuple:
    """The MODEL of anchors, in order of cues, at a known rate."""
    n, x, y = len(cue), np.array(start_ms, np.float64), np.array(at_ms, np.float64)
    none = lambda why, offset=0.0, k=0: (rate or 1.0, offset, n, k, None, k / n if n else 0.0, None, why, *[None] * 5)
    if rate is None:
        return none("no_bpm_prior")
    if n < 3:
        return none("insufficient_safe_anchors")
    within = lambda offset: np.abs(y - (offset + rate * x)) <= p.inlier_ms
    offset = float(np.median(y - rate * x))
    near = within(offset)
    if near.sum() < 3:
        return none("bpm_projection_unstable", offset, int(near.sum()))
    offset = float(np.median((y - rate * x)[near]))
    near = within(offset)
    off, k = np.abs(y - (offset + rate * x))[near], int(near.sum())
    s = pairs_of(x[near], y[near], p)[2] if k * k <= AT_ONCE else Slopes(x[near], y[near], p).s
    error = abs(float(np.median(s)) - rate) / rate if len(s) else None
    at = np.flatnonzero(near).tolist()
    own = [line[i] for i in at]
    ready = k >= 3 and k / n >= 0.75 and np.median(off) <= 300 and x[near][-1] - x[near][0] >= 8000 and y[near][-1] - y[near][0] >= 8000 and all(a < b for a, b in zip(own, own[1:])) and error is not None and error <= 0.025
    ends = (cue[at[0]], cue[at[-1]], own[0], own[-1], lex[at[0]]) if k else (None,) * 5
    return rate, offset, n, k, float(np.median(off)) if k else None, k / n, error, "ready" if ready else "bpm_projection_unstable", *ends


def lexical(lines: DataFrame) -> DataFrame:
    """Lines with, for those that aren't mere syllables, their number among these (`lex`), the keys beside them, and the length of all before them."""
    p = positioned(lines).withColumn("vocal", is_vocal("text"))
    order = Window.partitionBy("task", "source").orderBy("line")
    kept = p.where("NOT vocal").withColumn("lex", (F.row_number().over(order) - 1).cast("long"))
    kept = kept.withColumn("before", F.lag("key").over(order)).withColumn("after", F.lead("key").over(order)).withColumn("after_ms", F.lead("at_ms").over(order))
    kept = kept.withColumn("upto", F.coalesce(F.sum(F.length("key")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return p.join(folds.by_merge(kept.select("task", "line", "lex", "before", "after", "after_ms", "upto")), ["task", "line"], "left")


def anchored(cues: DataFrame, lex: DataFrame, decisions: DataFrame) -> DataFrame:
    """Safe identities of one line, the best for each line: (task, source, cue, line, lex, upto, start_ms, at_ms)."""
    safe = decisions.where((F.col("n_lines") == 1) & (F.col("action") != "review") & F.col("reason").isin(*SAFE) & (F.col("score") >= 0.72))
    best = Window.partitionBy("task", "line").orderBy(F.desc("score"), "cue")
    safe = safe.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("task", "cue", "line")
    return safe.join(folds.by_merge(cues.select("task", "cue", "start_ms")), ["task", "cue"]).join(folds.by_merge(lex.select("task", "line", "source", "at_ms", "lex", "upto")), ["task", "line"])


def models(anchors: DataFrame, lines: DataFrame, priors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((task, source, MODEL) of every source, its inliers where it is ready). A source's anchors are one group."""
    sources = lines.select("task", "source").distinct()
    prior = priors.where(F.col("rate").between(0.5, 2.0)).select("task", "source", F.col("rate").alias("prior"))
    rows = sources.join(folds.by_merge(prior), ["task", "source"], "left").join(folds.by_merge(anchors), ["task", "source"], "left").select("task", "source", "prior", "cue", "line", "lex", "start_ms", "at_ms")

    def run(cue: list, line: list, lex: list, start_ms: list, at_ms: list, prior: list) -> list[tuple]:
        own = (cue, line, lex, start_ms, at_ms) if cue[0] is not None else ([],) * 5  # no anchor
        return [fitted(*own, prior[0])]

    told = folds.by_sorted(rows, ["task", "source"], ["cue"], ["cue", "line", "lex", "start_ms", "at_ms", "prior"], run, MODEL)
    ready = told.where("status = 'ready'").select("task", "source", "rate", "offset")
    near = anchors.join(folds.by_merge(ready), ["task", "source"]).where(F.abs(F.col("at_ms") - (F.col("offset") + F.col("rate") * F.col("start_ms"))) <= 750)
    return told, near.drop("rate", "offset")


def stream(cues: list[dict], lines: list[dict], source: int, right_start: int, right_mix: int) -> list[tuple[str, int, int]] | None:
    """(text, first line, lines) of each cue of a region when the characters of all its lines are dealt to its cues, where that is beyond doubt."""
    if not lines or any(LATIN.search(x["text"]) for x in lines) or any(c["action"] == "review" and vocal(c["text"]) for c in cues):
        return None
    mapped = [bool(c["n_lines"]) for c in cues]
    if any(m and (c["n_known"] != c["n_lines"] or c["sources"] != [source]) for m, c in zip(mapped, cues, strict=True)):
        return None
    now = [c["decided"] if c["action"] != "review" and c["decided"] else c["text"] for c in cues]
    whole, size = "".join(x["key"] for x in lines), sum(len(key(x)) for x in now)
    if not whole or not size or min(size, len(whole)) / max(size, len(whole)) < LEAST_RATIO:
        return None
    early = lines[0]["mix_ms"] - cues[0]["start_ms"]
    if abs(right_mix - right_start) > 750 or not -1600 <= early <= 900 or lines[-1]["mix_ms"] > cues[-1]["end_ms"] + 1200 or lines[-1]["mix_ms"] >= right_start:
        return None
    parts, doubt = shared_out(now, content("".join(x["text"] for x in lines)))
    if doubt:
        return None
    texts = [rendered(a, b) for a, b in zip(now, parts, strict=True)]
    keys = [key(t) for t in texts]
    if not all(keys) or any(k != key(p) for k, p in zip(keys, parts, strict=True)) or "".join(keys) != whole:
        return None
    ends = np.cumsum([len(x["key"]) for x in lines])
    out, at = [], 0
    for c, m, t, k, old in zip(cues, mapped, texts, keys, now, strict=True):
        first, last = int(np.searchsorted(ends, at, "right")), int(np.searchsorted(ends, at + len(k), "left"))
        low, high = lines[first]["line"], lines[last]["line"] + 1
        at += len(k)
        if c["action"] != "review":
            if key(old) != k:
                return None
        else:
            like = tx.pair(c["key"], k)
            if len(c["key"]) <= 2 and like < LEAST_SHORT:
                return None
            if not m and (len(c["key"]) < 4 or len(k) < 4 or like < LEAST_UNMAPPED):
                return None
            if m and not c["line"] <= low <= high <= c["line"] + c["n_lines"]:
                return None
            # A single line that its neighbours seem to share may only be confirmed.
            if c["n_lines"] == 1 and c["guarded"] and k != key(old):
                return None
        out.append((t, low, high - low))
    return out


def tempo_recovered(cues: DataFrame, lines: DataFrame, decisions: DataFrame, priors: DataFrame) -> DataFrame:
    """Decisions after recovery at known rates: reviews that claim one line and are there in time, then regions between inliers as streams."""
    lex, order, kinds = lexical(lines), by_task(), dict(cues.dtypes)
    told, inliers = models(anchored(cues, lex, decisions), lines, priors)
    ready = written(told.where("status = 'ready'").drop("status"), "models")
    d = decisions if "text" in decisions.columns else decisions.withColumn("text", F.lit(None).cast("string"))
    s = cues.join(folds.by_merge(d.withColumnRenamed("text", "decided")), ["task", "cue"], "left")
    s = s.withColumn("cue_before", F.lag("key").over(order)).withColumn("cue_after", F.lead("key").over(order))
    # What a cue claims: how many lines of which sources there are.
    claims = s.where("n_lines > 0").select("task", "cue", F.explode(F.sequence(F.col("line"), F.col("line") + F.col("n_lines") - 1)).alias("line"))
    claims = claims.join(folds.by_merge(lines.select("task", "line", "source")), ["task", "line"]).groupBy("task", "cue").agg(F.count("*").cast("int").alias("n_known"), F.sort_array(F.collect_set("source")).alias("sources"))
    s = s.join(folds.by_merge(claims), ["task", "cue"], "left")
    reach = [F.when(F.col("n_lines") > 0, F.struct("line", (F.col("line") + F.col("n_lines")).alias("until"))).alias("claim")]
    s = s.withColumn("claim", *reach)
    s = s.withColumn("claim_before", F.lag("claim").over(order)).withColumn("claim_after", F.lead("claim").over(order))
    one = lex.select("task", F.col("line").alias("_line"), "source", "at_ms", "lex", "vocal", "before", "after", "after_ms", F.col("text").alias("line_text"), F.col("key").alias("line_key"))
    s = s.withColumn("_line", F.when((F.col("action") == "review") & (F.col("n_lines") == 1), F.col("line"))).join(folds.by_merge(one), ["task", "_line"], "left")
    s = s.withColumn("_c", F.when(F.col("line_key").isNotNull(), compared("text", "key", F.coalesce("line_text", F.lit("")), F.coalesce("line_key", F.lit("")), "cue_before", "cue_after", "before", "after")))
    # A claim of a line that isn't there guards its cue.
    s = s.withColumn("guarded", F.coalesce("_c.guarded", F.lit(True)))

    m = s.where("line_key IS NOT NULL AND NOT vocal").join(folds.by_merge(ready), ["task", "source"])
    m = m.where(F.abs(F.col("start_ms") - mix_ms("at_ms")) <= F.when(F.col("score") < 0.20, 220).otherwise(450))
    holds = lambda c: F.coalesce((F.col(f"{c}.line") <= F.col("line")) & (F.col("line") < F.col(f"{c}.until")), F.lit(False))
    left, right = (F.col("first_cue") < F.col("cue")) & (F.col("first_line") < F.col("line")), (F.col("last_cue") > F.col("cue")) & (F.col("last_line") > F.col("line"))
    leading = (F.col("cue") < F.col("first_cue")) & (F.col("first_cue") - F.col("cue") <= 2) & (F.col("first_pos") - F.col("lex")).between(1, 2)
    inside = F.coalesce(mix_ms("after_ms") < F.col("end_ms") - 300, F.lit(False))
    sure = ~is_vocal("text") & ~holds("claim_before") & ~holds("claim_after") & ~F.col("guarded") & ~inside & right & (left | F.coalesce(leading, F.lit(False)))
    m = m.where(F.col("_c.trims") | sure)
    same = F.when(F.col("key") == F.col("line_key"), "unchanged").otherwise("replace")
    single = m.select("task", "cue", same.alias("action"), F.when(F.col("_c.trims"), TRIMMED).otherwise(MAPPED).alias("reason"), F.least("score", F.lit(0.90)).alias("score"), "line", "n_lines", F.col("line_text").alias("text"))
    first = written(untouched(d, single), "decisions")

    # Regions between neighbouring inliers of a source that are lexical lines, by running length no longer than what their cues can hold.
    pair = Window.partitionBy("task", "source").orderBy("cue")
    right_side = F.struct("cue", "lex", "upto", "start_ms", "at_ms")
    r = inliers.withColumn("next", F.lead(right_side).over(pair)).where(f"lex IS NOT NULL AND next.lex > lex + 1 AND next.cue - cue - 1 BETWEEN 1 AND {MOST_CUES}")
    r = r.join(folds.by_merge(lex.select("task", "line", F.length("key").alias("own"))), ["task", "line"]).withColumn("size", F.col("next.upto") - F.col("upto") - F.col("own"))
    r = r.select("task", "source", F.col("cue").alias("left_cue"), "lex", "next", "size", F.explode(F.sequence(F.col("cue") + 1, F.col("next.cue") - 1)).alias("cue"))
    state = s.drop("action", "reason", "score", "line", "n_lines", "decided").join(folds.by_merge(first.withColumnRenamed("text", "decided")), ["task", "cue"], "left")
    cols = [*CUE, "decided", "n_known", "sources", "guarded"]
    r = r.join(folds.by_merge(state.select("task", *cols)), ["task", "cue"]).groupBy("task", "source", "left_cue", "lex", "next", "size").agg(structs(cols, "cue", "cues"))
    working = F.aggregate("cues", F.lit(0), lambda a, c: a + F.length(F.when(F.coalesce(c.action != "review", F.lit(False)) & (F.length(c.decided) > 0), c.decided).otherwise(c.text)))
    r = r.where(F.forall("cues", lambda c: c.action.isNotNull()) & F.exists("cues", lambda c: c.action == "review") & (F.col("size") * LEAST_RATIO <= working))
    kept = lex.where("lex IS NOT NULL").drop("pos").withColumnRenamed("lex", "pos")
    r = gap_lines(r, kept, F.col("lex") + 1, F.col("next.lex") - 1, ["task", "source", "left_cue"]).join(folds.by_merge(ready.select("task", "source", "rate", "offset")), ["task", "source"])
    r = r.withColumn("gap", F.transform("gap", lambda x: F.struct(x["line"], x["key"], x["text"], mix_ms(x["at_ms"]).alias("mix_ms")))).withColumn("right_mix", mix_ms(F.col("next.at_ms")))

    def run(row: dict) -> list[tuple]:
        got = stream(row["cues"], row["gap"] or [], row["source"], row["next"]["start_ms"], row["right_mix"])
        return [
            (row["task"], c["cue"], "unchanged" if c["key"] == key(t) else "replace", STREAM, min(c["score"], 0.89), line, n, t)
            for c, (t, line, n) in zip(row["cues"], got or [], strict=False)
            if c["action"] == "review"
        ]

    return untouched(first, each_row(r, run, f"task {kinds['task']}, cue {kinds['cue']}, {FOUND}"))
