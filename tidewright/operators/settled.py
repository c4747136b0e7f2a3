"""Last recoveries of reviews: whole regions whose claims fill the gap between resolved neighbours, and single lines that can't move text between cues.

Tables as in `recovery`. A run of reviews is one row in Python; its neighbours, claims and anchors are found by windows and joins.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidewright.functions import text as tx
from tidewright.operators import folds
from tidewright.operators.recovery import CUE, FOUND, by_task, each_row, structs, untouched
from tidewright.operators.repair import content, key, rendered, shared_out
from tidewright.operators.tempo import LATIN, vocal

REGION = "a_bounded_region_confirms_canonical_stream"
CROSS, ONE_CHARACTER, SUFFIX = "preceding_canonical_anchor_confirms_cross_script_vocalization", "isomorphic_single_cue_canonical_correction", "editor_suffix_proves_canonical_prefix_ownership"
#: The scores that these give at least.
SCORES = {CROSS: 0.88, ONE_CHARACTER: 0.92, SUFFIX: 0.90}
#: Characters of syllables without meaning.
HAN_SOUNDS, LATIN_SOUNDS = frozenset("哈嘿嗨咿咦呀啊喔哦噢吼唷呵哎唉诶欸呦哟"), frozenset("aehiouly")


def region(cues: list[dict], gap: list[dict]) -> list[tuple[str, int, int]] | None:
    """(text, first line, lines) of each cue when the characters of a whole gap are dealt to a run of cues beyond doubt.

    cues: text, key; gap: line, key, text. Of several cues only text without Latin words is dealt.
    """
    if not gap or any(vocal(x["text"]) for x in [*cues, *gap]) or (len(cues) > 1 and any(LATIN.search(x["text"]) for x in [*cues, *gap])):
        return None
    source, target = "".join(key(c["text"]) for c in cues), "".join(x["key"] for x in gap)
    short, long = sorted((len(source), len(target)))
    if short < 12 or short / long < 0.85 or tx.pair(source, target) < 0.80 or any(not x["key"] for x in gap):
        return None
    parts, doubt = shared_out([c["text"] for c in cues], content("".join(x["text"] for x in gap)))
    if doubt or not all(key(p) for p in parts):
        return None
    texts = [rendered(c["text"], p) for c, p in zip(cues, parts, strict=True)]
    if any(key(t) != key(p) for t, p in zip(texts, parts, strict=True)) or "".join(map(key, texts)) != target:
        return None
    ends, out, at = np.cumsum([len(x["key"]) for x in gap]), [], 0
    for t in texts:
        first, last = int(np.searchsorted(ends, at, "right")), int(np.searchsorted(ends, at + len(key(t)), "left"))
        out.append((t, gap[first]["line"], gap[last]["line"] + 1 - gap[first]["line"]))
        at += len(key(t))
    return out


def bounded_recovered(cues: DataFrame, lines: DataFrame, decisions: DataFrame, timing: DataFrame) -> DataFrame:
    """Decisions after whole runs of reviews, all with claims that rise within the gap between their resolved neighbours, took the gap's text.

    timing: task, cue, source, line, grade, model_status, residual_ms. An A anchor of a ready model on either side, of the gap's source, must
    bracket the run in cues and in lines.
    """
    order, kinds = by_task(), dict(cues.dtypes)
    s = cues.join(folds.by_merge(decisions.select("task", "cue", "action", "reason", "score", "line", "n_lines")), ["task", "cue"], "left")
    # What each cue claims: whether all its lines are there, and of which source they are if of one.
    claims = s.where("n_lines > 0").select("task", "cue", "n_lines", F.explode(F.sequence(F.col("line"), F.col("line") + F.col("n_lines") - 1)).alias("line"))
    claims = claims.join(folds.by_merge(lines.select("task", "line", "source")), ["task", "line"]).groupBy("task", "cue", "n_lines").agg(F.count("*").alias("n"), F.min("source").alias("one"), F.max("source").alias("other"))
    claims = claims.where("n = n_lines AND one = other").select("task", "cue", F.col("one").alias("claimed"))
    s = s.join(folds.by_merge(claims), ["task", "cue"], "left")
    under = F.coalesce(F.col("action") == "review", F.lit(False))
    side = F.when(~under & F.col("claimed").isNotNull(), F.struct("line", (F.col("line") + F.col("n_lines")).alias("until"), F.col("claimed").alias("source")))
    s = s.withColumn("_side", side).withColumn("_run", F.count_if(~under).over(order))
    s = s.withColumn("left", F.lag("_side").over(order)).withColumn("right", F.lead("_side").over(order)).where(under)
    s = s.withColumn("until", F.col("line") + F.col("n_lines"))
    within = Window.partitionBy("task", "_run").orderBy("cue")
    rising = F.coalesce((F.col("line") >= F.lag("line").over(within)) & (F.col("until") >= F.lag("until").over(within)), F.lit(True))
    s = s.withColumn("_rising", rising & F.col("claimed").isNotNull())
    cols = [*CUE, "until", "claimed", "_rising"]
    r = s.groupBy("task", "_run").agg(structs(cols, "cue", "cues"), F.min_by("left", "cue").alias("left"), F.max_by("right", "cue").alias("right"), F.min("cue").alias("first_cue"), F.max("cue").alias("last_cue"))
    r = r.withColumn("source", F.col("left.source")).withColumn("low", F.col("left.until")).withColumn("high", F.col("right.line"))
    r = r.where("left IS NOT NULL AND right IS NOT NULL AND left.source = right.source AND high > low")
    r = r.where(F.forall("cues", lambda c: c["_rising"] & (c["claimed"] == F.col("source")) & (c["line"] >= F.col("low")) & (c["until"] <= F.col("high"))))
    sure = timing.where("grade = 'A' AND model_status = 'ready' AND abs(residual_ms) <= 750").join(folds.by_merge(lines.select("task", "line", "source")), ["task", "line", "source"])
    a = sure.select(F.col("task").alias("_t"), F.col("source").alias("_s"), F.col("cue").alias("_c"), F.col("line").alias("_l"))
    same = (F.col("task") == F.col("_t")) & (F.col("source") == F.col("_s"))
    r = r.join(folds.by_merge(a), same & (F.col("_c") < F.col("first_cue")) & (F.col("_l") < F.col("low")), "left_semi").join(folds.by_merge(a), same & (F.col("_c") > F.col("last_cue")) & (F.col("_l") >= F.col("high")), "left_semi")
    wanted = r.select("task", "_run", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("line"))
    gap = wanted.join(folds.by_merge(lines.select("task", "line", "source", "key", "text")), ["task", "line"]).groupBy("task", "_run").agg(structs(["line", "source", "key", "text"], "line", "gap"))
    r = r.join(folds.by_merge(gap), ["task", "_run"])

    def run(row: dict) -> list[tuple]:
        gap = row["gap"]
        if len(gap) != row["high"] - row["low"] or any(x["source"] != row["source"] for x in gap):
            return []
        got = region(row["cues"], gap) or []
        return [(row["task"], c["cue"], "unchanged" if c["key"] == key(t) else "replace", REGION, min(c["score"], 0.89), line, n, t) for c, (t, line, n) in zip(row["cues"], got, strict=False)]

    return untouched(decisions, each_row(r.select("task", "cues", "gap", "low", "high", "source"), run, f"task {kinds['task']}, cue {kinds['cue']}, {FOUND}"))


def one_off(a: str, b: str) -> bool:
    """Whether an insertion, a deletion or a replacement of at most one character makes a text the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k:] == b[k + 1 :] or a[k + 1 :] == b[k + 1 :]


def sounds(text: str) -> str | None:
    """The script of a text that is mere syllables."""
    k = key(text)
    if len(k) < 4:
        return None
    if HAN_SOUNDS.issuperset(k):
        return "han"
    return "latin" if LATIN_SOUNDS.issuperset(k) and ("-" in text or len(text.split()) >= 2) else None


def owned_suffix(cue: str, line: str, text: str, before: str) -> str | None:
    """What is left of a line's text when the cue before ends with its beginning, and this cue is the rest but for a character."""
    n = max((k for k in range(4, max(4, len(line) - 3) + 1) if before.endswith(line[:k])), default=0)
    rest = line[n:]
    if n < 4 or n >= len(line) - 2 or len(rest) < 4 or cue == rest or not one_off(cue, rest) or SequenceMatcher(None, cue, rest).ratio() < 0.84:
        return None
    at = 0
    for i, c in enumerate(text):
        at += len(key(c))
        if at >= n:
            shown = text[i + 1 :].lstrip()
            return shown if shown and key(shown) == rest else None
    return None


@F.pandas_udf(StructType([StructField("reason", StringType()), StructField("text", StringType())]))
def settled(cue: pd.Series, cue_text: pd.Series, line: pd.Series, line_text: pd.Series, follows: pd.Series, before: pd.Series) -> pd.DataFrame:
    def one(c: str, ct: str, x: str, xt: str, after: bool, b: str | None) -> tuple[str | None, str | None]:
        if not c or not x:
            return None, None
        if after and {sounds(ct), sounds(xt)} == {"han", "latin"}:
            return CROSS, xt
        if len(c) == len(x) >= 6 and one_off(c, x):
            return ONE_CHARACTER, xt
        rest = owned_suffix(c, x, xt, b) if b is not None else None
        return (SUFFIX, rest) if rest else (None, None)

    return pd.DataFrame([one(*r) for r in zip(cue, cue_text, line, line_text, follows, before, strict=True)], columns=["reason", "text"])


def final_recovered(cues: DataFrame, lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions after reviews of one line that is the cue but for one character, whose beginning the cue before has, or that sounds it in another script."""
    order = by_task()
    s = cues.join(folds.by_merge(decisions.select("task", "cue", "action", "reason", "score", "line", "n_lines")), ["task", "cue"], "left")
    s = s.withColumn("_last", F.when(F.col("n_lines") > 0, F.col("line") + F.col("n_lines") - 1)).join(folds.by_merge(lines.select("task", F.col("line").alias("_last"), F.col("source").alias("last_source"))), ["task", "_last"], "left")
    done = F.when((F.col("action") != "review") & F.col("last_source").isNotNull(), F.struct("_last", "last_source"))
    s = s.withColumn("_done", F.lag(done).over(order)).withColumn("before", F.lag("key").over(order))
    one = lines.select("task", "line", "source", F.col("key").alias("line_key"), F.col("text").alias("line_text"))
    s = s.where("action = 'review' AND n_lines = 1").join(folds.by_merge(one), ["task", "line"])
    follows = F.coalesce((F.col("_done._last") + 1 == F.col("line")) & (F.col("_done.last_source") == F.col("source")), F.lit(False))
    s = s.withColumn("_s", settled("key", "text", "line_key", "line_text", follows, "before")).where("_s.reason IS NOT NULL")
    least = F.element_at(F.create_map(*[F.lit(x) for kv in SCORES.items() for x in kv]), F.col("_s.reason"))
    found = s.select("task", "cue", F.lit("replace").alias("action"), F.col("_s.reason").alias("reason"), F.greatest("score", least).alias("score"), "line", "n_lines", F.col("_s.text").alias("text"))
    return untouched(decisions, found)
