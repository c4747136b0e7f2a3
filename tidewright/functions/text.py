"""Text functions that Spark has no expression for, as vectorised UDFs."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType, IntegerType


#: Rows that are Python objects at a time, whatever the size of an Arrow batch.
ROWS = 64


def sliced(one, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """What `one` makes of each row, as Arrow: only a slice of the rows and of the results are Python objects at a time. Rows with a null give null."""
    made = []
    for at in range(0, len(columns[0]), ROWS):
        rows = zip(*(c.slice(at, ROWS).to_pylist() for c in columns), strict=True)
        made.append(pa.array([None if None in r else one(*r) for r in rows], kind))
    return pa.concat_arrays(made) if made else pa.array([], kind)


def fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


@F.pandas_udf(StringType())
def match_key(s: pd.Series) -> pd.Series:
    """NFKC and case folded, without punctuation, separators and controls."""
    keep = lambda t: "".join(c for c in fold(t) if unicodedata.category(c)[0] not in "PZC")
    return s.map(keep, na_action="ignore")


@F.arrow_udf(StringType())
def alnum_key(s: pa.Array) -> pa.Array:
    """NFKC and case folded letters and digits."""
    return sliced(lambda t: "".join(c for c in fold(t) if c.isalnum()), pa.string(), s)


def matched(a: str, b: str) -> int:
    """How many characters lie in the matching blocks of both texts: the longest common run (the first in a, then in b), and so on left and right of it.

    A longest run is found by lengthening: at each place of a it is only asked whether b holds a run one longer than the best so far.
    """
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        most, first, at = 0, a0, b0
        i = a0
        while i + most < a1 and most < b1 - b0:
            j = b.find(a[i : i + most + 1], b0, b1)
            if j < 0:
                i += 1
                continue
            most, first, at = most + 1, i, j
        if most:
            total += most
            if a0 < first and b0 < at:
                todo.append((a0, first, b0, at))
            if first + most < a1 and at + most < b1:
                todo.append((first + most, a1, at + most, b1))
    return total


def ratio(a: str, b: str) -> float:
    """The ratio of difflib's SequenceMatcher without its rule for frequent characters."""
    if a == b:
        return 1.0
    return 2.0 * matched(a, b) / (len(a) + len(b))


#: Fixed value: characters of two texts up to which their score is kept for the next time.
KEPT = 160


@lru_cache(1 << 16)
def kept_ratio(a: str, b: str) -> float:
    return ratio(a, b)


def often(a: str, b: str) -> float:
    """The ratio of texts that come again: those of short ones are kept, a bounded number of them."""
    return kept_ratio(a, b) if len(a) + len(b) <= KEPT else ratio(a, b)


def pair(a: str | None, b: str | None) -> float | None:
    """Matching-blocks ratio, damped by the ratio of lengths; equal texts 1, an empty one 0."""
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return often(a, b) * (0.85 + 0.15 * min(len(a), len(b)) / max(len(a), len(b)))


def pair_bound(n: int, m: int) -> float:
    """No pair of texts of these lengths scores higher."""
    short, long = (n, m) if n < m else (m, n)
    return 2.0 * short / (n + m) * (0.85 + 0.15 * short / long) if long else 1.0


@F.pandas_udf(DoubleType())
def pair_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([pair(x, y) for x, y in zip(a, b, strict=True)])


def common_subsequence(a: str, b: str) -> int:
    """Length of a longest common subsequence; a bit of `row` is 0 where the length rises along b."""
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


@F.pandas_udf(DoubleType())
def support_score(want: pd.Series, got: pd.Series) -> pd.Series:
    """How well `got` supports `want`: the ratio, or covered subsequence and its F1, whichever is more."""

    def one(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        if not a or not b:
            return 0.0
        n = common_subsequence(a, b)
        return max(often(a, b), 0.7 * n / len(a) + 0.3 * 2 * n / (len(a) + len(b)))

    return pd.Series([one(x, y) for x, y in zip(want, got, strict=True)])


@F.pandas_udf(DoubleType())
def contained_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity, raised where one text holds the other."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        if not x or not y:
            return 0.0
        short, long = sorted((x, y), key=len)
        return max(often(x, y), 0.4 + 0.55 * len(short) / len(long)) if short in long else often(x, y)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


KEEP, SWAP, ADD, DROP = range(4)
OPS = ("equal", "replace", "insert", "delete")


def ways(a: list[str], b: list[str]) -> tuple[int, list[bytearray]]:
    """The edit distance from a to b, and for each pair of prefixes the last step of a least edit.

    Of steps that cost the same the first of OPS is taken; equal items are always kept, which never costs more. Only one row of
    distances is held at a time; the steps take a byte each.
    """
    costs, steps = list(range(len(b) + 1)), []
    for x in a:
        corner, costs[0] = costs[0], costs[0] + 1
        row = bytearray(len(b))
        for j, y in enumerate(b, 1):
            above = costs[j]
            if x == y:
                costs[j] = corner
            else:
                least = min(corner, costs[j - 1], above)
                row[j - 1] = SWAP if corner == least else ADD if costs[j - 1] == least else DROP
                costs[j] = least + 1
            corner = above
        steps.append(row)
    return costs[-1], steps


def script_of_edits(a: list[str], b: list[str]) -> list[tuple[str, str | None, str | None]]:
    """(op, from, to) of a least edit from a to b; ties are broken from the end backwards, in the order of OPS."""
    _, steps = ways(a, b)
    out: list[tuple[str, str | None, str | None]] = []
    i, j = len(a), len(b)
    while i or j:
        step = DROP if not j else ADD if not i else steps[i - 1][j - 1]
        i, j = i - (step != ADD), j - (step != DROP)
        out.append((OPS[step], None if step == ADD else a[i], None if step == DROP else b[j]))
    out.reverse()
    return out


EDITS = ArrayType(StructType([StructField("op", StringType()), StructField("src", StringType()), StructField("dst", StringType())]))


EDIT = pa.list_(pa.field("element", pa.struct([(c, pa.string()) for c in ("op", "src", "dst")])))


@F.arrow_udf(EDITS)
def edit_script(a: pa.Array, b: pa.Array) -> pa.Array:
    """The edit script between two texts' words."""
    return sliced(lambda x, y: [dict(zip(("op", "src", "dst"), e, strict=True)) for e in script_of_edits(x.split(), y.split())], EDIT, a, b)


@F.pandas_udf(IntegerType())
def token_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance in words."""
    one = lambda x, y: None if x is None or y is None else ways(x.split(), y.split())[0]
    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="object")


#: The ranges of characters that tell a script, in Unicode, and other names of languages.
SCRIPTS = (("hangul", "가-힣ㄱ-ㅎㅏ-ㅣ"), ("kana", "ぁ-ゖァ-ヺー"), ("han", "一-鿿"), ("latin", "A-Za-zÀ-ÖØ-öø-ÿĀ-ž"))
ALIASES = {"kr": "ko", "jp": "ja", "cn": "zh", "cantonese": "yue", "zh-yue": "yue"}
RUNS = re.compile("|".join(f"(?P<{k}>[{v}]+)" for k, v in SCRIPTS))


def language_of(kind: str, track: str) -> str:
    """The language that a script tells within a track of this language. Letters of many languages are never renamed to one of them."""
    if kind == "hangul":
        return "ko"
    if kind == "kana":
        return "ja"
    if kind == "han":
        return track if track in ("ja", "yue", "zh") else "und-han"
    if track in ("ko", "ja", "zh", "yue", "mixed"):
        return "en"
    return "generic" if track in ("auto", "unknown", "") else track


def spans(text: str, track: str) -> list[tuple[int, int, str, str]]:
    """(start, end, language, script) of runs of one language; other characters go with what stands before them, at the start after.

    A run in more than one script is "mixed"; a text in none of the scripts is one run of an unknown language.
    """
    if not text:
        return []
    track = track.strip().casefold()
    track = ALIASES.get(track, track)
    out: list[tuple[int, int, str, str]] = []
    for m in RUNS.finditer(text):
        kind, language = m.lastgroup, language_of(m.lastgroup, track)
        if out and out[-1][2] == language:
            start, _, _, before = out.pop()
            kind = kind if before == kind else "mixed"
        elif out:
            start = m.start()
            out[-1] = (out[-1][0], start, *out[-1][2:])
        else:
            start = 0
        out.append((start, m.end(), language, kind))
    if not out:
        return [(0, len(text), "unknown", "other")]
    return [*out[:-1], (out[-1][0], len(text), *out[-1][2:])]


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("language", StringType()), StructField("script", StringType())]))


@F.pandas_udf(SPANS)
def language_spans(text: pd.Series, track: pd.Series) -> pd.Series:
    one = lambda t, k: None if t is None else [dict(zip(("start", "end", "language", "script"), s, strict=True)) for s in spans(t, k or "auto")]
    return pd.Series([one(t, k) for t, k in zip(text, track, strict=True)])


#: How the leads, vowels and tails of Hangul syllables, in the order of their code points, are spelt here.
LEADS = ("g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h")
VOWELS = ("a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i")
TAILS = ("", "k", "k", "ks", "n", "nj", "nh", "t", "l", "lk", "lm", "lb", "ls", "lt", "lp", "lh", "m", "p", "ps", "t", "t", "ng", "t", "t", "k", "t", "p", "h")
#: Rows of kana by consonant, over the vowels a i u e o, and those that are spelt otherwise.
KANA_ROWS = {"": "あいうえお", "k": "かきくけこ", "s": "さしすせそ", "t": "たちつてと", "n": "なにぬねの", "h": "はひふへほ", "m": "まみむめも", "r": "らりるれろ", "g": "がぎぐげご", "z": "ざじずぜぞ", "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ"}
KANA_ODD = {"し": "shi", "ち": "chi", "つ": "tsu", "ふ": "fu", "じ": "ji", "ぢ": "ji", "づ": "zu", "や": "ya", "ゆ": "yu", "よ": "yo", "わ": "wa", "を": "o", "ん": "n", "ゔ": "vu", "ぁ": "a", "ぃ": "i", "ぅ": "u", "ぇ": "e", "ぉ": "o", "ゃ": "ya", "ゅ": "yu", "ょ": "yo"}
KANA = {k: c + v for c, row in KANA_ROWS.items() for k, v in zip(row, "aiueo", strict=True)} | KANA_ODD


@lru_cache(1)
def kana_pairs() -> dict[str, str]:
    """A kana in i with a small ya, yu or yo: kya, but sha, cha, ja."""
    heads = {k: v[:-1] for k, v in KANA.items() if k in "きしちにひみりぎじびぴ"}
    return {k + s: h + KANA[s][h in ("sh", "ch", "j") :] for k, h in heads.items() for s in "ゃゅょ"}


def romanised(text: str) -> str:
    """Folded letters and digits, Hangul by arithmetic, kana by table; a small tsu doubles the consonant after it."""
    out: list[str] = []
    pairs = kana_pairs()
    plain = "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in fold(text))
    doubled, at = False, 0
    while at < len(plain):
        c = plain[at]
        two = plain[at : at + 2]
        at += 2 if two in pairs else 1
        n = ord(c) - 0xAC00
        if c == "っ":
            doubled = True
            continue
        if 0 <= n < 11172:
            said = LEADS[n // 588] + VOWELS[n % 588 // 28] + TAILS[n % 28]
        else:
            said = pairs.get(two) or KANA.get(c) or (c if c.isalnum() and c != "ー" else "")
        if said:
            out.append(said[0] + said if doubled and said[0] not in "aeioun" else said)
            doubled = False
    return "".join(out)


@F.arrow_udf(StringType())
def phonetic(s: pa.Array) -> pa.Array:
    return sliced(romanised, pa.string(), s)


WORDS = re.compile(r"\w+|\W+")


@F.pandas_udf(StringType())
def laid_out(template: pd.Series, text: pd.Series) -> pd.Series:
    """The words of `text` in the layout (punctuation, spaces, breaks) of `template`; surplus words follow the last."""

    def one(a: str | None, b: str | None) -> str | None:
        if a is None or b is None:
            return a
        words = iter(re.findall(r"\w+", b))
        parts = [next(words, "") if p[0].isalnum() or p[0] == "_" else p for p in WORDS.findall(a)]
        rest = list(words)
        if rest:
            at = max((i for i, p in enumerate(parts) if p and (p[0].isalnum() or p[0] == "_")), default=-1)
            parts.insert(at + 1, (" " if at >= 0 else "") + " ".join(rest))
        return "".join(parts)

    return pd.Series([one(x, y) for x, y in zip(template, text, strict=True)])
