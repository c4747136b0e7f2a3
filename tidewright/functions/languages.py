"""Words, credits and syllables by language; languages' other names and thresholds."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from tidewright.functions.text import fold, sliced

#: Score for automatic use, score for review, and least coverage of each language; other names of languages.
THRESHOLDS = {
    "en": (0.88, 0.64, 0.68), "zh": (0.90, 0.66, 0.72), "yue": (0.92, 0.70, 0.74), "ko": (0.86, 0.60, 0.64),
    "ja": (0.92, 0.68, 0.74), "mixed": (0.94, 0.72, 0.78), "auto": (0.95, 0.74, 0.80), "generic": (0.95, 0.74, 0.80),
}
NAMES = {"cn": "zh", "cmn": "zh", "cantonese": "yue", "cant": "yue", "jp": "ja", "kr": "ko", "multi": "mixed", "unknown": "generic", "und": "generic"}
#: Heads of credit lines, and labels of who sings.
CREDIT_WORDS = "作词 作曲 编曲 词 曲 制作人 人声采样 版权 发行 混音 母带 企划 出品人 监制 和声编写 和声 录音师 录音棚 音频编辑 统筹 宣传发行 出品方 出品 吉他 贝斯 鼓 配唱制作人 制作助理 录音 合唱录音棚 OP SP 商务合作".split()
CREDIT = r"(?i)^(?:\[?by\s*[:：]|(?:" + "|".join(CREDIT_WORDS) + r"|Atmos\s*混音|[曲词]\s*OP)\s*[:：])"
PARTS = "(?:Rap|说唱|主唱|和声|合唱|独白)"
ROLE = (
    rf"(?i)^(?:合|齐唱|主唱|男|女|男声|女声|独白|和声|说唱|Rap|Chorus|(?:[A-Za-z0-9][A-Za-z0-9 ._&+/\-（）()\x{{3400}}-\x{{9fff}}]{{0,60}}"
    rf"|[\x{{3400}}-\x{{9fff}}A-Za-z0-9._+\-]{{1,20}}(?:[/、&+][\x{{3400}}-\x{{9fff}}A-Za-z0-9._+\-]{{1,20}})+)(?:\s*[（(]{PARTS}[）)])?|[\x{{3400}}-\x{{9fff}}]{{1,20}}\s*[（(]{PARTS}[）)])\s*[:：]$"
)
#: Words that are sung without meaning.
SOUNDS = frozenset("na nana nanana oh ooh yeah uh uhhuh hey ba baba dum dumdum whipwhiplash".split())


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_metadata(text: Column) -> Column:
    """Credits, and labels of who sings."""
    return clean(text).rlike(CREDIT) | clean(text).rlike(ROLE)


def title_like(start_ms: Column, text: Column) -> Column:
    """The row "artist - title" that many files begin with."""
    return (start_ms <= 1000) & clean(text).contains(" - ")


def sounds(text: str) -> bool:
    """Nothing, or only words without meaning."""
    key = lambda t: "".join(c for c in fold(t) if c.isalnum())
    words = [key(w) for w in re.findall(r"[\w']+", text)]
    return not key(text) or key(text) in SOUNDS or (bool(words) and all(w in SOUNDS or w in ("da", "huh") for w in words))


@F.pandas_udf(BooleanType())
def is_sounds(text: pd.Series) -> pd.Series:
    return text.map(sounds, na_action="ignore")


def units(language: str, text: str) -> list[str]:
    """The units in which a language's texts are cut: English words, Chinese and Japanese characters, Korean words and others, or runs of one script."""
    t = re.sub(r"\s+", " ", fold(text).replace("’", "'").replace("‘", "'")).strip()
    if language in ("zh", "yue", "ja"):
        return [c for c in t if c.isalnum()]
    return re.findall({"en": r"[a-z0-9]+(?:'[a-z0-9]+)?", "ko": "[가-힣]+|[a-z0-9]+"}.get(language, "[가-힣]+|[一-鿿ぁ-ゖァ-ヺ]+|[a-z0-9]+"), t)


@F.arrow_udf(ArrayType(StringType()))
def language_units(language: pa.Array, text: pa.Array) -> pa.Array:
    return sliced(units, pa.list_(pa.field("element", pa.string())), language.fill_null(""), text)


def with_profile(df: DataFrame, language: str) -> DataFrame:
    """`df` with the code of its language and what holds for it (auto_score, review_score, least_coverage); null where the language isn't known."""
    spark = df.sparkSession
    names = NAMES | {k: k for k in THRESHOLDS}
    table = spark.createDataFrame([(n, k, *THRESHOLDS[k]) for n, k in names.items()], "_name string, code string, auto_score double, review_score double, least_coverage double")
    return df.withColumn("_name", F.lower(F.trim(language))).join(F.broadcast(table), "_name", "left").drop("_name")
