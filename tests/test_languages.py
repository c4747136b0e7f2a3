"""Predicates and units on texts of all scripts; routing where SQL's tables don't reach."""

import re

from pyspark.sql import functions as F

from tidewright.functions import languages
from tidewright.operators import routing


def test_credits_and_labels(spark):
    yes = ["作词：某人", "by: x", "[by：x]", "Atmos 混音: y", "曲 OP：z", "op: z", "合：", "Rap:", "A & B：", "天地/日月：", "天地(Rap)：", "天地（和声） :"]
    no = ["作词某人", "词曲", "", "天地：", "a line of text", "he said: go on and on", "天地/日月", "standby: x y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(yes + no)], "i int, t string").withColumn("m", languages.is_metadata(F.col("t")))
    assert [r.m for r in df.orderBy("i").collect()] == [True] * len(yes) + [False] * len(no)
    rows = spark.createDataFrame([(0, "A - B"), (1000, " A  -  B "), (1001, "A - B"), (0, "A-B")], "ms int, t string")
    assert [r[0] for r in rows.select(languages.title_like(F.col("ms"), F.col("t"))).collect()] == [True, True, False, False]


def test_sounds(spark):
    yes, no = ["", "...", "NA NA NA OH", "dum-dum-da", "Whiplash".replace("W", "whipW"), "oh, yeah!"], ["oh my", "banana", "사랑", "la"]
    assert all(map(languages.sounds, yes)) and not any(map(languages.sounds, no))
    assert [r[0] for r in spark.createDataFrame([("oh",), (None,)], "t string").select(languages.is_sounds("t")).collect()] == [True, None]


def test_units(spark):
    t = "Don’t STOP it's 12½ 사랑 노래 日本のうた ａｂ naïve"
    folded = "don't stop it's 121⁄2 사랑 노래 日本のうた ab naïve"
    assert languages.units("en", t) == re.findall(r"[a-z0-9]+(?:'[a-z0-9]+)?", folded)
    assert languages.units("zh", t) == [c for c in folded if c.isalnum()] == languages.units("ja", t)
    assert languages.units("ko", t) == [w for w in re.findall("[가-힣]+|[a-z0-9]+", folded)]
    assert "日本のうた" in languages.units("auto", t) and "사랑" in languages.units("mixed", t)
    df = spark.createDataFrame([("en", None), ("en", "")], "k string, t string")
    assert [r[0] for r in df.select(languages.language_units("k", "t")).collect()] == [None, []]


def test_profiles_of_unknown_names(spark):
    df = spark.createDataFrame([("KR",), ("xx",), (None,)], "k string")
    got = {r.k: (r.code, r.auto_score) for r in languages.with_profile(df, "k").collect()}
    assert got == {"KR": ("ko", 0.86), "xx": (None, None), None: (None, None)}


def test_windows_never_shrink_or_start_before_zero(spark):
    df = spark.createDataFrame([(a, a + n) for a in (0, 10, 400, 5000) for n in (0, 7, 3999, 9000)], "a long, b long")
    for r in df.select("a", "b", routing.window(F.col("a"), F.col("b"), 500, 4001).alias("w")).collect():
        left, right = max(0, r.a - 500), r.b + 500
        if right - left < 4001:
            d = 4001 - (right - left)
            left, right = max(0, left - d // 2), right + d - d // 2
            if left == 0 and right < 4001:
                right = 4001
        assert (r.w.left, r.w.right) == (left, right) and right - left >= 4001


def test_rows_are_objects_a_slice_at_a_time(spark, monkeypatch):
    """A whole batch of texts as lists of words took an executor's memory."""
    import pyarrow as pa

    from tidewright.functions import text as tx

    sizes, real = [], pa.array
    monkeypatch.setattr(tx, "pa", type("Pa", (), {"array": staticmethod(lambda x, kind: sizes.append(len(x)) or real(x, kind)), "concat_arrays": staticmethod(pa.concat_arrays)}))
    got = tx.sliced(lambda t: t.split(), pa.list_(pa.string()), real([None, "a b"] * 500))
    assert got.to_pylist() == [None, ["a", "b"]] * 500 and max(sizes) == tx.ROWS
