"""Gates on hand-made rows, and what they refuse."""

import pytest

from tidewright.operators import gates


def test_publish_issues(spark):
    rows = [("private/a.txt", "x"), ("PRIVATE/b", None), ("privately/c", "see /HOME/me"), ("d.Srt", None), ("src/private/e.py", "ghp_" + "a" * 19), ("f", "ghp_" + "a" * 20), ("g", "-----BEGIN PRIVATE KEY-----"), ("private", "c:\\users\\x"), ("h.mp3/i", "")]
    got = {tuple(r) for r in gates.publish_issues(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {("private/a.txt", "local_data_path"), ("PRIVATE/b", "local_data_path"), ("privately/c", "sensitive_content"), ("d.Srt", "media_or_subtitle_file"), ("f", "sensitive_content"), ("g", "sensitive_content"), ("private", "sensitive_content")}


def test_tempo_changes(spark):
    lines = ["Artist - Title103-130 - x.wav", "  A 2 90.5-100  - y", "no tempo - x", "B0-100 - z", "C100-0 - z", "D100-120- z"]
    got = gates.tempo_changes(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(r.label, r.source_bpm, r.mix_bpm) for r in got] == [("Artist - Title", 103.0, 130.0), ("A 2", 90.5, 100.0)] and abs(got[0].ratio - 130 / 103) < 1e-12


def test_selection_refuses(spark):
    cases = spark.createDataFrame([(1, "blind_test "), (2, None), (3, "development")], "i int, split string")
    assert [r.i for r in gates.selected(cases, "blind_test").collect()] == [1]
    for split in ("calibration", "other"):
        with pytest.raises(ValueError):
            gates.selected(cases, split)
    jobs = spark.createDataFrame([(1, ["mix_asr"]), (2, []), (3, None)], "i int, requested array<string>")
    assert [r.i for r in gates.requesting(jobs, "mix_asr").collect()] == [1]


def test_votes_need_every_grant(spark):
    import itertools

    from pyspark.sql import functions as F

    rows = list(itertools.product([True, False, None], repeat=5))
    df = spark.createDataFrame(rows, "a boolean, b boolean, c boolean, d boolean, e boolean")
    for r in df.select("*", gates.may_vote(*map(F.col, "abcde")).alias("v")).collect():
        local = r.a if r.a is not None else r.b
        assert r.v == (local is True and r.c is True and r.d is False and r.e is False)
