"""The pipeline's stages, one after the other, on a small table."""

import random

import corpus_pipeline
from tidewright.llm import registry


def test_stages(spark, tmp_path):
    g = random.Random(11)
    words = ["".join(g.choice("abcdefghij") for _ in range(g.randint(2, 7))) for _ in range(2000)]
    good = [" ".join(g.choice(words) for _ in range(120)) for _ in range(60)]
    texts = [*good, good[0], good[1] + " tail", "too short", "### $$$ *** %%% " * 50, None, good[2] + " mail me@x.example.com"]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert now.columns == docs.columns, name
        seen.append([r.doc_id for r in now.select("doc_id").collect()])
    assert set(seen[0]) == set(range(62)) | {65}
    assert sorted(seen[1]) == list(range(60))  # the copies go, the least ids stay
    assert sorted(seen[2]) == sorted(seen[1]) and set(seen[3]) <= set(seen[2]) and len(seen[4]) == len(seen[3])
    assert "pipeline" in registry.queries() and len(registry.queries()) == 14


CLASHES = ("th", "id", "row", "row_id", "i", "t", "v", "s", "kept", "slot", "label", "band", "key", "block", "copies", "doc", "every", "safe", "attempts", "size", "turn", "_s", "source_size")


def test_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, columns named as operators name theirs; then no rows at all."""
    g = random.Random(12)
    words = ["".join(g.choice("abcdefghij") for _ in range(g.randint(2, 7))) for _ in range(900)]
    good = [" ".join(g.choice(words) for _ in range(90)) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good)]
    rows += [rows[3], rows[3], (None, good[4] + " and more words here", None, None, None), (50, None, None, None, None), (51, "", "en", "s0", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"'clash' AS `{c}`" for c in CLASHES])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, None, None), (5, None, 1)], "doc_id long, quality int, toxic int")
    for name, some, marks in (("full", docs, labels), ("empty", docs.limit(0), labels.limit(0))):
        d = f"{tmp_path}/{name}"
        some.write.parquet(f"{d}/documents.parquet")
        marks.write.parquet(f"{d}/labels.parquet")
        now = spark.read.parquet(f"{d}/documents.parquet")
        kept = []
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            f(spark, now, d).write.parquet(f"{d}/{k}")
            now = spark.read.parquet(f"{d}/{k}")
            assert k == 4 or now.columns == docs.columns, stage
            kept.append(sorted((r.doc_id for r in now.select("doc_id").collect()), key=str))
        if name == "empty":
            assert kept == [[]] * 5
            continue
        assert len(kept[0]) == 33 and kept[0].count(3) == 3 and 50 not in kept[0]  # repeated rows stay, empty texts fail
        assert kept[1] == sorted([*range(30), *([None] if None in kept[1] else [])], key=str) and kept[2] == kept[1]
        assert set(kept[3]) <= set(kept[2]) and kept[4] == kept[3] and kept[3]
