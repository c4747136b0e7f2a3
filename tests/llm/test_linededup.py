"""Line dedup against counting by hand, its runs against one count, and its defined results."""

import collections
import hashlib
import random

from pyspark.sql import functions as F

from tidewright.llm import linededup


def by_hand(rows, least):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))

    n = collections.Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or n[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return sorted(out, key=str)


def rows_of(n=300):
    g = random.Random(1)
    common = ["Cookie notice", "ÄRGER Über", " nbsp ", " sep", "x" * 9000]
    out = []
    for i in range(n):
        lines = [g.choice(common).swapcase() if g.random() < 0.1 else " \t" * g.randint(0, 2) + g.choice([*common, f"line {i} {j}", f"some {g.randint(0, 60)}", "", "  "]) + "\r" * g.randint(0, 1) for j in range(g.randint(1, 9))]
        out.append((i, "\n".join(lines)))
    return [*out, (None, "Cookie notice\nmine"), (7, out[7][1]), (7, out[7][1]), (900, None), (901, ""), (902, "\n"), (903, "\n".join(f"row {j % 4000}" for j in range(60_000))), (904, "Cookie notice")]


def test_equals_counting_by_hand(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(i, t, "clash", b"c", 1, 1) for i, t in rows], "doc_id long, text string, k string, h binary, batch int, n int")
    for least, batches in ((10, 4), (2, 5), (1, 1)):
        got = sorted(map(tuple, linededup.dedup(spark, docs, least=least, batches=batches).collect()), key=str)
        assert got == by_hand(rows, least)
    empty = linededup.dedup(spark, docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["id", "n_lines", "n_dropped", "kept_sha256", "kept"]


def test_runs_are_levelled_sorted_and_merged_without_shuffle(spark):
    g = random.Random(2)
    batches = [[g.randint(0, 40) if g.random() < 0.7 else g.randint(0, 10_000) for _ in range(400)] for _ in range(7)]
    runs = linededup.Runs(spark, least=10)
    for b in batches:
        runs.add(spark.createDataFrame([(x.to_bytes(4, "big"),) for x in b], "h binary"))
    assert [len(x) for x in runs.levels] == [1, 1, 1]  # seven runs of one batch, compacted by twos
    for name in (x for level in runs.levels for x in level):
        for part in spark.table(name).select("h", F.input_file_name().alias("f")).toPandas().groupby("f").h:
            assert part[1].map(bytes).is_monotonic_increasing
    a, b = runs.levels[1][0], runs.levels[2][0]
    plan = spark.table(a).hint("merge").join(spark.table(b).withColumnRenamed("n", "m"), "h", "full_outer")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    n = collections.Counter(x for b in batches for x in b)
    assert {int.from_bytes(r.h, "big") for r in runs.common().collect()} == {x for x, c in n.items() if c >= 10}
    names = [x for level in runs.levels for x in level]
    runs.close()
    assert not any(spark.catalog.tableExists(x) for x in names)


def test_a_known_common_hash_is_not_counted_again(spark):
    runs = linededup.Runs(spark, least=3, fanout=9)
    one = spark.createDataFrame([(b"a",)] * 3 + [(b"b",)], "h binary")
    runs.add(one)
    again = runs.add(one)
    assert [(bytes(r.h), r.n) for r in spark.table(again).collect()] == [(b"b", 1)]
    runs.close()
