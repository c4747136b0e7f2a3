"""Nearest neighbours: repeated rows, and recall on the table itself."""

from collections import defaultdict

import numpy as np
import pytest

from tidewright.llm import ann, queries


def brute(ids, x, q, k=10):
    away = np.sqrt(((x - x[q]) ** 2).sum(1))
    away[ids == ids[q]] = np.inf
    return np.lexsort((ids, away))[: min(k, int((ids != ids[q]).sum()))], away


def test_repeated_queries_are_asked_once(spark):
    g = np.random.default_rng(1)
    x = g.standard_normal((300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (100, x[100].tolist())] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "2 AS probed")
    got = defaultdict(list)
    for r in ann.search(spark, df).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    # The repeated rows of 0 and 100 are candidates of their own for other queries.
    ids = np.array([i for i, _ in rows])
    y = np.array([v for _, v in rows])
    for q in (0, 100, 200):
        best, _ = brute(ids, y, q)
        assert sorted(got[q]) == [(k + 1, ids[i]) for k, i in enumerate(best)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_on_the_table(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id is not null").collect() if r.embedding is not None and None not in r.embedding]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    fine = np.isfinite(x).all(1) & (x != 0).any(1)
    ids, x = ids[fine], x[fine]
    got = defaultdict(dict)
    for r in queries.op6_ann(spark, d).collect():
        got[r.query_id][r.vec_id] = r.score
    asked = np.flatnonzero(ids % 100 == 0)
    assert set(got) == set(ids[asked].tolist())
    hit = want = 0
    for q in asked:
        best, away = brute(ids, x, q)
        place = {int(i): k for k, i in enumerate(ids)}
        assert len(got[ids[q]]) == len(best) and all(abs(s - away[place[v]]) < 1e-9 for v, s in got[ids[q]].items())
        hit += len(set(ids[best].tolist()) & set(got[ids[q]]))
        want += len(best)
    print(sf, hit / want)
    assert hit >= 0.9 * want
