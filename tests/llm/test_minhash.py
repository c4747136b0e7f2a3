"""Near duplicates: salted joins, other thresholds, and all links of the table itself against brute force."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.llm import minhash


def links(texts, idf, threshold, slack=0.0):
    """All pairs of different texts whose weighted Jaccard similarity is at least the threshold, by an inverted index."""
    doc, value, tf = minhash.shingles(pa.array(texts, pa.string()))
    weight = minhash.weights(value, tf, idf).astype(float)
    total = np.bincount(doc, weight, len(texts))
    holders, common = collections.defaultdict(list), collections.Counter()
    for d, v, w in zip(doc.tolist(), value.tolist(), weight.tolist(), strict=True):
        for e, x in holders[v]:
            common[e, d] += min(w, x)
        holders[v].append((d, w))
    return [(a, b) for (a, b), c in common.items() if c >= (threshold + slack) * (total[a] + total[b] - c)]


def roots(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(i) for i in range(n)]


def near_copies(seed=3):
    g = random.Random(seed)
    words = ["".join(g.choice("abcdefghij") for _ in range(g.randint(2, 8))) for _ in range(2000)]
    prose = [" ".join(g.choice(words) for _ in range(g.randint(60, 160))) for _ in range(30)]
    texts = list(prose)
    for base in prose[:8]:
        for k in (1, 2, 3, 5, 8, 12):
            w = base.split()
            for _ in range(k):
                w[g.randrange(len(w))] = f"changed{g.randrange(10**6)}"
            texts += [" ".join(w)] * (1 + k % 2)
    texts += [prose[0] + f" tail{i}" for i in range(90)]  # one large bucket in every band
    return texts


@pytest.mark.parametrize(("threshold", "salts"), [(0.8, 1), (0.8, 3), (0.5, 2), (0.3, 1)])
def test_classes_at_other_thresholds(spark, threshold, salts, monkeypatch):
    monkeypatch.setattr(minhash, "salts_of", lambda spark: salts)
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("_salt", F.lit("clash")).withColumn("n", F.lit(1))
    idf = minhash.inverse_frequencies(minhash.keyed(docs))
    got = {r.id: r.class_id for r in minhash.classes(spark, docs, threshold=threshold).collect()}
    sure, most = (roots(len(texts), links(texts, idf, threshold, slack)) for slack in (1e-6, -1e-6))
    lost = [i for i in range(len(texts)) if got[sure[i]] != got[i]]
    assert not lost, lost
    assert all(most[got[i]] == most[i] for i in range(len(texts)))


def test_all_links_of_the_table(spark):
    """Recall of links at or above 0.8 over whole tables."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.orderBy("doc_id").collect()]
    idf = minhash.inverse_frequencies(minhash.keyed(docs))
    got = {r.id: r.class_id for r in minhash.classes(spark, docs).collect()}
    pairs = links([t for _, t in rows], idf, minhash.THRESHOLD, 1e-6)
    found = sum(got[rows[a][0]] == got[rows[b][0]] for a, b in pairs)
    print(found, len(pairs))
    assert len(pairs) > 20 and found == len(pairs)
    same = roots(len(rows), links([t for _, t in rows], idf, minhash.THRESHOLD, -1e-6))
    first = {d: i for i, (d, _) in enumerate(rows)}
    by_text = {}
    for i, (_, t) in enumerate(rows):
        by_text.setdefault(t, i)
    assert all(same[first[c]] == same[first[d]] or rows[first[c]][1] == rows[first[d]][1] for d, c in got.items())


def test_without_hubs_no_join_deals_them(spark, monkeypatch):
    plans, write = {}, minhash.written

    def written(s, df, tag):
        plans.setdefault(tag, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(s, df, tag)

    monkeypatch.setattr(minhash, "written", written)
    g = random.Random(5)
    texts = [" ".join(str(g.randint(0, 9999)) for _ in range(80)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t + " tail" * (i > 19)) for i, t in enumerate(texts * 2)], "doc_id long, text string")
    for least in (minhash.LARGE, 0):  # no hub; every text of a pair is one
        monkeypatch.setattr(minhash, "LARGE", least)
        found = {r.id: r.class_id for r in minhash.classes(spark, docs).collect()}
        assert found == {i: i % 20 for i in range(40)}
        assert any("hub" in p for p in plans.pop("close")) == (least == 0)
