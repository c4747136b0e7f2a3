"""Quality rules: scores against brute force, long repeated texts, held-out accuracy on the labelled table."""

import collections
import math
import random

import regex
import xxhash

from tidewright.llm import quality

TOKEN = regex.compile(quality.TOKEN)


def number(h):
    return h - (1 << 64) if h >> 63 else h


def slots(text):
    """Hashes as Spark's xxhash64 makes them: of a text, and of two numbers one after the other."""
    h = [xxhash.xxh64_intdigest(t.encode(), 42) for t in TOKEN.findall(text.lower())]
    pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:], strict=False)]
    return [number(x) % quality.SLOTS for x in h + pairs]


def test_scores_against_brute_force(spark):
    g = random.Random(2)
    words = ["".join(g.choice("abcdefgh") for _ in range(3)) for _ in range(300)] + ["###", "it's", "É", "a_b", "12"]
    texts = [" ".join(g.choice(words[: 60 + 40 * (i % 7)]) for _ in range(g.randrange(0, 150))) for i in range(120)] + ["", " ", "one"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "no id " * 30), (500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS `_id`", "2 AS i", "'x' AS t", "3 AS slot")
    labels = [(i, int(i % 3 == 0), int(i % 9 == 0)) for i in range(100)] + [(0, 1, None), (None, 1, 0), (7, None, 0)]
    got = quality.judged(spark, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    good = {i for i, q, x in labels if q == 1 and not x and i is not None}
    raw = collections.Counter(s for _, t in rows for s in slots(t or ""))
    target = collections.Counter(s for i, t in rows if i in good for s in slots(t or ""))
    share = target.total() / raw.total()
    assert len(got) == len(rows)
    of = {r.id: r for r in got}
    for i, t in rows:
        at = slots(t or "")
        each = [math.floor(abs(x) + 0.5) * (1 if x > 0 else -1) for x in (1000 * math.log((target[s] + quality.PRIOR) / (raw[s] * share + quality.PRIOR)) for s in at)]
        score = sum(each) / (1000 * len(at)) if at else 0.0
        assert abs(of[i].score - score) < 2e-3 / max(1, len(at)) + 1e-9
        assert of[i].kept == (not of[i].base_failed and of[i].score >= quality.MARGIN)
    none = quality.judged(spark, docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert all(r.score == 0 and r.kept != r.base_failed for r in none)


def test_long_repeated_texts(spark):
    """200,000 words of which nearly all lie in repeated windows: the count is as quick as a sort."""
    g = random.Random(5)
    phrases = [" ".join(f"w{g.randrange(10**6)}" for _ in range(5)) for _ in range(20_000)]
    texts = [" ".join(phrases + phrases), "same " * 200_000, " ".join(f"u{i}" for i in range(200_000)), " ".join(phrases[:19_999] + phrases[:1])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.n_repeat_words for r in quality.judged(spark, docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert got == {0: 200_000, 1: 200_000, 2: 0, 3: 10}


def test_labelled_table(spark):
    """Trusted documents that were not trained on are kept, junk is rejected."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    train = labels.where("doc_id % 2 = 0")
    got = {r.id: r for r in quality.judged(spark, docs, train).collect()}
    held = [r for r in labels.where("doc_id % 2 = 1").collect() if not got[r.doc_id].base_failed]
    clean = [got[r.doc_id].kept for r in held if r.quality == 1 and not r.toxic]
    junk = [got[r.doc_id].kept for r in held if r.quality == 0]
    print(sum(clean) / len(clean), sum(junk), len(junk))
    assert sum(clean) >= 0.97 * len(clean) and (not junk or sum(junk) <= 0.3 * len(junk))
