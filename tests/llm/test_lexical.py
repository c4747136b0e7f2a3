"""Ranked search against scoring every document, the treaps' order, and that subtrees are pruned."""

import collections
import math
import random
import re

import numpy as np

from tidewright.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, k):
    tf = [collections.Counter(terms_of(t)) for _, t in docs]
    n = [sum(c.values()) for c in tf]
    n_docs, n_terms = sum(x > 0 for x in n), sum(n)
    df = collections.Counter(t for c in tf for t in c)
    known = collections.defaultdict(set)
    for i, t in items:
        known[i] |= set(terms_of(t))
    out = []
    for item, terms in known.items():
        found = []
        for (d, _), c, size in zip(docs, tf, n, strict=True):
            m = 50 + 50 * size * n_docs // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def corpus(n=700):
    g = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["ÄRGER", "naïve", "한국어", "Fe2O3", "x" * 300]
    draw = lambda: words[min(int(g.expovariate(1 / 40)), len(words) - 1)]
    docs = [(i, g.choice(" \n-.\t,").join(draw() for _ in range(g.randint(1, 120)))) for i in range(n)]
    docs += [(10_000 + i, docs[3][1]) for i in range(200)]  # equal copies: ties
    docs += [(5, docs[5][1]), (None, docs[9][1]), (None, None), (901, ""), (902, "... ---"), (903, " ".join(draw() for _ in range(40_000)))]
    items = [(i, " ".join(draw().upper() for _ in range(g.randint(1, 40)))) for i in range(30)]
    return docs, [*items, (3, "W1 extra"), (3, "W1 extra"), (50, None), (51, "unknown words"), (52, docs[3][1]), (None, "w1 w2")]


def test_equals_scoring_every_document(spark, monkeypatch):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, "c", b"c", 1) for i, t in docs], "doc_id long, text string, ids string, terms binary, n_docs int").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    for size, block in ((1 << 24, 1 << 21), (20_000, 300)):
        monkeypatch.setattr(lexical, "SEGMENT_BYTES", size)
        monkeypatch.setattr(lexical, "BLOCK_CHARS", block)
        index = lexical.Index(spark, d)
        if size > 20_000:
            assert index.segments.count() <= 3
        for k in (50, 3):
            assert sorted(map(tuple, lexical.search(spark, index, q, k=k).collect()), key=str) == by_hand(docs, items, k)
    assert lexical.search(spark, index, q.limit(0)).count() == 0
    empty = lexical.Index(spark, d.limit(0))
    assert lexical.search(spark, empty, q).collect() == []


def test_treaps_are_search_trees_and_heaps():
    docs, _ = corpus(300)
    s = lexical.Segment({k: v[0] for k, v in lexical.segment([(i, (t or "").encode()) for i, t in docs], 500, 30_000).to_pydict().items()})
    none = len(s.keys)
    assert (np.diff(s.keys) > 0).all()
    for t in range(0, len(s.roots), 7):
        seen, todo = [], [(s.roots[t], -1, s.n_docs)]
        while todo:
            i, low, high = todo.pop()
            if i == none:
                continue
            assert low < s.docs[i] < high
            assert all(c == none or s.impacts[c] <= s.impacts[i] for c in (s.left[i], s.right[i]))
            seen.append(i)
            todo += [(s.left[i], low, s.docs[i]), (s.right[i], s.docs[i], high)]
        assert sorted(seen) == list(range(s.bounds[t], s.bounds[t + 1]))
    low, high = np.array([0, 40, 100]), np.array([s.n_docs, 90, 101])
    terms = np.arange(len(s.roots))
    cut = s.inside(np.repeat(s.roots[None, :], 3, 0), low, high)
    for row, (a, b) in enumerate(zip(low, high, strict=True)):
        for t in terms:
            part = [i for i in range(s.bounds[t], s.bounds[t + 1]) if a <= s.docs[i] < b]
            assert (cut[row, t] == none) == (not part) and s.impacts[cut[row, t]] == max((s.impacts[i] for i in part), default=0)


def test_subtrees_are_pruned():
    g = random.Random(6)
    rows = [(i, " ".join(f"w{min(int(g.expovariate(1 / 60)), 999)}" for _ in range(80)).encode()) for i in range(5000)]
    s = lexical.Segment({k: v[0] for k, v in lexical.segment(rows, 5000, 400_000).to_pydict().items()})
    top = lexical.Best(10)
    scored = s.search(np.array([s.number[b"w290"], s.number[b"w300"], s.number[b"w1"]]), np.array([6000, 6200, 60]), top)
    assert len(top.rows) == 10 and scored < 1500
