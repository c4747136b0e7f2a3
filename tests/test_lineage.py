"""Walks against breadth-first search, on graphs with cycles too; sorted walks against all pairs."""

import random

from tidewright.operators import folds, lineage


def test_walk_equals_search(spark):
    g = random.Random(3)
    for n, m in ((12, 14), (9, 20), (1, 0)):
        edges = {(g.randrange(n), g.randrange(n)) for _ in range(m)}
        want = {}
        for child in {c for c, _ in edges}:
            level, depth = {child}, 0
            while level:
                depth += 1
                level = {p for c, p in edges if c in level} - {p for c, p in want if c == child}
                want |= {(child, p): depth for p in level}
        df = spark.createDataFrame([*edges, *list(edges)[:2]], "child int, parent int")
        walked = lineage.walk(df)
        assert {(r.child, r.parent): r.depth for r in walked.collect()} == want and walked.count() == len(want)
        assert {(r.node, r.length) for r in lineage.cycles(walked).collect()} == {(c, d) for (c, p), d in want.items() if c == p}


def test_steps_equal_all_pairs():
    g = random.Random(4)
    for _ in range(300):
        rows = [(g.random() < 0.5, g.randint(0, 9), i) for i in range(g.randint(0, 30))]
        below, latest = [], ([], [])
        for k, (seen, v, i) in enumerate(rows):
            before = [(x, j) for s, x, j in rows[:k] if s and x < v]
            assert folds.below_step(below, seen, v, i) == (None if seen else (i, len(before)))
            assert folds.latest_step(latest, seen, v, i) == (None if seen else (i, before[-1][1] if before else None))
