"""Work that must not grow faster than its input: how often the dear steps are taken, and that what they give stays the same."""

import os
import random
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import text as tx
from tidewright.operators import coverage, evaluation, folds, routing, sequences, vectors
from tidewright.plans import evidence_q, folds_q, metrics_q, recovery_q, sequences_q, text_q

D = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def counting(fn):
    def run(*a, **k):
        run.calls += 1
        return fn(*a, **k)

    run.calls = 0
    return run


def texts(g, n, letters="abc de"):
    return ["".join(g.choice(letters) for _ in range(g.randrange(0, 14))) for _ in range(n)]


def test_ratio_is_that_of_matching_blocks():
    g = random.Random(1)
    for letters in ("ab", "abcdefgh ", "가나a"):
        for a, b in zip(texts(g, 1500, letters), texts(g, 1500, letters), strict=True):
            assert tx.ratio(a, b) == tx.often(a, b) == SequenceMatcher(None, a, b, autojunk=False).ratio()
            assert tx.pair_bound(len(a), len(b)) >= tx.pair(a, b)


def test_few_breaks_are_solved_exactly(monkeypatch):
    g = np.random.default_rng(2)
    for n in (8, 20, 70):
        x, y = np.arange(n, dtype=float), np.cumsum(g.random(n) * 100)
        y[n // 2 :] += 40 * np.arange(n - n // 2)
        solved = counting(np.linalg.lstsq)
        monkeypatch.setattr(np.linalg, "lstsq", solved)
        breaks, sol, err = folds.hinges(x, y)
        monkeypatch.undo()
        assert solved.calls <= 20  # of up to 1,800 choices
        best = None
        for c in combinations(x[3:-3], len(breaks)):
            if np.diff([0, *c, n]).min() >= 3:
                a = np.column_stack([np.ones(n), x, *[np.maximum(0, x - b) for b in c]])
                e = float(np.abs(y - a @ np.linalg.lstsq(a, y, rcond=None)[0]).mean())
                best = min(best or (e, c), (e, c))
        assert breaks and best == (err, tuple(breaks))


def test_dependent_breaks_are_solved():
    x = np.repeat(np.arange(11.0), 2)
    breaks, _, err = folds.hinges(x, np.abs(x - 4))
    assert breaks == [4.0] and err < 1e-9
    assert folds.hinges(np.ones(9), np.arange(9.0))[0] == []


def test_spans_are_scored_where_they_may_be_best():
    """Lines that are alike need no runs of lines."""
    lines = [f"line number {k} {chr(97 + k) * 6}" for k in range(6)]
    score = counting(tx.pair)
    got = folds.span_alignment(lines, lines, score, bound=tx.pair_bound)
    assert [x[:5] for x in got] == [("match", k, k + 1, k, k + 1) for k in range(6)]
    assert score.calls <= 40  # of 324


def test_spans_are_those_of_all_moves():
    g = random.Random(4)
    for _ in range(150):
        a, b = texts(g, g.randrange(0, 6)), texts(g, g.randrange(0, 6))
        assert folds.span_alignment(a, b, tx.pair, bound=tx.pair_bound) == folds.span_alignment(a, b, tx.pair)


def test_groups_of_cues_are_compared_where_lengths_allow_it(monkeypatch):
    ref = [(k * 3000, k * 3000 + 2500, f"{'abcdef'[k] * 8} {k}") for k in range(6)]
    compared = counting(tx.often)
    monkeypatch.setattr(tx, "often", compared)
    assert evaluation.group_alignment(ref, ref) == [(k, k + 1, k, k + 1) for k in range(6)]
    assert 0 < compared.calls <= 80  # of 225


def test_groups_come_sorted_and_whole(spark):
    rows = [(k % 7, -k, f"r{k}") for k in range(100)]
    df = spark.createDataFrame(rows, "key int, at int, name string")
    got = folds.by_sorted(df, ["key"], ["at"], ["at", "name"], lambda at, name: [(len(at), ",".join(name))], "n int, names string").collect()
    want = {k: [n for _, n in sorted((a, n) for key, a, n in rows if key == k)] for k in range(7)}
    assert {r.key: (r.n, r.names) for r in got} == {k: (len(v), ",".join(v)) for k, v in want.items()}
    assert folds.by_sorted(df.where("key < 0"), ["key"], ["at"], ["name"], lambda name: [(1,)], "n int").count() == 0


def test_paths_never_fall():
    """Against all choices."""
    from itertools import product

    g = random.Random(6)
    for _ in range(40):
        n = g.randrange(0, 5)
        score = [np.array([g.random() for _ in range(3)]) for _ in range(n)]
        place = [np.array([g.uniform(0, 6) for _ in range(3)]) for _ in range(n)]

        def worth(c):
            value, last = 0.0, None
            for s, p, k in zip(score, place, c, strict=True):
                if k is None:
                    value -= 0.2
                    continue
                if last is not None and p[k] < last:
                    return -9.0
                value += s[k] - (0 if last is None else 0.05 * abs(p[k] - last) / (1 + abs(p[k])))
                last = p[k]
            return value

        got = folds.monotone_path(score, place)
        assert len(got) == n and abs(worth(got) - max(map(worth, product((None, 0, 1, 2), repeat=n)))) < 1e-9


def test_few_runs_of_a_line_are_compared_in_full(monkeypatch):
    g = random.Random(8)
    words = ["".join(g.choice("etaoinsr") for _ in range(g.randrange(2, 8))) for _ in range(40)]
    line, seen = " ".join(words), " ".join(words[10:16]).replace("e", "a")
    compared = counting(coverage.similarity)
    monkeypatch.setattr(coverage, "similarity", compared)
    got = coverage.best_run(seen, line)
    monkeypatch.undo()
    assert compared.calls <= 40  # of some 200 runs
    want = [coverage.similarity(coverage.plain(seen), "".join(words[a : a + n])) for n in range(4, 10) for a in range(41 - n)]
    assert got[1:3] == max(want)
    assert coverage.covered(line, [seen], [seen])[2] == got[1]


def test_rows_are_dealt_to_many_tasks(spark):
    """A table of one small file isn't one task."""
    assert recovery_q.c22_best_run(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_means_are_summed_in_one_order(spark):
    """However rows are dealt; the mean of these differs in its last bit by order."""
    values = [-0.1, -0.7, -1.2, -1.0, -0.6, -0.9, -0.3, -1.2]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)] + [(1, 8, None), (2, 0, None)], "job int, row int, logprob double").withColumn("no_speech", F.lit(0.1))
    want = 0.0
    for v in values:
        want += v
    for parts in (1, 3, 8):
        got = {r.job: r for r in routing.segment_quality(df.repartition(parts).orderBy(F.rand(parts)), ["job"], ["row"]).collect()}
        assert got[1].logprob == want / 8 and got[2].logprob is None and (got[1].n_segments, got[1].complete) == (9, False)


@pytest.mark.parametrize("name", ["i9_sequence_recovery", "i13_ownership_guard"])
def test_recoveries_send_no_growing_table_through_the_driver(spark, name):
    plan = recovery_q.QUERIES[name][0](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize(("name", "score"), [("i16_reused_path", "said_score"), ("l6_editor_evidence", "span_support")])
def test_texts_are_compared_once(spark, name, score):
    query = {**sequences_q.QUERIES, **evidence_q.QUERIES}[name][0]
    plan = query(spark, D)._jdf.queryExecution().executedPlan().toString()
    assert sum(score in line for line in plan.split("\n") if "EvalPython" in line) == 1


def test_median_slope_needs_no_room_for_all_pairs(monkeypatch):
    g = np.random.default_rng(3)
    x, y = np.sort(g.integers(0, 60, 80)).astype(float), g.normal(size=80) * 10.0 ** g.integers(-9, 9, 80)
    for n in (0, 1, 2, 7, 80):
        s = [(y[j] - y[i]) / (x[j] - x[i]) for i in range(n) for j in range(n) if x[i] < x[j]]
        monkeypatch.setattr(folds, "PAIRS", 1 << 21)
        once = folds.median_slope(x[:n], y[:n])
        monkeypatch.setattr(folds, "PAIRS", 200)
        if n > 20:
            assert max(map(len, folds.slopes(x[:n], y[:n]))) <= 200
        assert once == (folds.middle(np.array(s)) if s else None) and folds.median_slope(x[:n], y[:n]) == once


def test_robust_lines_make_pairs_where_the_events_are(spark):
    plan = metrics_q.QUERIES["d7_robust_line"][0](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_best_rows_by_blocks_are_those_of_all_rows(monkeypatch):
    g = np.random.default_rng(4)
    v = g.normal(size=(400, 8))
    v[7], v[11], v[13, 2] = v[5], v[390], np.nan
    ids, q = np.arange(400), np.arange(0, 400, 50)

    def score(a, b):
        s = 0.0
        for x, y in zip(v[a], v[b], strict=True):
            s = s + x * y
        return (s + 1) / 2

    few = 0
    found = {int(a): {} for a in q}
    for at in range(0, 400, 100):
        for a, b, s in zip(*vectors.best(q, v[q], ids[at : at + 100], v[at : at + 100], 0.55, 19), strict=True):
            found[int(a)][int(b)] = s
            few += 1
    for a, got in found.items():
        want = {b: s for b in range(400) if b != a and not (s := score(a, b)) <= 0.55}
        assert all(s == want[b] or np.isnan(s) for b, s in got.items())
        taken = [[sorted(x)[k] for k in folds.suppressed(np.array([x[b] for b in sorted(x)]), np.array(sorted(x)), 5, 3)] for x in (want, got)]
        assert taken[0] == taken[1]
    assert few < 8 * (3 * 19 + 100)


def test_short_keys_take_their_turns_at_once(spark, monkeypatch):
    g = random.Random(6)
    words = "the sun is over sea and night day we wait long cold rain".split()
    rows = []
    for t in range(12):
        units = [g.choice(words) for _ in range(30)]
        n = 6 if t % 2 else 3
        cuts = [0, *(4 * i + g.choice([0, 1, -1]) for i in range(1, n)), 4 * n]
        for i in range(n):
            rows.append((t, i, 3000 * i, None if g.random() < 0.1 else 3000 * i + 2500, " ".join(units[cuts[i] : cuts[i + 1]]), " ".join(units[4 * i : 4 * i + 4]), "the sun", g.choice([0.9, 0.1, None]), g.choice([False, False, False, False, True, None])))
    df = spark.createDataFrame(rows, "song long, cue int, start_ms long, end_ms long, text string, seen string, again string, sure double, fixed boolean")
    wrote = counting(sequences.written)
    monkeypatch.setattr(sequences, "written", wrote)
    at_once = sorted(sequences.resegmented(df, "song").collect())
    assert wrote.calls == 1
    monkeypatch.setattr(sequences, "WHOLE", 3)  # half of the keys turn over a table
    assert sorted(sequences.resegmented(df, "song").collect()) == at_once and wrote.calls > 1
    assert any(r.moved for r in at_once)


@pytest.mark.parametrize("name", ["h4_pair_score", "h5_support_score", "h6_contained_score", "c21_line_sequences"])
def test_dear_comparisons_are_dealt_to_all_tasks(spark, name):
    plan = {**text_q.QUERIES, **folds_q.QUERIES}[name][0](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan  # which adaptive execution doesn't join to a few
