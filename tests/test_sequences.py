"""Paths against the whole matrix of states, and turns of word moves against a plain loop over all cues."""

import random
from difflib import SequenceMatcher

from tidewright.operators import sequences
from tidewright.operators.coverage import plain
from tidewright.plans import sequences_q


def best_total(seen, events):
    """The best score of a path over every state (observations done, events done)."""
    n, m, low = len(seen), len(events), -1e12
    s = [[low] * (m + 1) for _ in range(n + 1)]
    s[0][0] = 0.0
    skip_o = [0.06 if len(plain(x[2])) < 2 or sequences.vocal(x[2]) else 0.34 for x in seen]
    skip_e = [0.18 if sequences.vocal(x[1]) else 0.62 for x in events]
    for i in range(n + 1):
        for j in range(m + 1):
            if i < n:
                s[i + 1][j] = max(s[i + 1][j], s[i][j] - skip_o[i])
            if j < m:
                s[i][j + 1] = max(s[i][j + 1], s[i][j] - skip_e[j])
            if i == n:
                continue
            a, b, text = seen[i]
            for reused, first, sizes in ((False, j, (1, 2, 3)), (True, j - 1, (1, 2, 3))):
                for size in sizes:
                    if first < 0 or first + size > m:
                        continue
                    span = events[first : first + size]
                    p, q = span[0][0], span[-1][0]
                    off = a - q if q < a else p - b if p > b else 0
                    score, cover, _ = sequences.said(text, " ".join(x[1] for x in span))
                    if off > 5500 or (reused and (score < 0.48 or cover < 0.32)) or (not reused and score < 0.25 and cover < 0.24 and off):
                        continue
                    t = 3.25 * score + 0.8 * cover + ((0.85 if off == 0 else max(-1.25, 0.1 - off / 3500)) - 0.28 if reused else 1.05 if off == 0 else max(-1.25, 0.2 - off / 3500)) - 0.16 * (size - 1)
                    s[i + 1][first + size] = max(s[i + 1][first + size], s[i][j] + t)
    return s[n][m], skip_o, skip_e


def test_path_is_as_good_as_any(spark):
    g = random.Random(11)
    words = "the sun is over sea and night day oh yeah 사랑 我们 we wait long cold".split()
    groups, seen_rows, event_rows = {}, [], []
    for t in range(40):
        events = [(3000 * j + g.randint(-500, 500), " ".join(g.choice(words) for _ in range(g.randint(1, 4)))) for j in range(g.randint(0, 12))]
        seen, at = [], 0
        for _ in range(g.randint(0, 10)):
            at += g.randint(500, 5000)
            base = g.choice(events)[1] if events and g.random() < 0.8 else " ".join(g.choice(words) for _ in range(3))
            seen.append((at, at + g.randint(300, 3000), base[: g.randint(1, 30)]))
        groups[t] = seen, events
        seen_rows += [(t, i, *x) for i, x in enumerate(seen)]
        event_rows += [(t, j, *x) for j, x in enumerate(events)]
    o = spark.createDataFrame(seen_rows, "song long, i int, start_ms long, end_ms long, text string").repartition(3)
    e = spark.createDataFrame(event_rows, "song long, j int, at_ms long, text string")
    steps = {}
    for r in sequences.aligned(o, e, "song").collect():
        steps.setdefault(r.song, []).append(r)
    reused = 0
    for t, (seen, events) in groups.items():
        want, skip_o, skip_e = best_total(seen, events)
        path = sorted(steps.get(t, []), key=lambda r: r.i)
        assert all(a.i < b.i and a.high <= b.low for a, b in zip(path, path[1:], strict=False))
        assert abs(sum(r.gain for r in path) - sum(skip_o) - sum(skip_e) - want) < 1e-6
        reused += sum(r.reused for r in path)
    assert reused > 5
    assert sequences.aligned(o.limit(0), e, "song").count() == 0
    plan = sequences.edges(o, e, "song")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def naive_resplit(left, right, o, q):
    a, b = sequences.UNIT.findall(left), sequences.UNIT.findall(right)
    if len(plain(o)) < 2 or len(plain(q)) < 2 or not a or not b:
        return None
    units = a + b
    ratio = lambda x, y: SequenceMatcher(None, plain(x), plain(y), autojunk=False).ratio()
    score = lambda k: (ratio(o, sequences.joined(units[:k])) + ratio(q, sequences.joined(units[k:]))) / 2
    k = max(range(1, len(units)), key=lambda k: (score(k), k == len(a), -k))
    gain = score(k) - score(len(a))
    x, y = sequences.joined(units[:k]), sequences.joined(units[k:])
    edge = gain >= 0.02 and 1 <= abs(k - len(a)) <= 3 and min(ratio(o, x), ratio(q, y)) >= 0.96
    return (x, y, gain) if k != len(a) and (edge or (score(k) >= 0.79 and gain >= 0.15)) else None


def test_turns_equal_a_plain_loop(spark):
    g = random.Random(12)
    words = "the sun is over sea and night day we wait long cold rain".split()
    rows, want, moves = [], {}, 0
    for t in range(30):
        texts = [" ".join(g.choice(words) for _ in range(g.randint(2, 6))) for _ in range(g.randint(1, 8))]
        units = " ".join(texts).split()
        cuts = sorted({0, len(units), *(min(len(units), max(0, sum(len(x.split()) for x in texts[:k]) + g.choice([0, 0, -1, 1, 2]))) for k in range(1, len(texts)))})
        now = [" ".join(units[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        texts += ["x y"] * (len(now) - len(texts))
        fixed = [g.random() < 0.1 for _ in now]
        starts, at = [], 0
        for _ in now:
            starts.append(at)
            at += 2500 + g.choice([0, 0, 0, 3000])
        rows += [(t, i, starts[i], starts[i] + 2500, x, texts[i], None, None, fixed[i]) for i, x in enumerate(now)]
        moved = [0] * len(now)
        for _ in range(6):
            found = []
            for i in range(len(now) - 1):
                if not fixed[i] and not fixed[i + 1] and starts[i + 1] - starts[i] - 2500 <= 1200 and (got := naive_resplit(now[i], now[i + 1], texts[i], texts[i + 1])):
                    found.append((-got[2], i, got))
            used = set()
            for _, i, got in sorted(found):
                if not {i, i + 1} & used:
                    used |= {i, i + 1}
                    now[i], now[i + 1] = got[:2]
                    moved[i], moved[i + 1] = moved[i] + 1, moved[i + 1] + 1
            if not used:
                break
        want |= {(t, i): (x, n) for i, (x, n) in enumerate(zip(now, moved, strict=True))}
        moves += sum(moved)
    df = spark.createDataFrame(rows, "song long, cue int, start_ms long, end_ms long, text string, seen string, again string, sure double, fixed boolean")
    got = {(r.song, r.cue): (r.text, r.moved) for r in sequences.resegmented(df, "song").collect()}
    assert got == want and moves > 20
    assert sequences.resegmented(df.limit(0), "song").count() == 0


def test_a_second_observation_is_preferred_where_it_fits():
    row = {"l_seen": "xx yy", "l_again": "the sun", "l_sure": 0.7, "l_text": "the sun"}
    assert sequences.preferred(row, "l") == "the sun"
    assert sequences.preferred(row | {"l_sure": 0.5}, "l") == "xx yy" and sequences.preferred(row | {"l_again": None}, "l") == "xx yy"


def test_queries(spark):
    d = "/root/testdata/sf0.001"
    path = sequences_q.i16_reused_path(spark, d).collect()
    assert len(path) > 500 and any(r.reused for r in path)
    assert sum(r.moved > 0 for r in sequences_q.i18_resegmented(spark, d).collect()) > 50
