"""Coverage by index or time, best runs and boundary ownership, each against trying everything."""

import itertools
import random
from difflib import SequenceMatcher

from test_brute_force import pair

from tidewright.operators import coverage, ownership, recovery
from tidewright.operators.repair import key
from tidewright.plans import recovery_q


def naive_score(o, t):
    if not o or not t:
        return 0.0, 0.0
    cover = min(len(o), len(t)) / max(len(o), len(t))
    s = SequenceMatcher(None, o, t, autojunk=False).ratio()
    return (max(s, 0.45 + 0.5 * cover) if o in t or t in o else s), cover


def naive_run(observed, line):
    best = None
    words, n = line.split(), max(1, len(observed.split()))
    for run in [line, *(" ".join(words[i : i + k]) for k in range(max(1, n - 2), min(len(words), n + 3) + 1) for i in range(len(words) - k + 1))]:
        got = max(naive_score(coverage.plain(observed), coverage.plain(run)), (-1, -1))
        if best is None or got > best[1:]:
            best = (run, *got)
    return best


def test_best_run_equals_trying_every_run():
    g = random.Random(2)
    words = ["the", "sun", "sea", "and", "night", "day", "oh", "Ünder", "a"]
    for _ in range(800):
        line = " ".join(g.choice(words) for _ in range(g.randint(0, 12)))
        seen = " ".join(g.choice([*words, "sum", "nigt", "-"]) for _ in range(g.randint(0, 6)))
        assert coverage.best_run(seen, line)[:3] == naive_run(seen, line)
    run, score, cover, mode = coverage.best_run("annyeong", "안녕 친구")
    assert mode == "korean_pronunciation" and run == "안녕" and score > 0.8


def test_bounds_hold():
    g = random.Random(3)
    from collections import Counter

    for _ in range(2000):
        a, b = ("".join(g.choice("abc") for _ in range(g.randint(1, 9))) for _ in range(2))
        assert coverage.bound(Counter(a), len(a), b, a in b or b in a) >= coverage.similarity(a, b)[0] - 1e-12


def test_coverage_equals_a_plain_reading(spark):
    g = random.Random(4)
    texts = ["the sun is over the sea", "oh yeah", "and the night is long and cold", "we wait", None, ""]
    events = [(t, 10 * t + i, i, 4000 * i, g.choice(texts)) for t in range(6) for i in range(10)]
    rows = []
    for t in range(6):
        for i in range(14):
            a = g.randint(-2000, 42_000)
            said = g.choice(texts) or g.choice([None, ""])
            rows.append((t, 100 * t + i, a, a + g.randint(0, 5000), [g.randint(0, 9) for _ in range(g.randint(0, 2))], said and said[: g.randint(3, 40)]))
    e = spark.createDataFrame(events, "track long, event long, idx int, at_ms long, text string")
    r = spark.createDataFrame(rows, "track long, row long, start_ms long, end_ms long, indices array<int>, text string")
    want_pairs, want = set(), {}
    for t, ev, idx, at, text in events:
        linked = [x for x in rows if x[0] == t and idx in x[4]]
        near = [x for x in rows if x[0] == t and x[3] >= at - 3000 and x[2] <= at + 3000]
        want_pairs |= {(t, ev, x[1], x in linked, x in near) for x in linked + near}
        line = text or ""
        found = []
        for part in (linked, near):
            seen = [x[5] or "" for x in sorted(part, key=lambda x: (x[2], x[3], x[1]))]
            seen += [" ".join(seen)] if seen else []
            s, c = max((naive_run(x, line)[1:] for x in seen), default=(0.0, 0.0))
            found.append((s, c, any(coverage.plain(line) in coverage.plain(x) for x in seen)))
        (a, b, x), (c, d, y) = found
        ok = x or y or (a >= 0.7 and b >= 0.65) or (c >= 0.7 and d >= 0.65) if len(coverage.plain(line)) >= 12 else bool(linked) or c >= 0.55
        want[ev] = (ok, bool(linked), a, b, x, c, d, y)
    pairs = coverage.coverage_pairs(e, r)
    assert {tuple(x) for x in pairs.collect()} == want_pairs and pairs.count() == len(want_pairs)
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert {x.event: tuple(x)[2:] for x in coverage.coverage(e, r).collect()} == want
    assert coverage.coverage(e.limit(0), r).count() == 0


def naive_settled(wl, wr, l, r, drops, moves):  # noqa: E741
    """Every cut of every fragment, written out."""
    now = (pair(key(wl), key(l)) + pair(key(wr), key(r))) / 2
    best = None
    a, b, ends, starts = l.strip(), r.strip(), wl.strip(), wr.strip()
    for kind, n in itertools.product(("drop_right", "drop_left", "forward", "backward"), range(2, 7)):
        if kind in ("drop_right", "forward"):
            f = ends[len(ends) - n :] if n <= len(ends) else None
        else:
            f = starts[:n] if n <= len(starts) else None
        if f is None or len(key(f)) < 2:
            continue
        if kind == "drop_right" and drops and a.endswith(f) and b.startswith(f) and not starts.startswith(f):
            new = (l, b[n:].lstrip())
        elif kind == "drop_left" and drops and a.endswith(f) and b.startswith(f) and not ends.endswith(f):
            new = (a[: len(a) - n].rstrip(), r)
        elif kind == "forward" and moves and b.startswith(f) and not l.rstrip().endswith(f):
            new = (l.rstrip() + f, b[n:].lstrip())
        elif kind == "backward" and moves and a.endswith(f) and not r.lstrip().startswith(f):
            new = (a[: len(a) - n].rstrip(), f + r.lstrip())
        else:
            continue
        if not all(new):
            continue
        gain = (pair(key(wl), key(new[0])) + pair(key(wr), key(new[1]))) / 2 - now
        if gain >= 0.05 and (best is None or gain > best[0]):
            best = (gain, kind, new)
    if best is None:
        return None
    lost = len(key(l + r)) - len(key("".join(best[2])))
    ok = key(l + r) == key("".join(best[2])) if best[1] in ("forward", "backward") else 2 <= lost <= 6
    return best[2] if ok else None


def test_boundary_changes_equal_trying_all():
    g = random.Random(7)
    hits = 0
    for _ in range(4000):
        wl, wr = (" ".join("".join(g.choice("abc") for _ in range(g.randint(1, 4))) for _ in range(g.randint(1, 3))) for _ in range(2))
        cut = g.randint(1, min(6, len(wl)))
        l, r = g.choice([(wl[:-cut], wl[-cut:] + " " + wr), (wl, wl[-cut:] + wr), (wl + " " + wr[:cut], wr[cut:]), (wl, wr), (wl + wr[:cut], wr)])
        for drops, moves in ((True, True), (True, False), (False, True), (False, False)):
            got = ownership.settled(wl, wr, l, r, drops, moves)
            assert got == naive_settled(wl, wr, l, r, drops, moves)
            hits += got is not None
    assert hits > 500


def test_guard_over_a_table(spark):
    """A fold over each task, whatever the partitions: the change at one boundary is seen at the next."""
    g = random.Random(9)
    cues, decisions, want = [], [], {}
    for t in range(20):
        n = g.randint(1, 12)
        texts = [" ".join("".join(g.choice("abcd") for _ in range(g.randint(2, 4))) for _ in range(g.randint(1, 3))) for _ in range(n)]
        rows = []
        for i, x in enumerate(texts):
            new = g.choice([None, x + " " + texts[i + 1][:3] if i + 1 < n else x, x[2:] or x, texts[i - 1][-3:] + x if i else x])
            reason = g.choice([recovery.BOUNDED, "matched"])
            rows.append({"text": x, "key": key(x), "action": g.choice(["replace", "replace", "review", None]), "reason": reason, "score": 0.95, "line": i, "n_lines": 1, "new_text": new, "now": new or x})
        cues += [(t, i, r["text"], r["key"]) for i, r in enumerate(rows)]
        decisions += [(t, i, r["action"], r["reason"], 0.95, i, 1, r["new_text"]) for i, r in enumerate(rows) if r["action"]]
        for left, right in itertools.pairwise(rows):
            ownership.guard(left, right)
        want |= {(t, i): (r["action"], r["reason"], r["score"], r["line"], r["new_text"]) for i, r in enumerate(rows) if r["action"]}
    c = spark.createDataFrame(cues, "task long, cue int, text string, key string").repartition(5)
    d = spark.createDataFrame(decisions, "task long, cue int, action string, reason string, score double, line long, n_lines int, text string")
    got = {(r.task, r.cue): (r.action, r.reason, r.score, r.line, r.text) for r in ownership.ownership_restored(c, d).collect()}
    assert got == want and sum(v[1] == ownership.RESTORED for v in got.values()) > 10


def test_queries_find_something(spark):
    d = "/root/testdata/sf0.001"
    assert sum(r.reason == ownership.RESTORED for r in recovery_q.i13_ownership_guard(spark, d).collect()) > 5
    got = recovery_q.c26_coverage(spark, d).collect()
    assert 0 < sum(r.covered for r in got) < len(got)
    pairs = recovery_q.c22_best_run(spark, d).collect()
    assert pairs and all(0 <= r.score <= 1 for r in pairs)
