"""Repair plans: dealing out characters against all least edits, and decisions case by case and over a table."""

import random
from collections import Counter

from test_brute_force import best_script, pair

from tidewright.operators import folds, repair
from tidewright.plans import catalog


def test_characters_are_dealt_by_a_least_edit():
    g = random.Random(3)
    for _ in range(120):
        parts = ["".join(g.choice("ab ") for _ in range(g.randrange(0, 4))) for _ in range(g.choice([1, 2, 2, 3]))]
        target = "".join(g.choice("abc") for _ in range(g.randrange(0, 5)))
        bare = [p.replace(" ", "") for p in parts]
        owner = [i for i, b in enumerate(bare) for _ in b]
        # Where a gap or an edge is, by the content before it.
        edges = {k for k in range(1, len(owner)) if owner[k] != owner[k - 1]}
        gaps, seen = set(), 0
        for p in parts:
            own = 0
            for a, c in enumerate(p):
                if c != " ":
                    if own and p[a - 1] == " ":
                        gaps.add(seen)
                    own, seen = own + 1, seen + 1
        want, at, doubt = [""] * len(parts), 0, set()
        for op, had, got in best_script("".join(bare), target):
            if got:
                want[owner[at] if at < len(owner) else owner[-1] if owner else 0] += got
                if op == "insert" and at in edges | gaps:
                    doubt.add("segmentation" if at in edges else "layout")
            at += had is not None
        got, why = repair.shared_out(parts, target)
        assert got == want and (why.split("_")[0] if why else None) == ("segmentation" if "segmentation" in doubt else "layout" if doubt else None)
        assert repair.content(repair.rendered(parts[0], target)) == target
        assert [c for c in repair.rendered(parts[0], target) if c == " "] == [c for c in parts[0] if c == " "]


def test_decisions():
    lines = ["The sun is over the sea", "And the night is long", "We wait for the day to come", "Nothing else is near"]
    act = lambda cues, want=lines: [(x[1], x[2].split("_")[0], x[-1]) for x in repair.decided(cues, want)]
    assert act(["the sun is over the sea!", *lines[1:]])[0] == ("replace", "high", "The sun is over the sea!")
    assert {x[0] for x in act(lines)} == {"unchanged"}
    split = repair.decided(["And the", "night iz long"], [lines[1]])
    assert [(x[0], x[1], x[-1]) for x in split] == [(0, "unchanged", "And the"), (1, "replace", "night is long")]
    assert [x[:2] for x in act(["zzzz qqqq " * 6, lines[1]], [lines[1]])][0] == ("review", "unmatched")
    assert act(["And the nigt was lonk", "xxxxxxxx"], [lines[1]])[0][0] == "review"
    assert repair.decided([], lines) == [] and act(["a"], []) == [("review", "unmatched", "a")]
    assert repair.rivalled("helloone", ["helloone", "helloonf", "other"], 0, 1, 1.0) is False
    assert repair.rivalled("helloone", ["hellootwo", "helloone", "other", "helloonee"], 1, 2, 0.97) is True
    assert repair.rivalled("helloone", ["helloone", "x", "helloone"], 0, 1, 1.0) is False  # the same text is no rival


def test_the_tables_plan(spark):
    d = "/root/testdata/sf0.001"
    got = {}
    for r in catalog.queries()["i3_repair_plan"](spark, d).collect():
        got.setdefault(r.l_orderkey, []).append(r)
    line = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{d}/part.parquet").collect()}
    orders = {}
    for r in spark.read.parquet(f"{d}/lineitem.parquet").collect():
        orders.setdefault(r.l_orderkey, []).append((r.l_linenumber, int(r.l_quantity), line[r.l_partkey]))
    seen = Counter()
    for o, rows in list(orders.items())[:150]:
        spell = lambda n, x: x.replace("e", "a") if n % 5 == 0 else x + "!" if n % 5 == 1 else x[::-1] if n % 7 == 0 else x
        cues, lines = [x for _, x in sorted((k, spell(n, x)) for k, n, x in rows if n % 11)], [x for _, x in sorted((k, x) for k, _, x in rows)]
        a, b = ([repair.key(x) for x in t] for t in (cues, lines))
        steps = folds.span_alignment(a, b, pair)
        mine = {r.cue: r for r in got.get(o, [])}
        assert sorted(mine) == list(range(len(cues)))
        for n, (kind, p, q, i, j, s) in enumerate(steps):
            source, want = "".join(a[p:q]), "".join(b[i:j])
            near = [k[0] for k in steps[max(0, n - 1) : n + 2]]
            rivals = [pair(source, "".join(b[x:y])) for x in range(max(0, i - 3), min(len(b), j + 3)) for y in range(x + 1, min(len(b), x + 4) + 1) if "".join(b[x:y]) != want]
            short, long = sorted((len(source), len(want)))
            why = "unmatched" if kind == "left_gap" else "low" if s < 0.78 or not short or short / long < 0.6 or (short <= 3 and s < 0.84) else "adjacent" if s < 0.96 and set(near) != {"match"} else "ambiguous" if any(x >= max(0.78, s - 0.06) for x in rivals) else None
            for k in range(p, q):
                r = mine[k]
                seen[r.reason.split("_")[0]] += 1
                assert (r.reason.split("_")[0] == why) if why else r.reason.split("_")[0] not in ("unmatched", "low", "adjacent", "ambiguous"), (o, k, why, r)
                assert r.action == ("review" if why or "review" in r.reason or "empty" in r.reason else "unchanged" if r.text == cues[k] else "replace")
                assert r.action != "replace" or [c for c in r.text if repair.layout(c)] == [c for c in cues[k] if repair.layout(c)]
    assert len(seen) >= 4, seen
