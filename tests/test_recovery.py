"""Recovery against a plain reading of its rules on whole small tables: every way to deal lines, every walk."""

import itertools
import math
import random
from collections import Counter
from statistics import median

from test_brute_force import pair

from tidewright.operators import recovery
from tidewright.plans import recovery_q

CUES = "task long, cue int, start_ms long, end_ms long, key string, text string"
LINES = "task long, source int, line long, at_ms long, key string, text string"
DECISIONS = "task long, cue int, action string, reason string, score double, line long, n_lines int"


def made(g, task, n_sources=2):
    """Cues, lines and decisions of a task: lines 4 s apart at a rate of 1.1, cues of one or more, drifts, reviews, gaps and repeats."""
    lines, cues, decisions, at = [], [], [], 0
    for s in range(n_sources):
        n = g.randint(9, 16)
        own = []
        for k in range(n):
            text = f"line {s} {k} {'x' * g.randint(0, 6)}" if g.random() < 0.9 else "la la"
            own.append((task, s, len(lines) + k, 9000 + 4400 * k, text.replace(" ", ""), text))
        k = 0
        while k < n:
            took = own[k : k + g.choice([1, 1, 1, 1, 2, 3])]
            start = at + 4000 * k + g.choice([0, g.randint(-300, 300), g.randint(-1500, 1500)])
            text = " ".join(x[5] for x in took)
            weak = g.random() < 0.3
            if weak and g.random() < 0.5:
                text = text.replace("l", "q")[: g.randint(1, 30)]
            cue = len(cues)
            cues.append((task, cue, start, start + 3500 * len(took), text.replace(" ", ""), text))
            reason = g.choice(["low", "low", "low", "timing_model_confirms_song_edge_canonical"]) if g.random() < 0.1 else "low"
            if g.random() < 0.97:
                claim = not weak or g.random() < 0.4
                decisions.append((task, cue, "review" if weak else g.choice(["unchanged", "unchanged", "replace"]), reason, 0.5 if weak else 0.8 if len(took) > 1 else g.choice([1.0, 1.0, 1.0, 0.95]), took[0][2] if claim else None, len(took) if claim else None))
            if g.random() < 0.1:
                cues.append((task, len(cues), start + 1800, start + 2500, "adlib", "adlib"))
                decisions.append((task, len(cues) - 1, "review", "unmapped", 0.1, None, None))
            k += len(took)
        lines += own
        at += 4000 * n + g.choice([0, 9000])
    return cues, lines, decisions


def naive_anchors(cues, lines, decisions):
    by_line = {x[2]: x for x in lines}
    pos = {x[2]: sum(y[1] == x[1] and y[2] < x[2] for y in lines) for x in lines}
    cue = {c[1]: c for c in cues}
    use = [d for d in decisions if d[2] != "review" and d[6] == 1 and d[3] not in recovery.PROTECTED and d[5] in by_line]
    seen = Counter((by_line[d[5]][1], cue[d[1]][4]) for d in use)
    times = Counter((x[1], x[4]) for x in lines)
    out = []
    for d in sorted(use, key=lambda d: d[1]):
        x, c = by_line[d[5]], cue[d[1]]
        if d[4] >= 0.92:
            a = d[2] == "unchanged" and d[4] >= 0.995 and c[4] == x[4] and times[x[1], x[4]] == 1 and seen[x[1], c[4]] == 1
            out.append((c[1], x[1], pos[x[2]], c[2], x[3], "A" if a else "B"))
    return out


def naive_model(rows, prior=None):
    n, a = len(rows), sum(r[5] == "A" for r in rows)
    if (n < 2 or a < 2) if prior is not None else (n < 4 or a < 3):
        return "insufficient_strong_anchors", None, None
    x, y = [r[3] for r in rows], [r[4] for r in rows]
    if max(x) - min(x) < 8000 or max(y) - min(y) < 8000:
        return "insufficient_anchor_span", None, None
    s = [(q[4] - p[4]) / (q[3] - p[3]) for i, p in enumerate(rows) for q in rows[i + 1 :] if q[3] - p[3] >= 3000 and q[4] > p[4]]
    s = [v for v in s if 0.5 <= v <= 2]
    rate = prior if prior is not None else median(s) if s else None
    if rate is None:
        return "insufficient_rate_evidence", None, None
    offset = median(b - rate * p for p, b in zip(x, y, strict=True))
    off = [abs(b - offset - rate * p) for p, b in zip(x, y, strict=True)]
    status = "ready" if median(off) <= 450 and sum(v <= 750 for v in off) / n >= 0.75 else "unstable"
    if prior is not None and s and abs(median(s) - prior) / prior > 0.03:
        status = "rate_prior_conflict"
    return status, rate, offset


def naive_sequence(cues, lines, decisions, prior=None):
    anchors = naive_anchors(cues, lines, decisions)
    out = {d[1]: (*d[2:], None) for d in decisions}
    dec, n = dict(out), len(cues)
    models = {s: naive_model([a for a in anchors if a[1] == s], prior) for s in {x[1] for x in lines}}
    at = lambda s, ms: int(round((ms - models[s][2]) / models[s][1]))
    sure = [a for a in anchors if models[a[1]][0] == "ready" and abs(a[3] - at(a[1], a[4])) <= 750]
    song = {s: [x for x in lines if x[1] == s] for s in models}
    strong = {a[0] for a in sure}

    def claim(c, took, reason):
        same = cues[c][4] == "".join(x[4] for x in took)
        out[c] = ("unchanged" if same else "replace", reason, min(dec[c][2], 0.91), took[0][2], len(took), " ".join(x[5] for x in took))

    for left, right in itertools.pairwise(sure):
        block = list(range(left[0] + 1, right[0]))
        gap = song[left[1]][left[2] + 1 : right[2]]
        if left[1] != right[1] or not block or len(block) > 16 or not gap or any(c not in dec or dec[c][1] in recovery.PROTECTED for c in block) or not any(dec[c][0] == "review" for c in block):
            continue
        starts, mix = [cues[c][2] for c in block] + [right[3]], [at(left[1], x[3]) for x in gap] + [at(right[1], right[4])]
        if any(b <= a for a, b in itertools.pairwise(starts[:-1])) or abs(mix[-1] - right[3]) > 750:
            continue
        best = None
        for takes in itertools.product(range(1, 5), repeat=len(block)) if len(block) <= 6 else ():
            if sum(takes) != len(gap):
                continue
            cost, j = 0, 0
            parts = []
            for i, k in enumerate(takes):
                c = cues[block[i]]
                if abs(mix[j] - c[2]) > 1300 or mix[j + k - 1] > c[3] + 1500 or abs(mix[j + k] - starts[i + 1]) > 2500:
                    break
                parts.append(abs(mix[j] - c[2]) / 900 + abs(mix[j + k] - starts[i + 1]) / 900 + 0.35 * abs(math.log(max(1, sum(len(x[4]) for x in gap[j : j + k])) / max(1, len(c[4])))))
                j += k
            else:
                cost = sum(reversed(parts))
                if best is None or cost < best[0] - 1e-12:
                    best = cost, takes
        if best:
            j = 0
            for c, k in zip(block, best[1], strict=True):
                claim(c, gap[j : j + k], recovery.BOUNDED)
                j += k
    for s in dict.fromkeys(a[1] for a in sure):
        own = [a for a in sure if a[1] == s]
        for way, (c, _, p, *_) in ((1, own[-1]), (-1, own[0])):
            c, p = c + way, p + way
            while 0 <= c < n and 0 <= p < len(song[s]) and c not in strong and c in dec and dec[c][1] not in recovery.PROTECTED:
                if (cues[c][2] - cues[c - way][2]) * way <= 0:
                    break
                after = cues[c + 1][2] if way == 1 and c + 1 < n and cues[c + 1][2] > cues[c][2] else None
                rest = song[s][p:] if way == 1 else song[s][: p + 1]
                best = None
                for k in range(1, min(4, len(rest)) + 1):
                    took = rest[:k] if way == 1 else rest[-k:]
                    onset, key = abs(at(s, took[0][3]) - cues[c][2]), "".join(x[4] for x in took)
                    like = pair(cues[c][4], key)
                    if onset > 900 or at(s, took[-1][3]) > cues[c][3] + 1200 or (k > 1 and like < 0.42) or (len(cues[c][4]) <= 2 and like < 0.8):
                        continue
                    bound = abs(at(s, rest[k][3]) - after) if after is not None and k < len(rest) else None
                    cost = onset / 900 + 0.5 * (1 - like) + 0.25 * abs(math.log(len(key) / max(1, len(cues[c][4])))) + (0 if bound is None else min(bound, 2500) / 1200)
                    if best is None or cost < best[0]:
                        best = cost, k, bound, took
                if best is None:
                    break
                claim(c, best[3], recovery.FRONTIER)
                c, p = c + way, p + way * best[1]
                if best[2] is not None and best[2] > 1600:
                    break
    return out


def naive_timing(cues, lines, decisions, models):
    dec = {d[1]: (*d[2:], None) for d in decisions}
    by_line = {x[2]: x for x in lines}
    song = {s: [x for x in lines if x[1] == s] for s in {x[1] for x in lines}}
    at = lambda s, ms: int(round((ms - models[s][2]) / models[s][1]))

    def anchor(c):
        d = dec.get(c)
        return by_line.get(d[3]) if d and d[0] != "review" and d[2] >= 0.92 and d[4] == 1 else None

    def fits(c):
        x = anchor(c)
        return x is not None and models[x[1]][0] == "ready" and abs(cues[c][2] - at(x[1], x[3])) <= 750

    def blocks():
        out = []
        for review, run in itertools.groupby(range(len(cues)), lambda c: c in dec and dec[c][0] == "review"):
            run = list(run)
            if review and len(run) <= 8:
                out.append(run)
        return out

    new = {}
    for run in blocks():
        l, r = run[0] - 1, run[-1] + 1  # noqa: E741
        if l < 0 or r >= len(cues) or not fits(l) or not fits(r) or anchor(l)[1] != anchor(r)[1]:
            continue
        gap = [by_line[k] for k in range(anchor(l)[2] + 1, anchor(r)[2])]
        s = anchor(l)[1]
        if not gap or any(x[1] != s for x in gap) or not len(run) <= len(gap) <= 4 * len(run):
            continue
        starts, mix = [cues[c][2] for c in run] + [cues[r][2]], [at(s, x[3]) for x in gap]
        if any(b <= a for a, b in itertools.pairwise(starts)) or any(b <= a for a, b in itertools.pairwise(mix)):
            continue
        j, got = 0, []
        for i, c in enumerate(run):
            if j >= len(gap) or abs(cues[c][2] - mix[j]) > 750:
                break
            took = [gap[j]]
            j += 1
            while j < len(gap) and len(took) < 4 and len(gap) - j > len(run) - i - 1 and mix[j] < starts[i + 1] - 250:
                took.append(gap[j])
                j += 1
            got.append((c, took))
        if len(got) == len(run) and j == len(gap):
            for c, took in got:
                text = " ".join(x[5] for x in took)
                new[c] = ("unchanged" if text == cues[c][5] else "replace", recovery.CONFIRMED, dec[c][2], took[0][2], len(took), text)
    dec |= new
    new = {}
    for run in blocks():
        for way, c in ((-1, run[-1] + 1), (1, run[0] - 1)):
            chain = [c, c - way]
            if any(not 0 <= k < len(cues) or not fits(k) for k in chain) or anchor(c)[1] != anchor(c - way)[1]:
                continue
            s = anchor(c)[1]
            p, q = song[s].index(anchor(c)), song[s].index(anchor(c - way))
            rest = song[s][:p][::-1] if way == -1 else song[s][p + 1 :]
            if q != p - way or not 1 <= len(rest) <= 4:
                continue
            passed, got = 0, {}
            for k in run[::way]:
                if not rest:
                    break
                if abs(cues[k][2] - at(s, rest[0][3])) <= 500:
                    x = rest.pop(0)
                    got[k] = ("unchanged" if x[5] == cues[k][5] else "replace", recovery.EDGE, dec[k][2], x[2], 1, x[5])
                    passed = 0
                elif dec[k][3] is None and dec[k][4] is None and passed < 3:
                    passed += 1
                else:
                    break
            if got:
                new |= got
                break
    return dec | new


def frames(spark, tasks):
    parts = [made(random.Random(t), t, 1 + t % 3) for t in range(tasks)]
    return parts, [spark.createDataFrame([r for p in parts for r in p[k]], s) for k, s in enumerate((CUES, LINES, DECISIONS))]


def found(df):
    return {(r.task, r.cue): (r.action, r.reason, r.score, r.line, r.n_lines, r.text) for r in df.collect()}


def test_sequence_recovery_equals_trying_everything(spark):
    parts, (cues, lines, decisions) = frames(spark, 60)
    want = {(t, c): v for t, p in enumerate(parts) for c, v in naive_sequence(*p).items()}
    got = found(recovery.sequence_recovered(cues, lines, decisions))
    long = {(t, c) for t, p in enumerate(parts) for c in range(len(p[0])) if got.get((t, c), "  ")[1] == recovery.BOUNDED and want[t, c][1] != recovery.BOUNDED}
    assert len(long) <= 20  # regions of more than six cues aren't tried out
    assert {k: v for k, v in got.items() if k not in long} == {k: v for k, v in want.items() if k not in long}
    kinds = Counter(v[1] for v in got.values())
    assert kinds[recovery.BOUNDED] > 20 and kinds[recovery.FRONTIER] > 10
    priors = spark.createDataFrame([(t, s, 1.1) for t in range(60) for s in range(3)], "task long, source int, rate double")
    got = found(recovery.sequence_recovered(cues, lines, decisions, priors))
    want = {(t, c): v for t, p in enumerate(parts) for c, v in naive_sequence(*p, 1.1).items()}
    assert sum(got[k] != want[k] for k in want) <= 20 and got.keys() == want.keys()
    assert recovery.sequence_recovered(cues.limit(0), lines, decisions.limit(0)).count() == 0


def test_timing_recovery_equals_a_plain_walk(spark):
    parts, (cues, lines, decisions) = frames(spark, 60)
    models = recovery.projections(recovery.text_anchors(cues, lines, decisions), lines)
    told = {(r.task, r.source): (r.status, r.rate, r.offset) for r in models.collect()}
    want = {}
    for t, p in enumerate(parts):
        own = {s: v for (task, s), v in told.items() if task == t}
        want |= {(t, c): v for c, v in naive_timing(*p, own).items()}
    got = found(recovery.timing_recovered(cues, lines, decisions, models))
    assert got == want
    kinds = Counter(v[1] for v in got.values())
    assert kinds[recovery.CONFIRMED] > 10 and kinds[recovery.EDGE] > 5


def test_lines_are_dealt_at_least_cost():
    g = random.Random(5)
    for _ in range(300):
        n = g.randint(1, 4)
        m = g.randint(n, min(9, 4 * n))
        starts = sorted(g.sample(range(0, 30_000, 500), n + 1))
        mix = sorted(g.sample(range(0, 30_000, 500), m + 1))
        cues = [{"start_ms": a, "end_ms": a + g.randint(500, 9000), "key": "x" * g.randint(0, 9)} for a in starts[:-1]]
        lines = [{"mix_ms": a, "key": "y" * g.randint(1, 9)} for a in mix[:-1]]
        best = None
        for takes in itertools.product(range(1, 5), repeat=n):
            if sum(takes) != m:
                continue
            cost, j, ok = 0, 0, True
            for c, k, after in zip(cues, takes, starts[1:], strict=True):
                onset, bound = abs(mix[j] - c["start_ms"]), abs(mix[j + k] - after)
                ok = ok and onset <= 1300 and bound <= 2500 and mix[j + k - 1] <= c["end_ms"] + 1500
                cost += onset / 900 + bound / 900 + 0.35 * abs(math.log(sum(len(x["key"]) for x in lines[j : j + k]) / max(1, len(c["key"]))))
                j += k
            if ok and (best is None or cost < best[0] - 1e-9):
                best = cost, list(takes)
        assert recovery.dealt(cues, lines, starts[-1], mix[-1]) == (best and best[1])


def test_queries_recover(spark):
    d = "/root/testdata/sf0.001"
    kinds = Counter(r.reason for r in recovery_q.i9_sequence_recovery(spark, d).collect())
    assert kinds[recovery.BOUNDED] + kinds[recovery.FRONTIER] > 20
    assert any(r.reason == recovery.CONFIRMED for r in recovery_q.i8_timing_recovery(spark, d).collect())
