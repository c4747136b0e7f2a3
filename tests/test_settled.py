"""The last recoveries against plain readings, and against every edit of one character."""

import itertools
import random
from collections import Counter
from difflib import SequenceMatcher

from test_brute_force import pair
from test_recovery import CUES, DECISIONS, LINES

from tidewright.operators import repair, settled, tempo
from tidewright.plans import recovery_q

HAN = "天地人日月山水火木金土云"


def made(g, task):
    lines, cues, decisions = [], [], []
    for s in range(2):
        for _ in range(g.randint(6, 10)):
            text = g.choice(["哈嘿哈嘿", "哦耶"]) if g.random() < 0.1 else "".join(g.choice(HAN) for _ in range(g.randint(5, 9)))
            lines.append((task, s, len(lines), 4000 * len(lines), repair.key(text), text))
    k = 0
    while k < len(lines):
        n = g.choice([1, 1, 1, 2])
        took = lines[k : k + n]
        text = "".join(x[5] for x in took)
        cut = g.randint(1, len(text) - 1) if g.random() < 0.25 else len(text)
        for part in filter(None, (text[:cut], text[cut:])):
            said, weak = list(part), g.random() < 0.45
            if weak and g.random() < 0.6:
                said[g.randrange(len(said))] = g.choice(HAN)
            said = g.choice(["heyo heyo", "".join(said)]) if part == "哈嘿哈嘿" else "".join(said)
            c = len(cues)
            cues.append((task, c, 4000 * k + 100 * c, 4000 * k + 3000, repair.key(said), said))
            claim = g.random() < 0.9
            decisions.append((task, c, "review" if weak else "unchanged", "r", g.choice([0.3, 0.95]), took[0][2] if claim else None, len(took) if claim else None))
        k += n
    timing = [(task, d[1], lines[d[5]][1], d[5], g.choice("AAB"), "ready", g.choice([0.0, 0.0, 900.0])) for d in decisions if d[2] != "review" and d[6] == 1]
    return cues, lines, decisions, timing


def naive_regions(cues, lines, decisions, timing):
    dec = {d[1]: d[2:] for d in decisions}
    out = {c: (*d, None) for c, d in dec.items()}
    span = lambda c: (dec[c][3], dec[c][3] + dec[c][4]) if dec[c][4] else None
    for review, run in itertools.groupby(range(len(cues)), lambda c: dec[c][0] == "review"):
        run = list(run)
        if not review or run[0] == 0 or run[-1] == len(cues) - 1 or not span(run[0] - 1) or not span(run[-1] + 1):
            continue
        l, r = span(run[0] - 1), span(run[-1] + 1)  # noqa: E741
        low, high = l[1], r[0]
        if high <= low or len({lines[k][1] for k in (*range(*l), *range(low, high), *range(*r))}) > 1:
            continue
        spans = [span(c) for c in run]
        if any(x is None or not low <= x[0] < x[1] <= high for x in spans) or any(a[0] > b[0] or a[1] > b[1] for a, b in itertools.pairwise(spans)):
            continue
        s = lines[low][1]
        sure = [(t[1], t[3]) for t in timing if t[2] == s and t[4] == "A" and abs(t[6]) <= 750]
        if not any(c < run[0] and k < low for c, k in sure) or not any(c > run[-1] and k >= high for c, k in sure):
            continue
        gap = lines[low:high]
        texts = [cues[c][5] for c in run]
        if any(map(tempo.vocal, [*texts, *(x[5] for x in gap)])) or (len(run) > 1 and any(tempo.LATIN.search(t) for t in [*texts, *(x[5] for x in gap)])):
            continue
        a, b = "".join(map(repair.key, texts)), "".join(x[4] for x in gap)
        if min(len(a), len(b)) < 12 or min(len(a), len(b)) / max(len(a), len(b)) < 0.85 or pair(a, b) < 0.8:
            continue
        parts, doubt = repair.shared_out(texts, repair.content("".join(x[5] for x in gap)))
        new = [repair.rendered(t, p) for t, p in zip(texts, parts, strict=True)]
        if doubt or not all(parts) or "".join(map(repair.key, new)) != b:
            continue
        owner, at = [x[2] for x in gap for _ in x[4]], 0
        for c, t in zip(run, new, strict=True):
            n = len(repair.key(t))
            out[c] = ("unchanged" if cues[c][4] == repair.key(t) else "replace", settled.REGION, min(dec[c][2], 0.89), owner[at], owner[at + n - 1] + 1 - owner[at], t)
            at += n
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def naive_final(cues, lines, decisions):
    dec = {d[1]: d[2:] for d in decisions}
    out = {c: (*d, None) for c, d in dec.items()}
    for c, d in dec.items():
        if d[0] != "review" or d[4] != 1:
            continue
        x, a, b = lines[d[3]], cues[c][4], lines[d[3]][4]
        p = dec.get(c - 1)
        after = p is not None and p[0] != "review" and bool(p[4]) and p[3] + p[4] == d[3] and lines[d[3] - 1][1] == x[1]
        got = None
        if after and {settled.sounds(cues[c][5]), settled.sounds(x[5])} == {"han", "latin"}:
            got = settled.CROSS, x[5]
        elif len(a) == len(b) >= 6 and sum(p != q for p, q in zip(a, b, strict=True)) <= 1:
            got = settled.ONE_CHARACTER, x[5]
        elif c:
            n = max([k for k in range(4, len(b) - 2) if cues[c - 1][4].endswith(b[:k])], default=0)
            rest = b[n:]
            if 4 <= n < len(b) - 2 and len(rest) >= 4 and a != rest and distance(a, rest) <= 1 and SequenceMatcher(None, a, rest).ratio() >= 0.84:
                got = settled.SUFFIX, x[5][n:]
        if got:
            out[c] = ("replace", got[0], max(d[2], settled.SCORES[got[0]]), d[3], 1, got[1])
    return out


def test_regions_and_lines_equal_plain_readings(spark):
    parts = [made(random.Random(t), t) for t in range(150)]
    cues, lines, decisions = (spark.createDataFrame([r for p in parts for r in p[k]], s) for k, s in enumerate((CUES, LINES, DECISIONS)))
    timing = spark.createDataFrame([r for p in parts for r in p[3]], "task long, cue int, source int, line long, grade string, model_status string, residual_ms double")
    for got, naive, least in ((settled.bounded_recovered(cues, lines, decisions, timing), naive_regions, {settled.REGION: 20}), (settled.final_recovered(cues, lines, decisions), lambda *p: naive_final(*p[:3]), {settled.ONE_CHARACTER: 30, settled.CROSS: 1})):
        want = {(t, c): v for t, p in enumerate(parts) for c, v in naive(*p).items()}
        have = {(r.task, r.cue): (r.action, r.reason, r.score, r.line, r.n_lines, r.text) for r in got.collect()}
        assert have == want
        kinds = Counter(v[1] for v in have.values())
        assert all(kinds[k] >= n for k, n in least.items()), kinds


def test_one_character():
    g = random.Random(1)
    for _ in range(5000):
        a, b = ("".join(g.choice("ab") for _ in range(g.randint(0, 6))) for _ in range(2))
        assert settled.one_off(a, b) == (distance(a, b) <= 1)


def test_owned_suffix():
    line, before = "天地人日火木金土云山水", "云天地人日"
    assert settled.owned_suffix("火木金士云山水", line, "天地人日 火木金土云山水", before) == "火木金土云山水"
    assert settled.owned_suffix("火木金土云山水", line, line, before) is None  # nothing to mend
    assert settled.owned_suffix("火木", "天地人日火木", "天地人日火木", "天地人日") is None
    assert settled.owned_suffix("火木金士云山水", line, line, "云天地人") is None


def test_queries(spark):
    d = "/root/testdata/sf0.001"
    assert any(r.reason == settled.REGION for r in recovery_q.i11_bounded_regions(spark, d).collect())
    assert sum(r.reason == settled.ONE_CHARACTER for r in recovery_q.i12_final_recovery(spark, d).collect()) > 5
