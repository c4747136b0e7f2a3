"""Recovery at known rates against a plain reading cue by cue, and streams against every way to cut them."""

import itertools
import random
from collections import Counter
from statistics import median

from test_brute_force import pair
from test_recovery import CUES, LINES

from tidewright.operators import repair, tempo
from tidewright.plans import recovery_q

DECISIONS = "task long, cue int, action string, reason string, score double, line long, n_lines int, text string"
HAN = "天地人日月山水火木金土云雨风花鸟"


def made(g, task):
    lines, cues, decisions, at = [], [], [], 0
    for s in range(g.randint(1, 2)):
        n = g.randint(8, 14)
        own = []
        for k in range(n):
            text = g.choice(["哦耶", "oh yeah"]) if g.random() < 0.08 else "".join(g.choice(HAN) for _ in range(g.randint(4, 8))) + (" abc" if g.random() < 0.05 else "")
            own.append((task, s, len(lines) + k, 9000 + 4400 * k, repair.key(text), text))
        k = 0
        while k < n:
            took = own[k : k + g.choice([1, 1, 1, 2])]
            whole = "".join(x[5] for x in took)
            cuts = [whole] if g.random() < 0.7 or len(whole) < 4 else [whole[: len(whole) // 2], whole[len(whole) // 2 :]]
            for c, text in enumerate(cuts):
                start = at + 4000 * k + 1800 * c + g.randint(-150, 150) + g.choice([0, 0, 0, 700])
                weak = g.random() < 0.35 or len(cuts) > 1
                said = list(text)
                if weak and g.random() < 0.6:
                    said[g.randrange(len(said))] = g.choice(HAN)
                said = "".join(said)
                if g.random() < 0.1:
                    said = g.choice(["哦 " + said, said + " yeah", "oh " + said])
                one = len(took) == 1 and len(cuts) == 1
                claim = g.random() < 0.5 or not weak
                reason = "low" if weak else tempo.SAFE[0] if one else "other"
                cue = len(cues)
                cues.append((task, cue, start, start + 1700 * len(took) + (1600 if one else 0), repair.key(said), said))
                decisions.append((task, cue, "review" if weak else "unchanged", reason, g.choice([0.1, 0.5]) if weak else 0.95, took[0][2] if claim else None, len(took) if claim else g.choice([None, 0]), None if weak else said))
            k += len(took)
        lines += own
        at += 4000 * n + 7000
    return cues, lines, decisions


def naive(cues, lines, decisions, rate):
    dec = {d[1]: list(d[2:]) for d in decisions}
    by_line = {x[2]: x for x in lines}
    lex = {s: [x for x in lines if x[1] == s and not tempo.vocal(x[5])] for s in {x[1] for x in lines}}
    best = {}
    for c, d in sorted(dec.items()):
        if d[4] == 1 and d[0] != "review" and d[1] in tempo.SAFE and d[2] >= 0.72 and (d[3] not in best or d[2] > best[d[3]][1]):
            best[d[3]] = c, d[2]
    models, inliers = {}, {}
    for s in lex:
        rows = sorted((c, line) for line, (c, _) in best.items() if by_line[line][1] == s)
        xy = [(cues[c][2], by_line[line][3]) for c, line in rows]
        if len(rows) < 3:
            continue
        off = median(y - rate * x for x, y in xy)
        near = [k for k, (x, y) in enumerate(xy) if abs(y - off - rate * x) <= 750]
        if len(near) < 3:
            continue
        off = median(xy[k][1] - rate * xy[k][0] for k in near)
        near = [k for k, (x, y) in enumerate(xy) if abs(y - off - rate * x) <= 750]
        slopes = [(xy[b][1] - xy[a][1]) / (xy[b][0] - xy[a][0]) for a, b in itertools.combinations(near, 2) if xy[b][0] - xy[a][0] >= 3000 and xy[b][1] > xy[a][1]]
        slopes = [v for v in slopes if 0.5 <= v <= 2]
        if len(near) < 3 or len(near) / len(rows) < 0.75 or median(abs(xy[k][1] - off - rate * xy[k][0]) for k in near) > 300 or not slopes or abs(median(slopes) - rate) / rate > 0.025:
            continue
        if xy[near[-1]][0] - xy[near[0]][0] < 8000 or xy[near[-1]][1] - xy[near[0]][1] < 8000 or any(rows[a][1] >= rows[b][1] for a, b in itertools.pairwise(near)):
            continue
        models[s], inliers[s] = off, [rows[k] for k in near]
    mix = lambda s, ms: int(round((ms - models[s]) / rate))

    def overlap(a, b):
        return any(a[:n] == b[:n] or a[-n:] == b[-n:] for n in range(2, min(8, len(a), len(b)) + 1))

    def guarded(c, x):
        k, t = cues[c][4], x[4]
        if k and t and k != t:
            if t.startswith(k) and c + 1 < len(cues) and overlap(cues[c + 1][4], t[len(k) :]):
                return True
            if t.endswith(k) and c and overlap(cues[c - 1][4], t[: -len(k)]):
                return True
        rows = lex[x[1]]
        p = rows.index(x) if x in rows else None
        if p is None:
            return False
        head = p > 0 and any(k[:n] == rows[p - 1][4][-n:] for n in range(2, min(8, len(rows[p - 1][4]), len(k)) + 1))
        return head or (p + 1 < len(rows) and any(k[-n:] == rows[p + 1][4][:n] for n in range(2, min(8, len(rows[p + 1][4]), len(k)) + 1)))

    out = {c: tuple(d) for c, d in dec.items()}
    for c, d in dec.items():
        x = by_line.get(d[3]) if d[0] == "review" and d[4] == 1 else None
        if x is None or x[1] not in models or tempo.vocal(x[5]):
            continue
        s = x[1]
        if abs(cues[c][2] - mix(s, x[3])) > (220 if d[2] < 0.2 else 450):
            continue
        trims = tempo.trims(cues[c][5], x[5])
        if not trims:
            rows, inl = lex[s], inliers[s]
            p = rows.index(x)
            near = [dec[k] for k in (c - 1, c + 1) if k in dec and dec[k][4]]
            if tempo.vocal(cues[c][5]) or any(n[3] <= d[3] < n[3] + n[4] for n in near) or guarded(c, x):
                continue
            if p + 1 < len(rows) and mix(s, rows[p + 1][3]) < cues[c][3] - 300:
                continue
            left, right = any(a < c and b < d[3] for a, b in inl), any(a > c and b > d[3] for a, b in inl)
            if not right:
                continue
            if not left:
                a, b = inl[0]
                if c >= a or a - c > 2 or by_line[b] not in rows or not 1 <= rows.index(by_line[b]) - p <= 2:
                    continue
        out[c] = ("unchanged" if cues[c][4] == x[4] else "replace", tempo.TRIMMED if trims else tempo.MAPPED, min(d[2], 0.9), d[3], 1, x[5])
    step = dict(out)
    for s, inl in inliers.items():
        rows = lex[s]
        for (a, la), (b, lb) in itertools.pairwise(inl):
            block = list(range(a + 1, b))
            if not block or len(block) > 12 or by_line[la] not in rows or by_line[lb] not in rows:
                continue
            gap = rows[rows.index(by_line[la]) + 1 : rows.index(by_line[lb])]
            if not gap or not any(step[c][0] == "review" for c in block) or any(tempo.LATIN.search(x[5]) for x in gap) or any(step[c][0] == "review" and tempo.vocal(cues[c][5]) for c in block):
                continue
            if any(step[c][4] and any(by_line.get(k, (0, None))[1] != s for k in range(step[c][3], step[c][3] + step[c][4])) for c in block):
                continue
            now = [step[c][5] if step[c][0] != "review" and step[c][5] else cues[c][5] for c in block]
            size, whole = sum(len(repair.key(t)) for t in now), "".join(x[4] for x in gap)
            if not size or not whole or min(size, len(whole)) / max(size, len(whole)) < 0.45:
                continue
            early = mix(s, gap[0][3]) - cues[block[0]][2]
            if abs(mix(s, by_line[lb][3]) - cues[b][2]) > 750 or not -1600 <= early <= 900 or mix(s, gap[-1][3]) > cues[block[-1]][3] + 1200 or mix(s, gap[-1][3]) >= cues[b][2]:
                continue
            parts, doubt = repair.shared_out(now, repair.content("".join(x[5] for x in gap)))
            texts = [repair.rendered(x, p) for x, p in zip(now, parts, strict=True)]
            keys = [repair.key(t) for t in texts]
            if doubt or not all(keys) or "".join(keys) != whole or keys != [repair.key(p) for p in parts]:
                continue
            owner = [x[2] for x in gap for _ in x[4]]
            spans, at = [], 0
            for k in keys:
                spans.append((owner[at], owner[at + len(k) - 1] + 1))
                at += len(k)
            ok = True
            for c, k, t, (lo, hi) in zip(block, keys, now, spans, strict=True):
                d, like = step[c], pair(cues[c][4], k)
                if d[0] != "review":
                    ok = ok and repair.key(t) == k
                    continue
                ok = ok and not (len(cues[c][4]) <= 2 and like < 0.8)
                if not d[4]:
                    ok = ok and len(cues[c][4]) >= 4 and len(k) >= 4 and like >= 0.25
                else:
                    ok = ok and d[3] <= lo and hi <= d[3] + d[4]
                    ok = ok and not (d[4] == 1 and guarded(c, by_line[d[3]]) and k != repair.key(t))
            if ok:
                for c, k, t, (lo, hi) in zip(block, keys, texts, spans, strict=True):
                    if step[c][0] == "review":
                        out[c] = ("unchanged" if cues[c][4] == k else "replace", tempo.STREAM, min(step[c][2], 0.89), lo, hi - lo, t)
    return out


def test_recovery_at_known_rates_equals_a_plain_reading(spark):
    parts = [made(random.Random(t), t) for t in range(120)]
    cues, lines, decisions = (spark.createDataFrame([r for p in parts for r in p[k]], s) for k, s in enumerate((CUES, LINES, DECISIONS)))
    priors = spark.createDataFrame([(t, s, 1.1) for t in range(120) for s in range(2)], "task long, source int, rate double")
    want = {(t, c): v for t, p in enumerate(parts) for c, v in naive(*p, 1.1).items()}
    got = {(r.task, r.cue): (r.action, r.reason, r.score, r.line, r.n_lines, r.text) for r in tempo.tempo_recovered(cues, lines, decisions, priors).collect()}
    assert got == want
    kinds = Counter(v[1] for v in got.values())
    assert kinds[tempo.MAPPED] > 20 and kinds[tempo.TRIMMED] >= 5 and kinds[tempo.STREAM] > 10, kinds
    none = tempo.tempo_recovered(cues, lines, decisions, priors.limit(0)).collect()
    assert len(none) == len(got) and not {r.reason for r in none} & {tempo.MAPPED, tempo.STREAM}


def test_sounds_at_the_ends():
    assert tempo.vocal("哦耶") and tempo.vocal("Oh, yeah!") and not tempo.vocal("oh 天") and not tempo.vocal("") and not tempo.vocal("天")
    assert tempo.without_sounds("oh, yeah 天地 哦") == "天地" and tempo.trims("哦，天地", "天地") and not tempo.trims("天地", "天地") and not tempo.trims("哦天", "地")
    assert tempo.without_sounds("Hello world oh") == "Hello world" and tempo.without_sounds("hey") == "hey"


def test_query(spark):
    kinds = Counter(r.reason for r in recovery_q.i10_tempo_recovery(spark, "/root/testdata/sf0.001").collect())
    assert kinds[tempo.MAPPED] > 5
