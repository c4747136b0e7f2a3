"""Editor evidence, roles and trust against plain readings of their rules."""

import random
import re
from collections import Counter

from tidewright.operators import evidence


def naive_support(want, got):
    if not want or not got:
        return 0.0
    from difflib import SequenceMatcher

    row = [0] * (len(got) + 1)
    for x in want:
        new = [0]
        for j, y in enumerate(got, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    n = row[-1]
    p, q = n / len(want), n / len(got)
    return max(SequenceMatcher(None, want, got, autojunk=False).ratio(), 0.7 * p + 0.3 * (2 * p * q / (p + q) if n else 0))


def test_support_weighs_runs_by_letters():
    assert evidence.support("the sun", "en", "the sun") == (1.0, None, 1.0, 0.85, 0.75)
    direct, phonetic, text, tw, mw = evidence.support("사랑 love", "ko", "sarang luv")
    d, p = naive_support("love", "sarangluv"), naive_support("sarang", "sarangluv")
    assert abs(direct - d) < 1e-12 and abs(phonetic - p) < 1e-12
    assert abs(text - (d * 0.85 * 4 + p * 0.1 * 2) / (0.85 * 4 + 0.1 * 2)) < 1e-12 and abs(tw - (0.85 * 4 + 0.1 * 2) / 6) < 1e-12 and abs(mw - (0.75 * 4 + 0.3 * 2) / 6) < 1e-12
    assert evidence.support("漢字", "ja", "kanji")[:3] == (None, None, None)  # no reading is made up
    assert evidence.support("", "en", "x") == (None, None, None, 0.0, 0.0)
    assert evidence.support("bonjour", "fr", "bonjour")[2] is None


def test_best_cues_against_all_pairs(spark):
    g = random.Random(3)
    texts = ["the sun is over", "사랑 노래 love", "bonjour", "", "and night", None]
    lines = [(t, i, 3000 * i + g.randint(0, 900), g.choice([None, 3000 * i + g.randint(-50, 4000)]), g.choice(texts), g.choice(["en", "ko", "fr"])) for t in range(5) for i in range(12)]
    cues = [(t, i, (a := g.randint(0, 40_000)), a + g.randint(1, 4000), g.choice(texts)) for t in range(5) for i in range(g.randint(0, 16))]
    got = {}
    df = evidence.editor_evidence(spark.createDataFrame(lines, "track long, line int, start_ms long, end_ms long, text string, language string"), spark.createDataFrame(cues, "track long, cue int, start_ms long, end_ms long, text string"))
    for r in df.collect():
        got.setdefault((r.track, r.line), {})[r.rank] = r
    assert len(got) == len(lines)
    for t, i, a, b, text, language in lines:
        b = a + 1 if b is None or b <= a else b
        found = []
        for u, c, p, q, said in cues:
            if u != t or max(p - b, a - q) > 2500:
                continue
            over, hull = max(0, min(b, q) - max(a, p)), max(b, q) - min(a, p)
            timing = min(1.0, max(over / hull, 0.8 * max(0.0, 1 - abs((a + b) / 2 - (p + q) / 2) / 2500)))
            d, f, x, tw, mw = evidence.support(text or "", language, said or "")
            top, under = timing * mw, mw
            if x is not None and tw > 0:
                top, under = top + x * tw, under + tw
            found.append((round(top / under if under else timing, 6), round(timing, 6), -c, p - a, q - b))
        found.sort(reverse=True)
        rows = got[t, i]
        if not found:
            assert list(rows) == [None] and rows[None].n_near == 0
            continue
        assert sorted(rows) == list(range(1, min(3, len(found)) + 1)) and rows[1].n_near == len(found)
        for k, r in rows.items():
            s, m, c, on, off = found[k - 1]
            assert abs(r.score - s) < 2e-6 and abs(r.timing - m) < 2e-6
            if all(abs(s - o[0]) > 5e-6 for n, o in enumerate(found) if n != k - 1):
                assert (r.cue, r.onset_ms, r.offset_ms) == (-c, on, off)
        assert abs(rows[1].margin - (found[0][0] - (found[1][0] if len(found) > 1 else 0))) < 5e-6


def naive_roles(rows):
    name = "[㐀-鿿]{2,6}"
    rows = sorted(((ms is None, ms or 0, k, re.sub(r"\s+", " ", t).strip(), meta) for k, ms, t, meta in rows if t and t.strip()), key=lambda r: r[:3])
    explicit = set()
    for *_, t, _ in rows:
        m = re.match(r"^([㐀-鿿A-Za-z0-9._+\-]{1,20}(?:[/、&+][㐀-鿿A-Za-z0-9._+\-]{1,20})+)(?:\s*[（(](?:(?i:Rap)|说唱|主唱|和声|合唱|独白)[）)])?\s*[:：]$", t)
        explicit |= {x for x in re.split("[/、&+]", m[1]) if re.fullmatch(name, x)} if m else set()
    bare = [(m[1] if (m := re.match(rf"^({name})\s*[:：]$", r[3])) else None) for r in rows]
    out = {(x, "explicit") for x in explicit}
    if len({b for b in bare if b in explicit}) >= 4:
        total, good = Counter(), Counter()
        for i, b in enumerate(bare):
            if b is None or b in explicit:
                continue
            total[b] += 1
            if not rows[i][0] and i + 1 < len(rows) and not rows[i + 1][0] and 0 < rows[i + 1][1] - rows[i][1] <= 2000 and bare[i + 1] is None and not rows[i + 1][4]:
                good[b] += 1
        out |= {(x, "inferred") for x, n in total.items() if n >= 2 and good[x] == n}
    return out


def test_roles_equal_a_plain_reading(spark):
    g = random.Random(4)
    names = ["天地", "日月", "山水", "火木", "金土", "云雨", "风花"]
    songs, entries = {}, []
    for t in range(60):
        rows, ms = [], 0
        for k in range(g.randint(0, 60)):
            ms += g.choice([500, 1500, 1500, 1500, 3000])
            n = g.choice(names)
            if g.random() < 0.4:
                text = n + g.choice(["：", ":", " :"])
            elif g.random() < 0.25:
                text = f"{g.choice(names[:5])}{g.choice('/、&+')}{g.choice(names[:5])}{g.choice(['', '（Rap）', '(rap)', ' (合唱)'])}："
            else:
                text = g.choice(["sung text", "唱 的 词", " ", None, "credit", n])
            if t % 2 and text in (names[5] + "：", names[6] + ":"):  # always before sung text
                rows.append((1000 + k, ms - 100, text, False))
                text = "sung text"
            elif t % 2 and text and text.startswith(tuple(names[5:])):
                text = "sung"
            rows.append((k, g.choice([ms, ms, ms, ms, None]) if t % 2 == 0 and g.random() < 0.2 else ms, text, text == "credit"))
        songs[t] = rows
        entries += [(t, *r) for r in rows]
    df = spark.createDataFrame(entries, "song long, ord int, at_ms long, text string, meta boolean").repartition(3)
    got = {}
    for r in evidence.role_names(df).collect():
        got.setdefault(r.song, set()).add((r.name, r.proof))
    assert got == {t: x for t, rows in songs.items() if (x := naive_roles(rows))}
    assert sum(p == "inferred" for x in got.values() for _, p in x) > 3


def test_trust_ladder(spark):
    lines = spark.createDataFrame([(1, c, "ko" if c == 4 else "en", "CONFLICT" if c == 5 else "HIGH") for c in (1, 2, 2, 4, 5, 6, 7, 8)], "task long, cue long, language string, level string")
    decided = [(1, c, "a", 1, "language:zz" if c == 6 else "language:en", s, "r") for c, s in ((1, "trusted"), (2, "trusted"), (3, "untrusted"), (4, "trusted"), (5, "trusted"), (6, "trusted"), (7, "odd"), (8, "trusted"), (8, "untrusted"))]
    decisions = spark.createDataFrame(decided, "task long, cue long, candidate string, revision int, scope string, status string, reason string")
    scopes = spark.createDataFrame([("a", 1, "language:en")], "candidate string, revision int, scope string")
    human = spark.createDataFrame([(1, 3, "trusted", "heard"), (1, 99, "untrusted", "heard")], "task long, cue long, status string, reason string")
    got = {r.cue: (r.status, r.reason.split("_")[0], r.source.split("_")[0]) for r in evidence.trusted(decisions, lines, scopes, human).collect()}
    assert got == {
        1: ("trusted", "r", "calibrated"), 2: ("unknown", "ambiguous", "calibrated"), 3: ("trusted", "heard", "human"), 4: ("invalid", "scope", "calibrated"), 5: ("unknown", "p9", "calibrated"),
        6: ("invalid", "scope", "calibrated"), 7: ("invalid", "unknown", "calibrated"), 8: ("invalid", "duplicate", "calibrated"), 99: ("untrusted", "heard", "human"),
    }
    none = evidence.trusted(decisions, lines, scopes.limit(0))
    assert {r.status for r in none.where("cue = 1").collect()} == {"unknown"}


def test_scopes_need_both_splits_isolated_and_locked(spark):
    sel = spark.createDataFrame([(c, 1, "d", "t1", "t2") for c in "abcde"], "candidate string, revision int, dataset string, calibration_truth string, blind_truth string")
    ev = [(c, 1, s, "d", "t1" if s == "calibration" else "t2", True) for c in "abcde" for s in ("calibration", "blind")]
    ev[2] = ("b", 1, "calibration", "d", "t1", False)
    ev[5] = ("c", 1, "blind", "d", "other", True)
    ev[7] = ("d", 2, "blind", "d", "t2", True)
    ev = spark.createDataFrame(ev, "candidate string, revision int, split string, dataset string, truth string, isolated boolean")
    metrics = spark.createDataFrame([(c, s, k, "m", 0.5, 0.4 if c == "e" and s == "calibration" else 0.5) for c in "abcde" for s in ("calibration", "blind") for k in ("overall", "language:en", "language:")], "candidate string, split string, scope string, metric string, baseline double, value double")
    gates = metrics.selectExpr("candidate", "split", "scope", "metric", "'regression' AS kind", "0.0 AS bound")
    assert [tuple(r) for r in evidence.eligible_scopes(sel, ev, evidence.gate_results(metrics, gates)).collect()] == [("a", 1, "language:en")]
    kinds = spark.createDataFrame([("a", "blind", "overall", "m", k, b) for k, b in (("floor", 0.5), ("floor", 0.6), ("ceiling", 0.5), ("ceiling", 0.4), ("improvement", 0.0), ("improvement", 0.1), ("regression", 0.0))] + [("a", "blind", "overall", "gone", "floor", 0.0)], "candidate string, split string, scope string, metric string, kind string, bound double")
    assert sorted((r.metric, r.kind, r.passed) for r in evidence.gate_results(metrics, kinds).collect()) == sorted([("m", k, p) for k, p in (("floor", True), ("floor", False), ("ceiling", True), ("ceiling", False), ("improvement", True), ("improvement", False), ("regression", True))] + [("gone", "floor", False)])
