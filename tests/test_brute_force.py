"""Queries that SQL can't express, each on a small table against a plain reading of its definition."""

import itertools
import re
from functools import lru_cache
from statistics import median

import numpy as np
import pandas as pd
import pytest

from tidewright.functions import text as tx
from tidewright.operators import folds
from tidewright.plans import catalog

QUERIES = catalog.queries()
G = np.random.default_rng(17)


def put(folder, name, **columns):
    pd.DataFrame(columns).to_parquet(f"{folder}/{name}.parquet", coerce_timestamps="us", index=False)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    words = ["sun", "sea", "over", "the", "blue", "é", "sky", "a", "night", "and", "day", "ßtill"]
    line = lambda n: " ".join(G.choice(words, n))
    turns = [(c, t, line(G.integers(0, 9)) + G.choice(["", "!", ",  yes\n", " - "])) for c in range(6) for t in range(5)]
    turns += [(9, 0, "same"), (9, 1, "same"), (9, 2, ""), (9, 3, ""), (9, 4, None), (9, 5, "x"), (10, 0, "alone")]
    put(d, "conversations", conv_id=[c for c, _, _ in turns], turn=[t for _, t, _ in turns], role="user", text=[x for _, _, x in turns])
    names = sorted({line(3) for _ in range(24)})
    put(d, "part", p_partkey=np.arange(len(names)), p_brand=[f"b{i % 4}" for i in range(len(names))], p_name=names)
    lines = [(o, n + 1, int(G.integers(0, len(names))), G.choice(["N", "R", "A"])) for o in range(12) for n in range(int(G.integers(1, 7)))]
    put(d, "lineitem", l_orderkey=[x[0] for x in lines], l_linenumber=[x[1] for x in lines], l_partkey=[x[2] for x in lines], l_returnflag=[x[3] for x in lines])
    n = 42
    user = np.array([1] * 9 + [2] * 14 + [3] * 6 + [4] * 12 + [5])
    put(d, "events", event_id=np.arange(n), ts=pd.to_datetime(G.permutation(n) * 17_000_000_000 + 1_700_000_000_000_000, unit="us"), user_id=user, event_type=G.choice(["view", "click"], n), value=np.round(G.gamma(2.0, 8.0, n), 2), props=["{}"] * n)
    v = G.standard_normal((160, 6))
    v[100:103] = v[50] + 0.01
    put(d, "embeddings", vec_id=np.arange(160), embedding=list((v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)))
    return str(d)


def read(tables, name):
    return pd.read_parquet(f"{tables}/{name}.parquet")


def users(tables):
    e = read(tables, "events")
    e["t_us"] = e.ts.astype("datetime64[us]").astype("int64")
    return {u: t.sort_values(["t_us", "event_id"]).reset_index(drop=True) for u, t in e.groupby("user_id")}


def matched(a, b):
    """Characters in the longest common block, the first in a and then in b, and in what is left and right of it."""
    best = max(((k, -i, -j) for i in range(len(a)) for j in range(len(b)) for k in [next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))] if k), default=None)
    if best is None:
        return 0
    k, i, j = best[0], -best[1], -best[2]
    return k + matched(a[:i], b[:j]) + matched(a[i + k :], b[j + k :])


def ratio(a, b):
    return 2 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


def pair(a, b):
    if a == b:
        return 1.0
    return ratio(a, b) * (0.85 + 0.15 * min(len(a), len(b)) / max(len(a), len(b))) if a and b else 0.0


def subsequence(a, b):
    @lru_cache(None)
    def n(i, j):
        return 0 if i == len(a) or j == len(b) else 1 + n(i + 1, j + 1) if a[i] == b[j] else max(n(i + 1, j), n(i, j + 1))

    return n(0, 0)


def support(a, b):
    if not a or not b:
        return 0.0
    n = subsequence(a, b)
    return max(ratio(a, b), 0.7 * n / len(a) + 0.3 * 2 * n / (len(a) + len(b)))


def contained(a, b):
    if not a or not b:
        return 0.0
    short, long = sorted((a, b), key=len)
    return max(ratio(a, b), 0.4 + 0.55 * len(short) / len(long) if short in long else 0)


def neighbours(tables):
    c = read(tables, "conversations").sort_values(["conv_id", "turn"])
    last = {}
    for r in c.itertuples():
        if last.get(r.conv_id) is not None:
            yield r.conv_id, r.turn, last[r.conv_id], r.text
        last[r.conv_id] = r.text


@pytest.mark.parametrize(("name", "score"), [("h4_pair_score", pair), ("h5_support_score", support), ("h6_contained_score", contained)])
def test_scores(spark, tables, name, score):
    got = {(r.conv_id, r.turn): r.score for r in QUERIES[name](spark, tables).collect()}
    want = {(c, t): None if b is None else round(score(a, b), 6) for c, t, a, b in neighbours(tables)}
    assert got.keys() == want.keys() and len(want) > 20
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 2e-6) for k in want)


def scripts(a, b):
    """All edit scripts from a to b, each as (op, from, to) rows."""
    if not a and not b:
        yield ()
    if a and b:
        for s in scripts(a[:-1], b[:-1]):
            yield (*s, ("equal" if a[-1] == b[-1] else "replace", a[-1], b[-1]))
    if b:
        for s in scripts(a, b[:-1]):
            yield (*s, ("insert", None, b[-1]))
    if a:
        for s in scripts(a[:-1], b):
            yield (*s, ("delete", a[-1], None))


def best_script(a, b):
    cost = lambda s: sum(x[0] != "equal" for x in s)
    return min(scripts(tuple(a), tuple(b)), key=lambda s: (cost(s), [("equal", "replace", "insert", "delete").index(x[0]) for x in reversed(s)]))


def test_edit_scripts_are_the_least_of_all():
    for _ in range(150):
        a, b = (list(G.choice(list("xyz"), G.integers(0, 5))) for _ in range(2))
        assert tuple(tx.script_of_edits(a, b)) == best_script(a, b)
        assert tx.ways(a, b)[0] == sum(x[0] != "equal" for x in best_script(a, b))


def test_edits_of_turns(spark, tables):
    @lru_cache(None)
    def distance(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(distance(a[1:], b[1:]) + (a[0] != b[0]), distance(a[1:], b) + 1, distance(a, b[1:]) + 1)

    pairs = {(c, t): (tuple(a.split()), tuple(b.split())) for c, t, a, b in neighbours(tables) if b is not None}
    got = {(r.conv_id, r.turn): r.distance for r in QUERIES["h7_token_distance"](spark, tables).collect() if r.distance is not None}
    assert got == {k: distance(*v) for k, v in pairs.items()}
    ops = {}
    for r in QUERIES["h8_edit_script"](spark, tables).collect():
        ops.setdefault((r.conv_id, r.turn), {})[r.op] = r.n
    for k, (a, b) in pairs.items():
        n = ops.get(k, {})
        assert sum(v for o, v in n.items() if o != "equal") == got[k]
        assert sum(v for o, v in n.items() if o != "insert") == len(a) and sum(v for o, v in n.items() if o != "delete") == len(b)


def test_layout(spark, tables):
    def laid(a, b):
        if b is None:
            return a
        new, out, at = re.findall(r"\w+", b), [], 0
        for piece in re.split(r"(\w+)", a):
            if re.fullmatch(r"\w+", piece):
                out.append(new[at] if at < len(new) else "")
                at += 1
            else:
                out.append(piece)
        last = len(out) - 1 if at else 0
        rest = " ".join(new[at:])
        if rest:
            out.insert(last, (" " if at else "") + rest)
        return "".join(out)

    got = {(r.conv_id, r.turn): r.text for r in QUERIES["h10_layout"](spark, tables).collect()}
    assert got == {(c, t): laid(a, b) for c, t, a, b in neighbours(tables)}


def test_spans_by_character():
    kinds = [(k, re.compile(f"[{v}]")) for k, v in tx.SCRIPTS]

    def naive(text, track):
        of = [next((k for k, p in kinds if p.match(c)), None) for c in text]
        if not any(of):
            return [(0, len(text), "unknown", "other")] if text else []
        said = [k and (tx.language_of(k, track), k) for k in of]
        for i in [*range(1, len(said))]:
            said[i] = said[i] or said[i - 1]
        for i in range(len(said) - 2, -1, -1):
            said[i] = said[i] or said[i + 1]
        out, at = [], 0
        for _, run in itertools.groupby(said, key=lambda x: x[0]):
            run = list(run)
            scripts = {s for _, s in run}
            out.append((at, at + len(run), run[0][0], scripts.pop() if len(scripts) == 1 else "mixed"))
            at += len(run)
        return out

    for _ in range(400):
        text = "".join(G.choice(list("aé서か日 !1漢ハ"), G.integers(0, 12)))
        for track in ("ja", "ko", "zh", "auto", "de", "mixed"):
            assert tx.spans(text, track) == naive(text, track), (text, track)
    assert tx.spans("君が好き baby", "jp") == [(0, 5, "ja", "mixed"), (5, 9, "en", "latin")]
    assert tx.spans("!!!", "en") == [(0, 3, "unknown", "other")] and tx.spans("日本語テスト", "ja") == [(0, 6, "ja", "mixed")]


def test_romanisation():
    for text, said in {"안녕": "annyeong", "밥 먹자!": "bapmeokja", "がっこう": "gakkou", "キャット": "kyatto", "しゃしん ぢゅ": "shashinjiyu", "コーヒー": "kohi", "Straße 7": "strasse7", "んっあ": "na", "ヴ": "vu"}.items():
        assert tx.romanised(text) == said, (text, tx.romanised(text))


def test_fuzzy_rank(spark, tables):
    p = read(tables, "part")
    got = {(r.p_brand, r.name): r for r in QUERIES["c20_fuzzy_rank"](spark, tables).collect()}
    for b, t in p.groupby("p_brand"):
        own = sorted({x.lower() for x in t.p_name})
        for x in own:
            ranked = sorted(((-round(pair(x, y), 6), y) for y in own if y != x))
            r = got.pop((b, x))
            margin = -ranked[0][0] + (ranked[1][0] if len(ranked) > 1 else 0)
            assert (r.other, round(r.score, 5), round(r.margin, 5)) == (ranked[0][1], round(-ranked[0][0], 5), round(margin, 5))
            assert r.accepted == (r.score >= 0.76 and r.margin >= 0.08)
    assert not got


def order_lines(tables):
    j = read(tables, "lineitem").merge(read(tables, "part").assign(line=lambda x: x.p_name.str.lower()), left_on="l_partkey", right_on="p_partkey")
    return {o: t.sort_values(["l_linenumber", "line"]) for o, t in j.groupby("l_orderkey")}


def test_line_sequences(spark, tables):
    got = {(r.l_orderkey, r.pos, r["place"]): (r.at, r.n, round(r.score, 5)) for r in QUERIES["c21_line_sequences"](spark, tables).collect()}
    want = {}
    for o, t in order_lines(tables).items():
        ls = t.line.tolist()
        for pos in range(2, len(ls) + 1):
            runs = [(-round(support(ls[pos - 1], "".join(ls[at - 1 : at - 1 + n])), 6), n, at) for n in (1, 2, 3) for at in range(1, pos - n + 1)]
            for k, (s, n, at) in enumerate(sorted(runs)[:2]):
                want[o, pos, k + 1] = (at, n, round(-s, 5))
    assert got == want and want


def test_span_alignment(spark, tables):
    rows = {}
    for r in QUERIES["i2_span_alignment"](spark, tables).collect():
        rows.setdefault(r.l_orderkey, []).append(r)
    for o, t in order_lines(tables).items():
        left, right = t[t.l_returnflag == "N"].line.tolist(), t[t.l_returnflag != "N"].line.tolist()

        @lru_cache(None)
        def least(i, j, left=tuple(left), right=tuple(right)):
            options = [0.48 + least(i + 1, j)] if i < len(left) else []
            options += [0.48 + least(i, j + 1)] if j < len(right) else []
            options += [1 - pair("".join(left[i:p]), "".join(right[j:q])) + 0.02 * (p - i + q - j - 2) + least(p, q) for p in range(i + 1, min(len(left), i + 4) + 1) for q in range(j + 1, min(len(right), j + 4) + 1)]
            return min(options, default=0.0)

        i = j = 0
        cost = 0.0
        for r in sorted(rows.get(o, []), key=lambda r: (r.l_start, r.r_start)):
            assert (r.l_start, r.r_start) == (i, j)
            i, j = r.l_end, r.r_end
            if r.kind == "match":
                s = pair("".join(left[r.l_start : i]), "".join(right[r.r_start : j]))
                assert abs(s - r.score) < 2e-6
                cost += 1 - s + 0.02 * (i - r.l_start + j - r.r_start - 2)
            else:
                cost += 0.48
        assert (i, j) == (len(left), len(right)) and abs(cost - least(0, 0)) < 1e-6


def test_interval_replacement(spark, tables):
    got = {}
    for r in QUERIES["c32_interval_replacement"](spark, tables).collect():
        got.setdefault(r.user_id, set()).add((r.line, round(r.start * 100), round(r.end * 100)))
    for u, t in users(tables).items():
        rows = [(i, set(range(i * 1000, i * 1000 + 800))) for i in range(len(t))]
        for i, v in enumerate(t.value):
            a = round((i * 10 + v % 5) * 100)
            new = set(range(a, a + 600))
            if any(min(x) < a and max(x) > a + 599 for _, x in rows):
                continue
            left = [(k, x - new) for k, x in rows if not (k == i and x & new)]
            rows = [(k, x) for k, x in left if len(x) >= 300] + [(i, new)]
        assert got[u] == {(k, min(x), max(x) + 1) for k, x in rows}


def test_weighted_line(spark, tables):
    got = {r.user_id: (r.intercept, r.slope) for r in QUERIES["d9_weighted_line"](spark, tables).collect()}
    for u, t in users(tables).items():
        y = np.cumsum(t.value.to_numpy())
        x, w = np.arange(len(y)), np.ones(len(y))
        for _ in range(5):
            m = [[sum(w), sum(w * x)], [sum(w * x), sum(w * x * x) + 1]]
            v = [sum(w * y), sum(w * x * y) + 20]
            det = m[0][0] * m[1][1] - m[0][1] * m[1][0]
            a, b = (v[0] * m[1][1] - m[0][1] * v[1]) / det, (m[0][0] * v[1] - m[1][0] * v[0]) / det
            w = 1 / np.maximum(1, abs(y - a - b * x))
        assert np.allclose(got[u], (a, b), atol=1e-4)


def test_left_out(spark, tables):
    got = {r.event_id: r.residual for r in QUERIES["e5_left_out"](spark, tables).collect()}
    for t in users(tables).values():
        points = list(zip(t.t_us / 1e11, t.value, strict=True))
        for k, (x, y) in enumerate(points):
            rest = points[:k] + points[k + 1 :]
            slopes = [(d - b) / (c - a) for a, b in rest for c, d in rest if c > a]
            r = got.pop(t.event_id[k])
            if not slopes:
                assert r is None or np.isnan(r)
                continue
            s = median(slopes)
            assert abs(r - (y - s * x - median(b - s * a for a, b in rest))) < 1e-4
    assert not got


def test_window_retrieval(spark, tables):
    e = read(tables, "embeddings")
    v = np.stack(e.embedding).astype(np.float64)
    got = {}
    for r in QUERIES["j3_window_retrieval"](spark, tables).collect():
        got.setdefault(r.query_id, {})[r["place"]] = (r.vec_id, round(r.score, 5), r.ambiguous)
    for q in range(0, 160, 50):
        s = (v @ v[q] + 1) / 2
        kept = []
        for i in sorted((i for i in range(160) if i != q and s[i] > 0.55), key=lambda i: (-s[i], i)):
            if all(abs(i - k) >= 5 for k in kept) and len(kept) < 3:
                kept.append(i)
        margin = s[kept[0]] - (s[kept[1]] if len(kept) > 1 else 0)
        assert got[q] == {n + 1: (i, round(s[i], 5), margin < 0.02) for n, i in enumerate(kept)}


def value_of(path, score, place):
    total, last = 0.0, -np.inf
    for c, s, p in zip(path, score, place, strict=True):
        if c is None:
            total -= 0.2
        elif p[c] < last:
            return -np.inf
        else:
            total += s[c] - (0 if last == -np.inf else 0.05 * abs(p[c] - last) / (1 + abs(p[c])))
            last = p[c]
    return total


def test_monotone_path(spark, tables):
    got = {}
    for r in QUERIES["j4_monotone_path"](spark, tables).collect():
        got.setdefault(r.user_id, {})[r.event_id] = r.choice
    seen = 0
    for u, t in users(tables).items():
        v = t.value.to_numpy()
        score, place = [np.array([0.6, 0.5, 0.4]) + (x % 1) / 2 for x in v], [np.array([i, i + x % 7, i - 2.0]) for i, x in enumerate(v)]
        path = [got[u][i] for i in t.event_id]
        if len(v) <= 6:
            seen += 1
            assert abs(value_of(path, score, place) - max(value_of(p, score, place) for p in itertools.product([None, 0, 1, 2], repeat=len(v)))) < 1e-9
        assert value_of(path, score, place) > -np.inf
    for _ in range(30):
        score, place = [G.random(2) for _ in range(6)], [G.integers(0, 5, 2).astype(float) for _ in range(6)]
        best = max(value_of(p, score, place) for p in itertools.product([None, 0, 1], repeat=6))
        assert abs(value_of(folds.monotone_path(score, place), score, place) - best) < 1e-9
    assert seen


def test_simplified(spark, tables):
    def knots(x, y):
        if len(x) < 3:
            return set()
        off = [abs(y[i] - (y[0] + (y[-1] - y[0]) * (x[i] - x[0]) / (x[-1] - x[0]))) for i in range(1, len(x) - 1)]
        k = off.index(max(off)) + 1
        return {x[k]} | knots(x[: k + 1], y[: k + 1]) | knots(x[k:], y[k:]) if max(off) > 25 else set()

    got = {(r.user_id, r.event_id) for r in QUERIES["j11_simplified"](spark, tables).collect()}
    for u, t in users(tables).items():
        x, y = (t.t_us / 1e9).tolist(), np.cumsum(t.value).tolist()
        want = knots(x, y) | {x[0], x[-1]}
        assert {i for v, i in got if v == u} == {i for i, a in zip(t.event_id, x, strict=True) if a in want}
