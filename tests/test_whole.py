"""Queries over whole tables against brute force on small fixtures."""

from itertools import combinations

import numpy as np
import pandas as pd

from tidewright.operators import folds
from tidewright.plans import catalog

QUERIES = catalog.queries()


def put(folder, name, **columns):
    pd.DataFrame(columns).to_parquet(f"{folder}/{name}.parquet", coerce_timestamps="us", index=False)
    return str(folder)


def events(folder, users):
    """Some events of each user, of all types, in no order; the last user has a single one."""
    rng = np.random.default_rng(5)
    user = np.concatenate([np.repeat(users, 14), [users[-1] + 1]])
    n = len(user)
    ts = pd.to_datetime(rng.permutation(n) * 9_000_000_000 + 1_700_000_000_000_000, unit="us")
    kinds = np.array(["view", "click", "purchase", "signup", "error"])[np.arange(n) % 5]
    value = np.round(rng.gamma(2.0, 8.0, n), 2)
    return put(folder, "events", event_id=np.arange(n), ts=ts, user_id=user, event_type=kinds, value=value, props=["{}"] * n), pd.DataFrame({"event_id": np.arange(n), "t_us": ts.astype("datetime64[us]").astype("int64"), "user_id": user, "event_type": kinds, "value": value})


def test_timing_model_of_all_events(spark, tmp_path):
    d, e = events(tmp_path, [3, 99, 100, 4000])
    want = {}
    for user, t in e.groupby("user_id"):
        x, y = t.t_us.to_numpy() / 1e11, t.value.to_numpy()
        slopes = [(y[j] - y[i]) / (x[j] - x[i]) for i in range(len(x)) for j in range(len(x)) if x[j] - x[i] >= 0.3]
        if not slopes:
            want[user] = (len(x), None, "too_few")
            continue
        off = y - np.median(slopes) * x
        res = float(np.median(np.abs(off - np.median(off))))
        want[user] = (len(x), round(res, 4), "ready" if res <= 10 else "degraded" if res <= 20 else "rejected")
    got = {r.user_id: (r.n, None if r.residual is None else round(r.residual, 4), r.status) for r in QUERIES["i5_timing_model_all"](spark, d).collect()}
    assert got == want and len(want) == 5


def test_anchor_chains_of_all_pairs(spark, tmp_path):
    rng = np.random.default_rng(7)
    sources = ["src1", "src15", "src19", "src2", "web", None]
    rows = [(s, f"line {k}") for s in sources for k in rng.choice(12, 9)] + [("web", None), ("src1", None)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    d = put(tmp_path, "documents", doc_id=np.arange(len(rows)), source=[s for s, _ in rows], text=[t for _, t in rows])
    places = {}
    for s in sources[:-1]:
        own = [t for x, t in rows if x == s]
        alone = [t for t in own if own.count(t) == 1]
        places[s] = {t: i + 1 for i, t in enumerate(alone) if t is not None}
    longest = {}
    for a, b in combinations(sorted(places), 2):
        both = sorted((places[a][t], places[b][t]) for t in places[a].keys() & places[b].keys())
        best = max((n for n in range(len(both) + 1) if any(all(x[1] < y[1] for x, y in zip(c, c[1:], strict=False)) for c in combinations(both, n))), default=0)
        if best:
            longest[a, b] = best, set(both)
    got = {}
    for r in QUERIES["i1_anchor_chain"](spark, d).collect():
        got.setdefault((r.l, r.r), []).append((r.p, r.q))
    assert {k: len(v) for k, v in got.items()} == {k: n for k, (n, _) in longest.items()}
    assert any(a >= "src15" for a, _ in got)
    for k, v in got.items():
        assert set(v) <= longest[k][1] and [q for _, q in sorted(v)] == sorted({q for _, q in v})


def fitted(x, y):
    """The best line with up to two breaks, each tried alone."""
    best = None
    for n in range(3):
        found = None
        for breaks in combinations(np.unique(x)[3:-3] if len(x) > 6 else [], n):
            edges = [-np.inf, *breaks, np.inf]
            if all(((x >= a) & (x < b)).sum() >= 3 for a, b in zip(edges, edges[1:], strict=False)) or not n:
                m = np.column_stack([np.ones(len(x)), x, *[np.maximum(0, x - b) for b in breaks]])
                sol = np.linalg.lstsq(m, y, rcond=None)[0]
                err = np.abs(y - m @ sol).mean()
                if found is None or err < found[2]:
                    found = (n, sol[1], err)
        if best is None or (found and found[2] < 0.8 * best[2]):
            best = found or best
    return best


def test_hinges_against_brute_force():
    rng = np.random.default_rng(11)
    for n in (3, 7, 12, 25):
        for x in (np.arange(n, dtype=float), np.sort(rng.integers(0, n, n)).astype(float)):
            y = np.cumsum(rng.gamma(2.0, 8.0, n)) + 40 * np.maximum(0, x - n // 2)
            breaks, sol, err = folds.hinges(x, y)
            k, slope, want = fitted(x, y) or (0, sol[1], err)
            assert len(breaks) == k and abs(err - want) < 1e-8 and abs(sol[1] - slope) < 1e-6


def test_piecewise_line_of_all_events(spark, tmp_path):
    d, e = events(tmp_path, [3, 99, 4000])
    want = {}
    for user, t in e.sort_values("t_us").groupby("user_id"):
        k, slope, err = fitted(np.arange(len(t), dtype=float), np.cumsum(t.value.to_numpy())) or (0, 0, 0)
        want[user] = (k, round(slope, 4), round(err, 4))
    got = {r.user_id: (r.n_breaks, round(r.base_slope, 4), round(r.mean_error, 4)) for r in QUERIES["j7_piecewise"](spark, d).collect()}
    assert got.keys() == want.keys()
    assert all(got[u][0] == want[u][0] and np.allclose(got[u][1:], want[u][1:], atol=2e-4) for u in want)


def test_matchings_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    n, hour = 36, 3_600_000_000
    t = rng.permutation(n * 9)[:n] * (hour // 12) + 1_700_000_000_000_000
    kind, user = np.array(["view", "click", "purchase"])[rng.integers(0, 3, n)], np.arange(n) % 2
    d = put(tmp_path, "events", event_id=np.arange(n), ts=pd.to_datetime(t, unit="us"), user_id=user, event_type=kind, value=np.ones(n), props=["{}"] * n)
    want = {"c17_greedy_matching": set(), "c18_ordered_matching": set()}
    most = 0
    for u in (0, 1):
        a, b = ([i for i in np.argsort(t) if user[i] == u and kind[i] == k] for k in ("view", "click"))
        near = {i: [j for j in b if abs(t[i] - t[j]) <= hour] for i in a}
        used = set()
        for gap, i, j in sorted((abs(t[i] - t[j]), t[i], t[j]) for i in a for j in near[i]):
            if not {("l", i), ("r", j)} & used:
                used |= {("l", i), ("r", j)}
                want["c17_greedy_matching"].add((u, list(t).index(i), list(t).index(j)))
        used = set()
        for i in a:
            if free := [j for j in near[i] if j not in used]:
                used.add(j := min(free, key=lambda j: (abs(t[i] - t[j]), t[j])))
                want["c18_ordered_matching"].add((u, i, j))

        def largest(left, taken):
            return max([largest(left[1:], taken), *[1 + largest(left[1:], taken | {j}) for j in near[left[0]] if j not in taken]]) if left else 0

        most += largest(a, frozenset())
    for name, pairs in want.items():
        assert {(r.user_id, r.l_id, r.r_id) for r in QUERIES[name](spark, d).collect()} == pairs and pairs, name
    got = QUERIES["c19_maximum_matching"](spark, d).collect()
    assert len(got) == most == len({r.l_id for r in got}) == len({r.r_id for r in got})
    assert all(abs(t[r.l_id] - t[r.r_id]) <= hour and user[r.l_id] == user[r.r_id] and (kind[r.l_id], kind[r.r_id]) == ("view", "click") for r in got)
