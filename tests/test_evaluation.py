"""Cut metrics, cue groups and collapsed rows against plain versions."""

import itertools
import random
from difflib import SequenceMatcher
from statistics import fmean

from tidewright.operators import evaluation
from tidewright.plans import evaluation_q


def test_cut_metrics_equal_a_plain_reading(spark):
    g = random.Random(5)
    cases = [(c, g.choice(["en", "ko", "", None]), g.random() < 0.8, g.random() < 0.3, g.choice([200.0, 500.0])) for c in range(30)]
    cuts = [(c[0], g.random() < 0.5, float(g.randint(0, 6000))) for c in cases for _ in range(g.randint(0, 9))]
    errors, timed, legacy = {}, {}, {}
    for c, lang, t, leg, tol in cases:
        for s in ("overall", f"language:{lang or 'unknown'}"):
            errors.setdefault(s, [])
            timed[s] = timed.get(s, 0) + t
            legacy[s] = legacy.get(s, 0) + (leg and not t)
        if not t:
            continue
        a, b = ([x[2] for x in cuts if x[0] == c and x[1] is side] for side in (True, False))
        used: set = set()
        for e, i, j in sorted((abs(x - y), i, j) for i, x in enumerate(sorted(a)) for j, y in enumerate(sorted(b)) if abs(x - y) <= tol):
            if not {("a", i), ("b", j)} & used:
                used |= {("a", i), ("b", j)}
                for s in ("overall", f"language:{lang or 'unknown'}"):
                    errors[s].append(e)

    def at(v, q):
        v, p = sorted(v), (len(v) - 1) * q
        return v[int(p)] + (p - int(p)) * (v[min(int(p) + 1, len(v) - 1)] - v[int(p)]) if v else 0.0

    df = spark.createDataFrame(cases, "case long, language string, timed boolean, legacy boolean, tolerance_ms double")
    found = evaluation.cut_errors(spark.createDataFrame(cuts, "case long, expected boolean, at_ms double"), df.where("timed"))
    got = {r.scope: r for r in evaluation.cut_metrics(df, found).collect()}
    assert got.keys() == errors.keys()
    for s, v in errors.items():
        r = got[s]
        assert (r.n_matched, r.timed_cases, r.legacy_cases) == (len(v), timed[s], legacy[s])
        want = [fmean(v) if v else 0.0, at(v, 0.5), at(v, 0.9), at(v, 0.95), *(sum(x <= k for x in v) / len(v) if v else 0.0 for k in (250, 500))]
        assert all(abs(x - y) < 1e-3 for x, y in zip(want, (r.mae_ms, r.p50_ms, r.p90_ms, r.p95_ms, r.within_250, r.within_500), strict=True))


def test_groups_cost_as_little_as_any():
    g = random.Random(6)

    def price(a, b):
        x, y = (" ".join(r[2] for r in s) for s in (a, b))
        lo, hi = (min(r[0] for r in a), min(r[0] for r in b)), (max(r[1] for r in a), max(r[1] for r in b))
        over, hull = max(0, min(hi) - max(lo)), max(hi) - min(lo)
        return 1.55 * (1 - SequenceMatcher(None, x, y, autojunk=False).ratio()) + 0.35 * (1 - over / hull) + 0.08 * (len(a) + len(b) - 2)

    def least(a, b):
        if not a and not b:
            return 0.0
        options = [1 + least(a[1:], b)] if a else []
        options += [1 + least(a, b[1:])] if b else []
        options += [price(a[:k], b[:h]) + least(a[k:], b[h:]) for k, h in itertools.product(range(1, min(3, len(a)) + 1), range(1, min(3, len(b)) + 1))]
        return min(options)

    for _ in range(40):
        a, b = ([(s := 2000 * i + g.randint(0, 900), s + g.randint(1, 2500), " ".join(g.choice(["sun", "sea", "rain", "x"]) for _ in range(g.randint(1, 3)))) for i in range(g.randint(0, 4))] for _ in range(2))
        got = evaluation.group_alignment(a, b)
        total = sum(price(a[i:i2], b[j:j2]) for i, i2, j, j2 in got) + len(a) + len(b) - sum(i2 - i + j2 - j for i, i2, j, j2 in got)
        assert abs(total - least(a, b)) < 1e-9
        assert all(x[1] <= y[0] and x[3] <= y[2] for x, y in itertools.pairwise(got))


def test_collapsed_rows(spark):
    rows = [(1, 0, "a", "keep_existing", 0, 1000, "the sun", "x", 1), (1, 1, "a", "mapped", 1500, 2000, "q", "the sun is over", 2), (1, 2, "a", "keep_existing", 2100, 2500, "the sea", "the sea", 1), (1, 3, "b", "mapped", 2600, 3000, "r", "the sea", 2), (2, 0, "a", "keep_existing", 0, 1000, "zzz", "x", 1), (2, 1, "a", "mapped", 1500, 2000, "q", "the sun", 2), (3, 0, "a", "keep_existing", 0, 100, None, "x", 1), (3, 2, "a", "mapped", 200, 900, "q", "the", 2)]
    df = spark.createDataFrame(rows, "f long, cue int, track string, status string, start_ms long, end_ms long, original string, text string, n_lines int")
    assert [tuple(r) for r in evaluation.collapsed_after_unmapped(df, "f").collect()] == [(1, 0, 1)]


def test_queries(spark):
    d = "/root/testdata/sf0.001"
    assert evaluation_q.d5_cut_metrics(spark, d).where("n_matched > 10").count() > 2
    assert evaluation_q.i17_cue_groups(spark, d).where("ref_to - ref_from > 1").count() > 100
    assert evaluation_q.e20_collapsed_rows(spark, d).count() > 10
