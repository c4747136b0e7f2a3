"""Many small groups at a time against one at a time."""

import random
from difflib import SequenceMatcher

import pyarrow as pa
import pytest

from tidewright.functions import matching
from tidewright.functions import text as tx
from tidewright.operators import evaluation, folds, lattices, repair, sequences

WORDS = "large hot blue old ring bolt plate gear widget rod".split()


def test_ratios_of_many_pairs():
    g = random.Random(1)
    for letters in ("ab", "abcdefgh ", "가나a", "".join(map(chr, range(0x4E00, 0x4E00 + 400))), "a\0b"):
        for longest in (9, 40, 300):
            pairs = [tuple("".join(g.choice(letters) for _ in range(g.randrange(longest))) for _ in "ab") for _ in range(3000 // longest)]
            assert matching.ratios(pairs) == [SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs]
    assert matching.ratios([]) == []


def cues(g, n):
    """Cues of neighbouring times; some are as long as others, overlap, or are empty."""
    text = lambda: " ".join(g.choice(WORDS).replace("e", g.choice("ea")) for _ in range(g.choice([0, 1, 2, 2, 3])))
    return [(a := 2000 * k + g.randrange(0, 3000, 250), a + g.randrange(0, 4000, 500), text()) for k in range(n)]


@pytest.mark.parametrize("alike", [1, 100])
def test_groups_of_cues_are_those_of_one_at_a_time(monkeypatch, alike):
    g = random.Random(2)
    monkeypatch.setattr(lattices, "ALIKE", alike)
    monkeypatch.setattr(lattices, "MOVES", 1 << 13)  # several times for a shape
    groups = []
    for _ in range(150):
        a, b = cues(g, g.randrange(0, 7)), cues(g, g.randrange(0, 6))
        b = [(s, e, t) for (s, e, _), (_, _, t) in zip(b, a, strict=False)] if g.random() < 0.5 else b
        groups.append((a, b))
    groups += [(cues(g, 13), cues(g, 20)), (cues(g, 2), [(0, 9, "x" * 300)]), (cues(g, 12), cues(g, 11)), ([(0.5, 1.25, "가 나")], [(0.75, 3.5, "가나")])]
    assert evaluation.group_alignments(groups) == [evaluation.group_alignment(*x) for x in groups]


def test_few_groups_of_cues_are_compared(monkeypatch):
    g = random.Random(3)
    groups = []
    for _ in range(400):
        ref = [(3000 * k, 3000 * k + 2500, f"{g.choice(WORDS)} {g.choice(WORDS)}") for k in range(4)]
        groups.append((ref, [(a + 200, b - 100, t.replace("e", "a")) for a, b, t in ref]))
    want = [evaluation.group_alignment(*x) for x in groups]
    pairs, slow = [], []
    real = matching.ratios
    monkeypatch.setattr(matching, "ratios", lambda p: pairs.extend(p) or real(p))
    monkeypatch.setattr(evaluation, "group_alignment", lambda *x: slow.append(x))
    assert evaluation.group_alignments(groups) == want
    assert len(pairs) <= 10 * 400 and not slow  # of 81 for each group


def test_blocks_hold_whole_groups(spark, monkeypatch):
    rows = [(k % 7 if k % 7 else None, -k, f"r{k}") for k in range(100)]
    df = spark.createDataFrame(rows, "key int, at int, name string")

    def run(starts, at, name):
        assert starts[0] == 0 and starts[-1] == len(at) == len(name)
        spans = list(zip(starts, starts[1:], strict=False))
        number = [g for g, (a, b) in enumerate(spans) for _ in range(2)]
        return [starts[g] for g in number], [[spans[g][1] - spans[g][0] for g in number], [",".join(name[slice(*spans[g])]) for g in number]]

    want = sorted(((k, len(v), ",".join(v)) for k in {r[0] for r in rows} if (v := [n for _, n in sorted((a, n) for key, a, n in rows if key == k)])), key=str)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        for block in (1, 10, 1 << 16):
            monkeypatch.setattr(folds, "BLOCK", block)
            got = sorted(map(tuple, folds.by_blocks(df, ["key"], ["at"], ["at", "name"], run, "n int, names string").collect()), key=str)
            assert got == [x for x in want for _ in range(2)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert folds.by_blocks(df.where("key < 0"), ["key"], ["at"], ["at", "name"], run, "n int, names string").count() == 0


def lines(g, n):
    return [" ".join(g.choice(WORDS) for _ in range(g.choice([1, 2, 2, 3])))[: g.choice([1, 9, 30, 30])] * g.choice([0, 1, 1, 1, 1, 1]) for _ in range(n)]


def misheard(g, rows):
    out = []
    for x in rows:
        x = g.choice([x, x, x.replace("e", "a"), x + "!", x[::-1], x.upper()])
        out += g.choice([[x], [x], [x], [], [x, x], [x[: len(x) // 2], x[len(x) // 2 :]]])
    return out


@pytest.mark.parametrize("alike", [1, 100])
def test_repairs_are_those_of_one_group_at_a_time(monkeypatch, alike):
    g = random.Random(4)
    monkeypatch.setattr(lattices, "ALIKE", alike)
    monkeypatch.setattr(lattices, "MOVES", 1 << 14)
    groups = []
    for n in [*range(8)] * 25 + [9, 11, 14, 16]:
        rows = lines(g, n)
        groups.append((misheard(g, rows), rows))
    # Lines in another place, so that the best path leaves the first band.
    groups += [(lines(g, 12), lines(g, 3)), ([], lines(g, 2)), (lines(g, 2), []), ((rows := lines(g, 13))[10:] + ["q" * 50], rows), (["z" * 70], ["z" * 71])]
    keys = [([repair.key(x) for x in a], [repair.key(x) for x in b]) for a, b in groups]
    assert repair.alignments(keys) == [folds.span_alignment(a, b, tx.pair, bound=tx.pair_bound) for a, b in keys]
    assert repair.decisions(groups) == [repair.decided(*x) for x in groups]


def test_paths_beside_the_band_are_sought_again(monkeypatch):
    g = random.Random(5)
    again = []
    real = folds.span_alignment
    monkeypatch.setattr(folds, "span_alignment", lambda *x: again.append(x) or real(*x))
    rows = ["".join(g.choice("abcdefghij") for _ in range(9)) for _ in range(24)]
    fours = ["".join(rows[k : k + 4]) for k in range(0, 24, 4)]
    groups = [(fours[:3] + rows[12:], rows[:12] + fours[3:])]
    assert repair.alignments(groups) == [real(*groups[0], tx.pair, bound=tx.pair_bound)] and again


def test_few_runs_of_lines_are_compared(monkeypatch):
    g = random.Random(6)
    groups = [((rows := [f"{g.choice(WORDS)} {g.choice(WORDS)} {k}" for k in range(4)]), [x.replace("e", "a") for x in rows]) for _ in range(400)]
    want = [repair.decided(*x) for x in groups]
    pairs, slow = [], []
    real = matching.ratios
    monkeypatch.setattr(matching, "ratios", lambda p: pairs.extend(p) or real(p))
    monkeypatch.setattr(folds, "span_alignment", lambda *x: slow.append(x))
    assert repair.decisions(groups) == want
    assert len(pairs) <= 25 * 400 and not slow  # of 100 for each group, and rivals


def test_turns_over_many_keys_are_those_of_one_pair_at_a_time(spark, monkeypatch):
    """Keys in one pass against keys over a table, where each pair is compared by itself."""
    g = random.Random(7)
    words = [*WORDS, "don't", "Sun", "o'clock-tower", "a1", "사랑", "x"]
    rows = []
    for song in range(40):
        n = g.randrange(1, 8)
        seen = [" ".join(g.choice(words) for _ in range(g.randrange(1, 5))) for _ in range(n)]
        units, cuts = " ".join(seen).split(), [0]
        for x in seen[:-1]:
            cuts.append(max(cuts[-1], cuts[-1] + len(x.split()) + g.choice([0, 0, 0, 1, -1])))
        for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(units)], strict=True)):
            again = g.choice([None, "", " " + seen[i] + " ", seen[i][::-1]])
            rows.append((song, i + (i > 4), 3000 * i, g.choice([3000 * i + 2500] * 3 + [3000 * i + 1000, None]), g.choice([" ".join(units[a:b])] * 9 + [None]), seen[i].replace("e", g.choice("ea")), again, g.choice([0.9, 0.1, None]), g.choice([False] * 6 + [True, None])))
    df = spark.createDataFrame(rows, "song long, cue int, start_ms long, end_ms long, text string, seen string, again string, sure double, fixed boolean")
    at_once = sorted(map(str, sequences.resegmented(df, "song").collect()))
    monkeypatch.setattr(sequences, "WHOLE", 0)
    over_a_table = sorted(map(str, sequences.resegmented(df, "song").collect()))
    assert len(at_once) == len(rows) and sum("moved=0" not in x for x in at_once) > 15
    assert [x.replace("text=None", "text=''") for x in at_once] == [x.replace("text=None", "text=''") for x in over_a_table]


def test_cuts_are_those_of_one_pair_at_a_time(monkeypatch):
    g = random.Random(8)
    words = [*WORDS, "don't", "a1", "사랑", "x", "-", ""]
    asked = []
    for _ in range(1500):
        whole = [g.choice(words) for _ in range(g.randrange(0, 9))]
        a, b = (g.randrange(len(whole) + 1) for _ in "ab")
        heard = lambda x: " ".join(x).replace("e", g.choice("ea"))
        asked.append((" ".join(whole[:a]), " ".join(whole[a:]), heard(whole[:b]), heard(whole[b:])))
    want = [sequences.resplit(*x) for x in asked]
    rows = [(a, b, g.choice([0.9, 0.6, 0.1, None]), c) for a, b, c, _ in asked[:500]] + [(None, "x", 0.9, None), (None, None, None, "x"), ("사랑", "a", 0.9, "사랑 a")]
    assert sequences.preferences(rows) == [sequences.preferred({"c_seen": a, "c_again": b, "c_sure": s, "c_text": t or ""}, "c") for a, b, s, t in rows]
    pairs, slow = [], []
    ratios, one = matching.ratios, sequences.resplit
    monkeypatch.setattr(matching, "ratios", lambda p: pairs.extend(p) or ratios(p))
    monkeypatch.setattr(sequences, "resplit", lambda *x: slow.append(x) or one(*x))
    assert sequences.resplits(asked) == want and sum(x is not None for x in want) > 100
    assert all(not "".join(x[:2]).isascii() for x in slow) and len(pairs) < 8 * len(asked)


def test_lists_are_those_of_arrow():
    for values, kind in (([1, None, 2**62 + 1], pa.int64()), ([True, None], pa.bool_()), (["a", None, "", "a", "가"], pa.string()), ([0.1, None], pa.float64()), ([0.1, None], pa.float32()), ([], pa.string())):
        c = pa.chunked_array([pa.array(values, kind), pa.array(values[:1], kind)], kind)
        assert list(map(repr, folds.listed(c))) == list(map(repr, c.to_pylist()))
