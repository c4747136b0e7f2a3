"""Alignment against the libraries token by token, counts over the whole corpus, and odd texts."""

import collections
import hashlib
import random

import public_tokenizers
import pytest

from tidewright.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def by_hand(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=B)
    char = {c: i for i, c in enumerate(align.byte_chars())}
    found, counts = [], collections.Counter()
    for _, text in rows:
        whole = b" " + (text or "").encode()
        a = t.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = s.encode(text) if text else []
        bytes_a = [bytes(char[c] for c in t.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            a, b, bytes_a, bytes_b = [], [], [], []
        ends = []
        for parts in (bytes_a, bytes_b):
            n, e = 0, []
            for p in parts:
                n += len(p)
                e.append(n)
            ends.append(e)
        links = [(x, y) for x, e in zip(a, ends[0], strict=True) for y, f in zip(b, ends[1], strict=True) if e == f] if len(a) < 3000 else [(x, b[{f: j for j, f in enumerate(ends[1])}[e]]) for x, e in zip(a, ends[0], strict=True) if e in set(ends[1])]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        counts.update(links)
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
    highest = collections.Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for (i, _), (n_a, n_b, n_groups, links, groups) in zip(rows, found, strict=True):
        sha = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
        out.append((i, n_a, n_b, n_groups, len(links), sha, sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links)))
    return sorted(out, key=str)


def rows_of():
    g = random.Random(8)
    parts = ["the", "Straße", "naïve", "한국어", "日本", "12½", "don't", "<|endoftext|>", "<s>", "▁", "\U0001f600", "xqzj", "\t", "\n\n", "  ", "é", "́", "<0x41>"]
    rows = [(i, g.choice(["", " "]) + g.choice(["", " "]).join(g.choice(parts) for _ in range(g.randint(1, 40)))) for i in range(150)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(7, rows[7][1]), (None, "null id"), (900, None), (901, ""), (902, " "), (903, "a"), (904, "ab " * 2000), (905, "ﬁ ligature"), (906, "a▁b")]
    return rows


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 24, 1 << 16), (300, 900, 25)])
def test_equals_the_libraries(spark, monkeypatch, sizes):
    rows = rows_of()
    docs = spark.createDataFrame([(i, t, "c", 1, b"c") for i, t in rows], "doc_id long, text string, id string, n int, docs binary").repartition(2)
    if sizes[0] < 1 << 20:  # many slices and blocks in a worker of its own: the sizes travel as closures
        for name, x in zip(("SLICE_BYTES", "BLOCK_BYTES", "BLOCK_DOCS"), sizes, strict=True):
            monkeypatch.setattr(align, name, x)
        made = align.made(A, B)
        import pyarrow as pa
        from pyspark import TaskContext

        class Zero:
            def partitionId(self):
                return 0

        monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: Zero()))
        batch = pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] or "" for r in rows])], ["id", "text"])
        out = pa.Table.from_batches(list(made(iter([batch]))))
        monkeypatch.undo()
        blocks = set(out["block"].to_pylist())
        assert len(blocks) > 5 and sum(k == 0 for k in out["kind"].to_pylist()) == len(rows)
        table = spark.createDataFrame([tuple(r.values()) for r in out.to_pylist()], align.MADE)
        monkeypatch.setattr(align, "written", lambda s, df, tag: table if tag == "postings" else df)
    got = sorted(map(tuple, align.align(spark, docs, A, B).collect()), key=str)
    assert got == by_hand(rows)
    if sizes[0] == 1 << 20:
        assert align.align(spark, docs.limit(0), A, B).count() == 0


def test_byte_level_ids_equal_the_library_on_every_character():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    texts = ["".join(f"a{chr(c)}1 {chr(c)}{chr(c)} {chr(c)}2" for c in range(b, b + 512) if not 0xD800 <= c < 0xE000) for b in range(0, 0x110000, 512)]
    texts = [x for x in texts if x] + ["<|endoftext|>", "a" * 5000, " " * 3000 + "a", "9" * 3000]
    for text, ids in zip(texts, align.side(A).encode(texts), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


def test_high_multiplicities_take_several_entries():
    import numpy as np
    import pyarrow as pa

    pair, doc, times = np.array([5, 5, 9]), np.array([1, 0, 0]), np.array([600, 255, 1])
    rows = pa.Table.from_batches(align.postings(3, pair, doc, times)).to_pylist()
    assert [(r["pair"], r["n"], np.frombuffer(r["docs"], "<u2").tolist(), list(r["times"])) for r in rows] == [(5, 855, [0, 1, 1, 1], [255, 255, 255, 90]), (9, 1, [0], [1])]
