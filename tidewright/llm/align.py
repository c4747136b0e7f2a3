"""Alignment of two tokenizers' ids by postings that are shuffled by side id.

Both tokenizers encode every text. A token of the one and a token of the other are linked where they end at the same byte; these bytes cut
both sequences into groups. How often a pair of ids is linked in the whole corpus is its count.

Documents are encoded in blocks of one task's input (BLOCK_BYTES of text or BLOCK_DOCS at most). A block's postings are, for each pair of
ids, the documents that have it and how often. The postings are shuffled by side id: by the id of the second tokenizer, whose postings are dealt further
by the id of the first, so a frequent id isn't one task's. In each task Spark's spillable sort streams them pair by pair; the pair's count is
summed there, compared with the highest one of its second id, and sent with the postings as contributions to their documents. Contributions
meet their block's documents and are summed by document.

Scale: a block has one row for a pair, so a pair never has more rows than there are blocks. The highest counts are one row for
an id of the second vocabulary, which bounds their broadcast (checked). Documents that aren't aligned have no postings.

Defined results: null and empty texts, and texts that the tokenizers don't give back byte by byte, have no tokens and an empty groups_sha256;
repeated rows are documents of their own and count each; a null id is kept; an empty table gives an empty result; extra
columns don't matter (only id and text are read).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.bpe import byte_chars
from tidewright.llm.common import written

SLICE_BYTES, BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 1 << 24, 1 << 16
#: How the byte-level tokenizer cuts texts before merging (a fixed value of its family).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Side:
    """One tokenizer: texts to ids, and each id's bytes."""

    def __init__(self, path: str):
        self.prefix, special = "", {}
        if path.endswith(".json"):  # byte-level BPE; ids rise in order of merges
            with open(path, encoding="utf-8") as f:
                found = json.load(f)
            special = {x["id"]: x["content"] for x in found["added_tokens"]}
            byte = {c: i for i, c in enumerate(byte_chars())}
            table = {i: bytes(byte[c] for c in t) for t, i in found["model"]["vocab"].items() if i not in special}
            bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={b: i for i, b in table.items()}, special_tokens={})
            self.encode = lambda texts: [bpe.encode_to_numpy(t, disallowed_special=()).astype(np.int64) for t in texts]
            self.prefix = " "
        else:
            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            table = {}
            for i in range(pieces.vocab_size()):
                p = pieces.id_to_piece(i)
                table[i] = bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()
            self.encode = lambda texts: [np.array(x, np.int64) for x in pieces.encode(texts, num_threads=1)]
        self.size = max([*table, *special]) + 1
        self.bytes = [table.get(i, b"") for i in range(self.size)]
        self.length = np.array([len(b) for b in self.bytes])
        digits = [str(i).encode() for i in range(self.size)]
        self.wide = max(map(len, digits)) + 1
        self.digits = np.frombuffer(b"".join(d.ljust(self.wide, b"\0") for d in digits), np.uint8).reshape(-1, self.wide).copy()
        self.last = np.array([len(d) for d in digits])


@lru_cache(4)
def side(path: str) -> Side:
    return Side(path)


def ids_of(s: Side, texts: list[str]) -> list[np.ndarray]:
    """The ids of " " + text, none where the text isn't given back."""
    out = []
    for text, ids in zip(texts, s.encode([s.prefix + t for t in texts]), strict=True):
        same = text and b"".join(map(s.bytes.__getitem__, ids.tolist())) == b" " + text.encode()
        out.append(ids if same else ids[:0])
    return out


def groups_text(a: Side, b: Side, ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """'a1,a2|b1;a3|b2;' of all groups as bytes, and for both sides each token's size in it. cut: the token ends a group."""
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    wide = max(a.wide, b.wide)
    out = np.zeros((len(ids_a) + len(ids_b), wide), np.uint8)
    before_a = np.searchsorted(group_b, group_a)  # tokens of b in earlier groups
    before_b = np.searchsorted(group_a, group_b, side="right")  # tokens of a up to this group
    for s, ids, cut, at, end in ((a, ids_a, cut_a, np.arange(len(ids_a)) + before_a, b"|"), (b, ids_b, cut_b, np.arange(len(ids_b)) + before_b, b";")):
        out[at, : s.wide] = s.digits[ids]
        out[at, s.last[ids]] = np.where(cut, end[0], ord(","))
    return out[out != 0], a.last[ids_a] + 1, b.last[ids_b] + 1


def aligned(a: Side, b: Side, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Each text's (n_a, n_b, n_groups, n_links, groups_sha256), and of all links the text's number and the pair b * a.size + a."""
    xs, ys = ids_of(a, texts), ids_of(b, texts)
    for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
        if not len(x) or not len(y):
            xs[i], ys[i] = x[:0], y[:0]
    x, y = np.concatenate(xs), np.concatenate(ys)
    if not len(x):
        return [(0, 0, 0, 0, "")] * len(texts), x, y
    # Both sides of a text have equal bytes, so ends of the joined sequences stand for ends within each text.
    end_x, end_y = np.cumsum(a.length[x]), np.cumsum(b.length[y])
    on_x, on_y = np.zeros((2, end_x[-1] + 1), bool)
    on_x[end_x], on_y[end_y] = True, True
    cut_x, cut_y = on_y[end_x], on_x[end_y]
    n_x, n_y = np.array([len(v) for v in xs]), np.array([len(v) for v in ys])
    doc_x = np.repeat(np.arange(len(texts)), n_x)
    n_groups = np.bincount(doc_x, cut_x, len(texts)).astype(np.int64)
    text, size_x, size_y = groups_text(a, b, x, y, cut_x, cut_y)
    size = np.bincount(doc_x, size_x, len(texts)) + np.bincount(np.repeat(np.arange(len(texts)), n_y), size_y, len(texts))
    to = np.cumsum(size).astype(np.int64)
    data, start, rows = text.tobytes(), 0, []
    for i, stop in enumerate(to.tolist()):
        rows.append((int(n_x[i]), int(n_y[i]), int(n_groups[i]), int(n_groups[i]), hashlib.sha256(data[start : stop - 1]).hexdigest() if stop > start else ""))
        start = stop
    return rows, doc_x[cut_x], y[cut_y] * a.size + x[cut_x]


LOCAL = "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
POSTING = "pair long, n long, docs binary, times binary"
MADE = f"block long, kind int, doc int, {LOCAL}, {POSTING}"
NAMES = [c.split()[0] for c in MADE.split(", ")]
TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
KINDS = {c.split()[0]: TYPES[c.split()[1]] for c in MADE.split(", ")}


def batch_of(size: int, /, **cols) -> pa.RecordBatch:
    """A batch of `size` rows with nulls in the columns that aren't given."""
    return pa.record_batch([cols[c] if isinstance(cols.get(c), pa.Array) else pa.array(cols[c], k) if c in cols else pa.nulls(size, k) for c, k in KINDS.items()], NAMES)


def packed(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Stretches of an array as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def postings(block: int, pair: np.ndarray, doc: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block's postings in order of pair and document. A multiplicity above 255 takes several entries."""
    order = np.lexsort((doc, pair))
    pair, doc, times = pair[order], doc[order], times[order]
    heads = np.append(np.flatnonzero(np.diff(pair, prepend=-1)), len(pair))
    n = np.add.reduceat(times, heads[:-1])
    entries = (times + 254) // 255
    last = np.cumsum(entries)
    small = np.full(last[-1], 255)
    small[last - 1] = times - 255 * (entries - 1)
    doc = np.repeat(doc, entries)
    bounds = np.append(0, last)[heads]
    for i in range(0, len(n), 1 << 15):
        j = min(len(n), i + (1 << 15))
        at = bounds[i : j + 1]
        part = slice(at[0], at[-1])
        docs, many = packed(doc[part].astype("<u2"), at - at[0]), packed(small[part].astype(np.uint8), at - at[0])
        yield batch_of(j - i, block=[block] * (j - i), kind=[1] * (j - i), pair=pair[heads[:-1]][i:j], n=n[i:j], docs=docs, times=many)


def made(path_a: str, path_b: str):
    """Rows of kind 0, the documents, and of kind 1, the postings of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = side(path_a), side(path_b)
        block = TaskContext.get().partitionId() << 32
        found: list[tuple[np.ndarray, ...]] = []
        ids, texts, docs, size, held = [], [], 0, 0, 0

        def sliced() -> pa.RecordBatch:
            nonlocal ids, texts, docs, size, held
            rows, doc, pair = aligned(a, b, texts)
            key, times = np.unique(pair * (1 << 16) + doc + docs, return_counts=True)
            found.append((key >> 16, key & 0xFFFF, times))
            cols = [list(c) for c in zip(*rows, strict=True)]
            made = batch_of(len(ids), block=[block] * len(ids), kind=[0] * len(ids), doc=list(range(docs, docs + len(ids))), id=ids, **dict(zip(["n_a", "n_b", "n_groups", "n_links", "groups_sha256"], cols, strict=True)))
            docs, held = docs + len(ids), held + size
            ids, texts, size = [], [], 0
            return made

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal found, docs, held, block
            pair, doc, times = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(pair):
                yield from postings(block, pair, doc, times)
            found, docs, held, block = [], 0, 0, block + 1

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = t.as_py()
                if texts and size + len(text) > SLICE_BYTES:
                    yield sliced()
                if held + size > BLOCK_BYTES or docs + len(ids) == BLOCK_DOCS:
                    if texts:
                        yield sliced()
                    yield from closed()
                ids.append(i)
                texts.append(text)
                size += len(text)
        if texts:
            yield sliced()
        if found:
            yield from closed()

    return run


def summed(rows: pa.Table, parts: pa.Table) -> pa.Table:
    """A block's documents with what its postings contribute to them."""
    n = rows.num_rows
    best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if parts.num_rows:
        docs, times = (np.frombuffer(b"".join(parts[c].to_pylist()), k).astype(np.int64) for c, k in (("docs", "<u2"), ("times", np.uint8)))
        size = np.array([len(x) for x in parts["times"].to_pylist()])
        np.add.at(best, docs, times * np.repeat(parts["best"].to_numpy(), size))
        np.add.at(total, docs, times * np.repeat(parts["count"].to_numpy(), size))
    at = rows["doc"].to_numpy()
    return rows.select([c.split()[0] for c in LOCAL.split(", ")]).append_column("n_best", pa.array(best[at])).append_column("count_sum", pa.array(total[at]))


def align(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of every row."""
    size_a, size_b = side(path_a).size, side(path_b).size
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = written(spark, rows.mapInArrow(made(path_a, path_b), MADE), "postings")
    posted = table.where("kind = 1").select("block", "pair", "n", "docs", "times")
    of_b = F.floor(F.col("pair") / size_a).cast("int").alias("b")
    counts = posted.groupBy("pair").agg(F.sum("n").alias("count"))
    highest = written(spark, counts.select(of_b, "count").groupBy("b").agg(F.max("count").alias("highest")), "highest")
    if highest.count() > size_b:
        raise ValueError("more ids than the second vocabulary has")
    streamed = posted.select("*", of_b).withColumn("count", F.sum("n").over(Window.partitionBy("b", "pair")))
    parts = streamed.join(F.broadcast(highest), "b").select(F.col("block").alias("home"), "count", (F.col("count") == F.col("highest")).alias("best"), "docs", "times")
    local = table.where("kind = 0").select("block", "doc", *[c.split()[0] for c in LOCAL.split(", ")])
    return local.groupBy("block").cogroup(parts.groupBy("home")).applyInArrow(summed, f"{LOCAL}, n_best long, count_sum long")
