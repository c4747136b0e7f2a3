"""Ranked lexical search over inverted treaps.

An index is a table of segments. A segment holds the documents of a stretch of one task's input, SEGMENT_BYTES of text or SEGMENT_DOCS
at most, in order of id, and for each term a treap of its postings: a binary tree that is a search tree by document and a
heap by impact (ties by a hash of the document, so equal copies don't make a chain). Impact is what a posting adds to a score but for the term's
weight, so it is known when the index is built, after one pass that counts documents and terms.

A query walks the treaps of all its terms at once. It keeps intervals of documents; for each, the root of every treap's part inside
it, which holds the greatest impact there. An interval whose summed maxima are below the k-th best score found so far is dropped with
all it holds; any other is cut at the document of its weightiest root, which is scored, and each treap goes down to
the roots inside the two halves. Intervals of LEAF_DOCS documents or fewer are scored whole. All intervals of a level are dealt with together.

Scale: documents stay where they are read, and no posting is shuffled. Queries come in blocks of BLOCK_CHARS, which bounds what a broadcast holds;
each block reads the index once. A task keeps the k best of its segments for each query, the k-th of them prunes the next segment, and what
it found meets the others' by parts, then once for each query.

Defined results: null text has no terms and is no document of N; a null id is kept and ranks after others of equal score; repeated rows are documents of
their own; an item's terms are those of all rows with its id; items without terms, and empty tables, give no rows; extra columns don't matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.common import shared_path, written

TOP = 50
SEGMENT_BYTES, SEGMENT_DOCS = 1 << 24, (1 << 16) - 1
LEAF_DOCS = 16
BLOCK_CHARS = 1 << 21
#: Parts in which an item's candidates meet first.
PARTS = 64
#: ASCII letters become lower case, other ASCII characters but digits become spaces; all other bytes are parts of terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def lengthening(n: int, n_docs: int, n_terms: int) -> int:
    """A document's m: 100 at the average number of terms, by integers."""
    return 100 - 50 + (50 * n * n_docs) // n_terms


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def treap(impacts: list[int], salt: list[int], bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Left and right children of every posting, as distance from its term's first posting plus 1 (0: none)."""
    n = len(impacts)
    left, right = [0] * n, [0] * n
    for b in range(len(bounds) - 1):
        start, end = bounds[b], bounds[b + 1]
        if end - start < 2:
            continue
        stack: list[int] = []
        for i in range(start, end):
            last, x, s = 0, impacts[i], salt[i]
            while stack and (impacts[j := stack[-1]] < x or (impacts[j] == x and salt[j] < s)):
                last = stack.pop() - start + 1
            left[i] = last
            if stack:
                right[stack[-1]] = i - start + 1
            stack.append(i)
    return np.array(left, np.uint16), np.array(right, np.uint16)


def root_of(left: np.ndarray, right: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each term's root: the posting that is nobody's child."""
    size = np.diff(bounds)
    start = np.repeat(bounds[:-1], size)
    child = np.zeros(len(left), bool)
    for x in (left, right):
        child[(start + x.astype(np.int64) - 1)[x > 0]] = True
    return np.flatnonzero(~child)


SEGMENT = "n_docs int, ids array<bigint>, terms binary, bounds binary, docs binary, impacts binary, left binary, right binary"
NAMES = [x.split()[0] for x in SEGMENT.split(", ")]


def segment(rows: list[tuple[int | None, bytes]], n_docs: int, n_terms: int) -> pa.RecordBatch:
    """The inverted treaps of some documents."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    vocabulary: dict[bytes, int] = {}
    ids, tfs, sizes, lengths = [], [], [], []
    for _, text in rows:
        words = terms_of(text)
        count = Counter(words)
        ids += [vocabulary.setdefault(t, len(vocabulary)) for t in count]
        tfs += count.values()
        sizes.append(len(count))
        lengths.append(lengthening(len(words), n_docs, n_terms) if words else 0)
    names = sorted(vocabulary)
    rank = np.zeros(len(names), np.int64)
    rank[[vocabulary[t] for t in names]] = np.arange(len(names))
    term = rank[np.array(ids, np.int64)]
    order = np.argsort(term, kind="stable")
    doc = np.repeat(np.arange(len(rows)), sizes)[order]
    tf, m = np.array(tfs, np.int64)[order], np.array(lengths, np.int64)[doc]
    impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m)
    bounds = np.zeros(len(names) + 1, np.int64)
    np.cumsum(np.bincount(term, minlength=len(names)), out=bounds[1:])
    salt = (doc * 40503 + 12345) & 0xFFFF  # an odd factor: distinct for distinct documents
    left, right = treap(impact.tolist(), salt.tolist(), bounds.tolist())
    cols = [b" ".join(names), bounds.astype("<u4").tobytes(), doc.astype("<u2").tobytes(), impact.astype("<u4").tobytes(), left.astype("<u2").tobytes(), right.astype("<u2").tobytes()]
    return pa.record_batch([pa.array([len(rows)], pa.int32()), pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), *(pa.array([c], pa.binary()) for c in cols)], NAMES)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for b in batches:
        for t in b.column(0):
            n = len(terms_of(t.as_py()))
            docs, terms = docs + (n > 0), terms + n
    yield pa.record_batch([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], ["n_docs", "n_terms"])


def _built(n_docs: int, n_terms: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                text = t.as_py()
                if rows and (size + len(text) > SEGMENT_BYTES or len(rows) == SEGMENT_DOCS):
                    yield segment(rows, n_docs, n_terms)
                    rows, size = [], 0
                rows.append((i.as_py(), text))
                size += len(text)
        if rows:
            yield segment(rows, n_docs, n_terms)

    return run


class Index:
    """Segments in the shared folder, and how many documents and terms they hold."""

    def __init__(self, spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
        found = rows.select("text").mapInArrow(_counted, "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first()
        self.spark, self.n_docs, self.n_terms = spark, found[0] or 0, found[1] or 0
        path = shared_path(spark, "treaps")
        rows.mapInArrow(_built(self.n_docs, max(1, self.n_terms)), SEGMENT).write.option("compression", "zstd").parquet(path)
        self.segments = spark.read.schema(SEGMENT).parquet(path)


class Segment:
    """A segment as arrays, with absolute children."""

    def __init__(self, row: dict):
        self.n_docs, self.ids = row["n_docs"], row["ids"]
        self.number = {t: i for i, t in enumerate(row["terms"].split(b" "))} if row["terms"] else {}
        self.bounds = np.frombuffer(row["bounds"], "<u4").astype(np.int64)
        self.docs = np.frombuffer(row["docs"], "<u2").astype(np.int64)
        self.impacts = np.append(np.frombuffer(row["impacts"], "<u4").astype(np.int64), 0)  # the last one is "none"
        left, right = np.frombuffer(row["left"], "<u2"), np.frombuffer(row["right"], "<u2")
        self.roots = root_of(left, right, self.bounds)
        start, none = np.repeat(self.bounds[:-1], np.diff(self.bounds)), len(self.docs)
        self.left, self.right = (np.append(np.where(x > 0, start + x - 1, none), none) for x in (left, right))
        self.keys = (np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds)) << 16) | self.docs
        self.docs = np.append(self.docs, -1)

    def scores(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores of documents, each term's posting found by search."""
        wanted = (terms << 16)[None, :] | docs[:, None]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (np.where(self.keys[at] == wanted, self.impacts[at], 0) * weights).sum(1)

    def inside(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The roots of treaps cut to intervals: from each node down to the first inside."""
        node, low, high = node.copy(), np.broadcast_to(low[:, None], node.shape), np.broadcast_to(high[:, None], node.shape)
        flat, low, high = node.reshape(-1), low.reshape(-1), high.reshape(-1)
        todo = np.flatnonzero(flat < len(self.keys))
        while len(todo):
            at = flat[todo]
            d = self.docs[at]
            right, left = d < low[todo], d >= high[todo]
            flat[todo] = np.where(right, self.right[at], np.where(left, self.left[at], at))
            todo = todo[(right | left) & (flat[todo] < len(self.keys))]
        return flat.reshape(node.shape)

    def search(self, terms: np.ndarray, weights: np.ndarray, top: Best) -> int:
        """Puts this segment's best documents into `top`; returns how many were scored."""
        low, high = np.zeros(1, np.int64), np.full(1, self.n_docs, np.int64)
        node, scored = self.roots[terms][None, :], 0
        while len(low):
            parts = self.impacts[node] * weights
            bound = parts.sum(1)
            use = bound >= max(1, top.least)
            low, high, node, parts = low[use], high[use], node[use], parts[use]
            size = high - low
            small = size <= LEAF_DOCS
            n = size[small]
            whole = np.repeat(low[small] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            low, high, node, parts, size = low[~small], high[~small], node[~small], parts[~small], size[~small]
            pivot = self.docs[node[np.arange(len(node)), parts.argmax(1)]] if len(node) else low
            middle = (low + high) // 2
            pivot = np.where((8 * (pivot - low) < size) | (8 * (high - pivot) < size), middle, pivot)
            docs = np.append(whole, pivot)
            if len(docs):
                top.add(self.scores(docs, terms, weights), docs, self.ids)
                scored += len(docs)
            low, high, node = np.append(low, pivot + 1), np.append(pivot, high), np.concatenate([node, node])
            use = low < high
            low, high = low[use], high[use]
            node = self.inside(node[use], low, high)
        return scored


class Best:
    """The k best (score, id) so far: highest score first, then least id, null ids last."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, [], 0

    def add(self, scores: np.ndarray, docs: np.ndarray, ids: list) -> None:
        use = np.flatnonzero(scores >= max(1, self.least))
        if not len(use):
            return
        if len(use) > self.k:  # ties with the k-th stay
            use = use[scores[use] >= np.partition(scores[use], -self.k)[-self.k]]
        self.rows += [(-int(scores[i]), (x := ids[docs[i]]) is None, x or 0) for i in use]
        self.rows = sorted(self.rows)[: self.k]
        self.least = -self.rows[-1][0] if len(self.rows) == self.k else 0


def _frequencies(terms) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, df = terms.value, Counter()
        for b in batches:
            for names, bounds in zip(b.column(0), b.column(1), strict=True):
                size = np.diff(np.frombuffer(bounds.as_py(), "<u4").astype(np.int64))
                for t, n in zip(names.as_py().split(b" "), size.tolist(), strict=False):
                    if t in wanted:
                        df[t] += n
        yield pa.record_batch([pa.array(df.keys(), pa.binary()), pa.array(df.values(), pa.int64())], ["term", "df"])

    return run


def _searched(queries, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries.value]
        for b in batches:
            for row in range(b.num_rows):
                s = Segment({c: b.column(c)[row].as_py() for c in b.schema.names})
                for (_, terms), top in zip(queries.value, best, strict=True):
                    here = [(s.number[t], w) for t, w in terms if t in s.number]
                    if here:
                        s.search(np.array([t for t, _ in here]), np.array([w for _, w in here]), top)
        for (item, _), top in zip(queries.value, best, strict=True):
            if top.rows:
                ids, scores = [None if null else x for _, null, x in top.rows], [-x for x, _, _ in top.rows]
                yield pa.record_batch([pa.array([item] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["item_id", "doc_id", "score"])

    return run


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[dict[int | None, set[bytes]]]:
    """Items with their terms, in blocks of about BLOCK_CHARS; the driver holds one block at a time."""
    block: dict[int | None, set[bytes]] = {}
    size = 0
    for r in items.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")).cast("binary")).orderBy(id_col).toLocalIterator():
        if size > BLOCK_CHARS and r[0] not in block:
            yield block
            block, size = {}, 0
        block.setdefault(r[0], set()).update(terms_of(bytes(r[1])))
        size += len(r[1])
    if block:
        yield block


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best documents of each item, with their ranks."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    part = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    part = part.withColumn("rank", rank("item_id", "part")).where(F.col("rank") <= k)
    return part.withColumn("rank", rank("item_id")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(spark: SparkSession, index: Index, items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0."""
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in blocks(items, id_col, text_col):
        terms = spark.sparkContext.broadcast(set().union(*block.values()))
        found = index.segments.select("terms", "bounds").mapInArrow(_frequencies(terms), "term binary, df long")
        df = {bytes(t): n for t, n in found.groupBy("term").agg(F.sum("df")).toLocalIterator()}
        terms.unpersist()
        weights = {t: weight(index.n_docs, n) for t, n in df.items()}
        queries = [(item, sorted((t, weights[t]) for t in known if t in weights)) for item, known in block.items()]
        queries = spark.sparkContext.broadcast([q for q in queries if q[1]])
        out = out.union(written(spark, index.segments.mapInArrow(_searched(queries, k), out.schema), "found"))
    return best_of(out, k)
