"""Token counts that follow edits.

A document's pre-tokens are the leaves of a segment tree: blocks of pre-tokens hold their sum of
characters and tokens, and so does each node above. `trees` splits and encodes every document once and keeps its leaves (lengths and
tokens of its pre-tokens, beside the text) as a table; `edited` takes such a table and a document's edits. An edit descends by
characters to the block it begins in, splits again only the text from a few pre-tokens before it
(their ends can depend on what follows) up to the first boundary after it that the old
text had too, encodes those pre-tokens alone, and updates the sums of the blocks it touched. Blocks that no edit reaches are never
taken apart: their sums come from the leaves, and they are passed on as they are. `edited` returns the trees as they are then, so that
further edits go on from there.

Runs as maps over Arrow batches; the table between them is written to the shared folder. Counts of
pre-tokens are shared by the texts of a slice, and unknown ones are merged in one go (see `bpe.Vocabulary`).

Defined results: null text is empty text; edits outside the text are clipped to it; null or no
edits leave the count; strings of special tokens are ordinary text; repeated rows each get a result; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.bpe import Vocabulary, slices, vocabulary_of
from tidewright.llm.common import written

#: The pattern that byte-level vocabularies split text with (a fixed value).
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
BLOCK = 64
#: Pre-tokens before an edit that are split again: a contraction spans three.
BEFORE = 3
CACHE = 1 << 20


class Counter:
    """Tokens of pre-tokens, remembered up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}

    def trim(self) -> None:
        """Forgets all, between slices, once too many are known."""
        if len(self.known) > CACHE:
            self.known.clear()

    def learn(self, pieces: list[str]) -> None:
        new = list(set(pieces) - self.known.keys())
        if new:
            raw = [p.encode() for p in new]
            n = np.array([len(x) for x in raw], np.int64)
            _, counts = self.vocabulary.merge(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(n) - n, n)
            self.known.update(zip(new, counts.tolist(), strict=True))


class Block:
    """Some pre-tokens: a stretch of the stored leaves, until it is opened for an edit."""

    __slots__ = ("tree", "first", "last", "at", "own")

    def __init__(self, tree: Tree, first: int, last: int, at: int, own: tuple[list[str], list[int]] | None = None):
        self.tree, self.first, self.last, self.at, self.own = tree, first, last, at, own

    @property
    def pieces(self) -> list[str]:
        if self.own is None:
            ends = (self.at + np.cumsum(self.tree.lengths[self.first : self.last])).tolist()
            self.own = [self.tree.text[a:b] for a, b in zip([self.at, *ends], ends, strict=False)], self.tree.counts[self.first : self.last].tolist()
        return self.own[0]

    @property
    def counts(self) -> list[int]:
        return self.own[1] if self.pieces is not None else []

    def put(self, a: int, b: int, pieces: list[str], counts: list[int]) -> None:
        self.pieces[a:b] = pieces
        self.own[1][a:b] = counts

    def sums(self) -> tuple[int, int]:
        if self.own is None:
            return int(self.tree.lengths[self.first : self.last].sum()), int(self.tree.counts[self.first : self.last].sum())
        return sum(map(len, self.own[0])), sum(self.own[1])


class Tree:
    """Blocks of pre-tokens under a binary tree of sums of characters and tokens."""

    def __init__(self, text: str, lengths: np.ndarray, counts: np.ndarray):
        self.text, self.lengths, self.counts = text, lengths, counts
        cuts = np.arange(0, max(1, len(lengths)), BLOCK)
        at = np.concatenate([[0], np.cumsum(lengths)])[cuts].tolist()
        self.blocks = [Block(self, c, min(c + BLOCK, len(lengths)), a) for c, a in zip(cuts.tolist(), at, strict=True)]
        whole = [np.add.reduceat(x, cuts) if len(x) else np.zeros(1, np.int64) for x in (lengths.astype(np.int64), counts.astype(np.int64))]
        self.build(*whole)

    def build(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        """The nodes over the blocks' sums: node i is over 2i and 2i + 1, blocks begin at `base`."""
        self.base = 1 << max(0, len(self.blocks) - 1).bit_length()
        out = []
        for x in (chars, tokens):
            level = np.zeros(self.base, np.int64)
            level[: len(x)] = x
            levels = [level]
            while len(level) > 1:
                level = level[0::2] + level[1::2]
                levels.append(level)
            out.append([0, *np.concatenate(levels[::-1]).tolist()])
        self.chars, self.tokens = out

    @property
    def total(self) -> int:
        return self.tokens[1]

    def locate(self, at: int) -> tuple[int, int]:
        """The block that character `at` is in, and where the block begins."""
        node, start = 1, 0
        at = min(at, self.chars[1] - 1)
        while node < self.base:
            node *= 2
            if at - start >= self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.base, start

    def refresh(self, i: int) -> None:
        node = self.base + i
        self.chars[node], self.tokens[node] = self.blocks[i].sums()
        node //= 2
        while node:
            self.chars[node], self.tokens[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.tokens[2 * node] + self.tokens[2 * node + 1]
            node //= 2

    def split(self, i: int) -> None:
        """Cuts block i into blocks of BLOCK; the other blocks' sums stay."""
        pieces, counts = self.blocks[i].own
        parts = [Block(self, 0, 0, 0, (pieces[a : a + BLOCK], counts[a : a + BLOCK])) for a in range(0, len(pieces), BLOCK)]
        n = len(self.blocks)
        new = [p.sums() for p in parts]
        sums = [[*x[self.base : self.base + i], *[v[k] for v in new], *x[self.base + i + 1 : self.base + n]] for k, x in enumerate((self.chars, self.tokens))]
        self.blocks[i : i + 1] = parts
        self.build(*(np.array(x, np.int64) for x in sums))

    def leaves(self) -> tuple[str, np.ndarray, np.ndarray]:
        """The text and its leaves as they are now."""
        text, lengths, counts = [], [], []
        for b in self.blocks:
            if b.own is None:
                lengths.append(self.lengths[b.first : b.last])
                counts.append(self.counts[b.first : b.last])
                text.append(self.text[b.at : b.at + int(lengths[-1].sum())])
            else:
                text += b.own[0]
                lengths.append(np.fromiter(map(len, b.own[0]), np.int32, len(b.own[0])))
                counts.append(np.array(b.own[1], np.int32))
        return "".join(text), np.concatenate(lengths), np.concatenate(counts)


class Edit:
    """One edit of a tree: first what is to be split again, then (its pre-tokens being known) the update."""

    def __init__(self, tree: Tree, start: int, length: int, new: str):
        self.tree = tree
        size = tree.chars[1]
        start = max(0, min(start, size))
        stop = max(start, min(size, start + max(0, length)))
        block, at = tree.locate(start) if size else (0, 0)
        row = tree.blocks[block].pieces
        k = 0
        while k < len(row) - 1 and at + len(row[k]) <= start:
            at += len(row[k])
            k += 1
        # Back to where what comes before can't depend on the edit: some pre-tokens, and all white space before them.
        left = BEFORE
        while True:
            if k == 0:
                if block == 0:
                    break
                block -= 1
                k = len(tree.blocks[block].pieces)
                continue
            before = tree.blocks[block].pieces[k - 1]
            if left <= 0 and not before.isspace():
                break
            k, at, left = k - 1, at - len(before), left - 1
        self.block, self.k = block, k
        # The old text from here on is read piece by piece, as far as it takes until boundaries meet again.
        flow = self.flow(block, k)
        old, ends, pos = [], {}, at

        def read(until: int) -> bool:
            nonlocal pos
            while pos < until:
                x = next(flow, None)
                if x is None:
                    return False
                old.append(x)
                pos += len(x)
                ends[pos] = len(old)
            return True

        read(stop)
        shift = len(new) - (stop - start)
        made: list[str] = []
        ahead = 256
        while True:
            whole = read(stop + ahead)
            text = "".join(old)
            text = text[: start - at] + new + text[stop - at :]
            made, p, met = [], 0, None
            for m in PATTERN.finditer(text):
                # What was read may go on: a pre-token that reaches to near its end isn't certain yet.
                if whole and m.end() > len(text) - 2:
                    break
                p = m.end()
                made.append(m[0])
                back = at + p - shift
                if back >= stop and p >= start - at + len(new) and back in ends:
                    met = ends[back]
                    break
            if met is not None or not whole:
                break
            ahead *= 4
        self.new = made
        self.old = len(old) if met is None else met

    def flow(self, block: int, k: int) -> Iterator[str]:
        for i in range(block, len(self.tree.blocks)):
            yield from self.tree.blocks[i].pieces[k if i == block else 0 :]

    def apply(self, known: dict[str, int]) -> int:
        """Puts the new pre-tokens in place of the old; returns how many were encoded."""
        t, i, left = self.tree, self.block, self.old
        row = t.blocks[i]
        touched = {i}
        cut = min(left, len(row.pieces) - self.k)
        row.put(self.k, self.k + cut, self.new, [known[x] for x in self.new])
        left -= cut
        j = i + 1
        while left > 0:
            cut = min(left, len(t.blocks[j].pieces))
            t.blocks[j].put(0, cut, [], [])
            touched.add(j)
            left -= cut
            j += 1
        for x in touched:
            t.refresh(x)
        if len(row.pieces) > 2 * BLOCK:
            t.split(i)
        return len(self.new)


LEAVES = "text string, lengths array<int>, counts array<int>"


def columns(leaves: list[tuple[str, np.ndarray, np.ndarray]]) -> list[pa.Array]:
    """The columns of LEAVES."""
    out: list[pa.Array] = [pa.array([t for t, _, _ in leaves], pa.string())]
    for k in (1, 2):
        at = np.concatenate([[0], np.cumsum([len(x[k]) for x in leaves])]).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([x[k] for x in leaves]).astype(np.int32))))
    return out


def trees(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, lengths, counts, n_tokens) of every document: its pre-tokens' lengths in characters and tokens; and the columns `also`."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_of(tokenizer_path))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            for at, texts in slices(batch.column(1).to_pylist()):
                split = [PATTERN.findall(t) for t in texts]
                counter.trim()
                counter.learn([p for s in split for p in s])
                leaves = [(t, np.fromiter(map(len, s), np.int32, len(s)), np.fromiter(map(counter.known.__getitem__, s), np.int32, len(s))) for t, s in zip(texts, split, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *columns(leaves), pa.array([int(c.sum()) for _, _, c in leaves], pa.int64()), *[c.slice(at, len(texts)) for c in batch.columns[2:]]], names)

    names = [id_col, "text", "lengths", "counts", "n_tokens", *also]
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in also)
    return docs.select(*[F.col(f"`{c}`") for c in (id_col, text_col, *also)]).mapInArrow(run, f"`{id_col}` {kind}, {LEAVES}, n_tokens long{more}")


def edited(kept: DataFrame, tokenizer_path: str, id_col: str = "doc_id", edits_col: str = "edits", leaves: bool = True) -> DataFrame:
    """`kept` (the columns of `trees`, and edits) after its edits, with n_before, n_edits, n_chars, n_pieces (before) and n_encoded.

    Without `leaves` only the numbers are returned. `edits` is an array of (start, length, replacement), in characters, applied in order, each to the text as it is then.
    """
    kind = kept.schema[id_col].dataType.simpleString()
    shared = kept.sparkSession.sparkContext.broadcast(vocabulary_of(tokenizer_path))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            every = batch.column(4).to_pylist()
            for at, texts in slices(batch.column(1).to_pylist()):
                edits = [e or [] for e in every[at : at + len(texts)]]
                stored = ((batch.column(k)[at + i].values.to_numpy(zero_copy_only=False) for k in (2, 3)) for i in range(len(texts)))
                now = [Tree(t, *x) for t, x in zip(texts, stored, strict=True)]
                before, pieces, encoded = [t.total for t in now], [len(t.lengths) for t in now], [0] * len(now)
                counter.trim()
                for turn in range(max(map(len, edits), default=0)):
                    due = [(i, Edit(now[i], e[turn]["start"] or 0, e[turn]["length"] or 0, e[turn]["replacement"] or "")) for i, e in enumerate(edits) if turn < len(e)]
                    counter.learn([p for _, x in due for p in x.new])
                    for i, x in due:
                        encoded[i] += x.apply(counter.known)
                told = [[t.total for t in now], before, [len(e) for e in edits], [t.chars[1] for t in now], pieces, encoded]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *(columns([t.leaves() for t in now]) if leaves else []), *[pa.array(c, pa.int64()) for c in told]], names)

    numbers = ["n_tokens", "n_before", "n_edits", "n_chars", "n_pieces", "n_encoded"]
    names = [id_col, *(["text", "lengths", "counts"] if leaves else []), *numbers]
    schema = ", ".join([f"`{id_col}` {kind}", *([LEAVES] if leaves else []), *[f"{n} long" for n in numbers]])
    return kept.select(F.col(f"`{id_col}`"), "text", "lengths", "counts", F.col(f"`{edits_col}`")).mapInArrow(run, schema)


def counted(spark: SparkSession, docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """(id, n_tokens, n_edits, n_tokens_after, n_chars_after, n_pieces, n_encoded) of every document: trees kept as a table, then edited."""
    kept = written(spark, trees(docs, tokenizer_path, id_col, text_col, (edits_col,)), "trees")
    out = edited(kept, tokenizer_path, id_col, edits_col, leaves=False)
    return out.select(F.col(f"`{id_col}`"), F.col("n_before").alias("n_tokens"), "n_edits", F.col("n_tokens").alias("n_tokens_after"), F.col("n_chars").alias("n_chars_after"), "n_pieces", "n_encoded")


#: What the sample edits put in: nothing, words, white space, a contraction, a number.
REPLACEMENTS = ["", " revised wording", "\n\n", "'re", " 2024"]


def sample_edits(id_col: Column, text: Column, n: int = 3) -> Column:
    """Edits that depend on a document's id and length alone, for exercising the operator on whole tables."""
    size = F.length(F.coalesce(text, F.lit("")))

    def edit(i: Column) -> Column:
        h = F.xxhash64(id_col, i)
        return F.struct(F.pmod(h, size + 1).cast("long").alias("start"), F.pmod(F.shiftright(h, 8), F.lit(40)).cast("long").alias("length"), F.element_at(F.array(*map(F.lit, REPLACEMENTS)), (F.pmod(F.shiftright(h, 16), F.lit(len(REPLACEMENTS))) + 1).cast("int")).alias("replacement"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), edit)


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`docs` (or kept trees) with the column `edits` from a table (id, seq, start, length, replacement)."""
    listed = edits.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "length", "replacement"))).alias("_e"))
    return docs.join(listed, id_col, "left").withColumn("edits", F.transform("_e", lambda e: F.struct(e["start"].alias("start"), e["length"].alias("length"), e["replacement"].alias("replacement")))).drop("_e")
