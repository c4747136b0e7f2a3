"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The words of all documents are counted, the most frequent ones are merged once
and compiled into a minimal acyclic automaton with outputs on its transitions:
the sum of a path's outputs is the word's ordinal, and the ordinal leads to its
ids. The automaton is a file that Spark hands to each executor once; its Python workers map it into memory and so share its pages.
Words outside it are
merged exactly, lowest rank first and leftmost among equals. Both run over
whole Arrow batches at once, so no Python code runs per word.

Which characters are letters, numbers and white space is taken from the tokenizers library (its Unicode may be newer than Python's);
texts with a character that the two normalise differently are normalised by the library.

Defined results: null text is empty text; empty text has no ids and decodes to
the empty string; an empty table gives an empty result; rows are never dropped, repeated rows each get their own
result; extra columns don't matter (only id and text columns are read).
"""

from __future__ import annotations

import atexit
import hashlib
import heapq
import json
import mmap
import re
import shutil
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are taken in slices of about so many characters, which bounds a worker's memory (a longer text is a slice alone).
SLICE_CHARS = 1 << 20
#: Words of the lexicon, at most, and occurrences in a partition below which a word isn't a candidate for it.
LEXICON_WORDS = 1 << 16
MIN_COUNT = 4
INF = np.int32(0x7FFFFFFF)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class HashTable:
    """uint32 keys to two int32 values, open addressing; looks up whole arrays."""

    def __init__(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.bits = max(8, int(len(keys) * 6).bit_length())
        size = 1 << self.bits
        self.keys, self.a, self.b = np.full(size, 0xFFFFFFFF, np.uint32), np.full(size, -1, np.int32), np.zeros(size, np.int32)
        left = np.arange(len(keys))
        slot, self.probes = self._slot(keys), 0
        while len(left):
            self.probes += 1
            free = self.keys[slot[left]] == 0xFFFFFFFF
            first = np.zeros(len(left), bool)
            first[np.unique(slot[left], return_index=True)[1]] = True
            put = left[free & first]
            self.keys[slot[put]], self.a[slot[put]], self.b[slot[put]] = keys[put], a[put], b[put]
            left = left[~(free & first)]
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of each key; a is -1 where the key is missing."""
        slot = self._slot(keys)
        found = self.keys[slot]
        a, b = self.a[slot], self.b[slot]
        miss = np.flatnonzero(found != keys)
        for _ in range(self.probes):
            if not len(miss):
                break
            empty = self.keys[slot[miss]] == 0xFFFFFFFF
            a[miss[empty]] = -1
            miss = miss[~empty]
            slot[miss] = (slot[miss] + 1) & (len(self.keys) - 1)
            hit = self.keys[slot[miss]] == keys[miss]
            done = miss[hit]
            a[done], b[done] = self.a[slot[done]], self.b[slot[done]]
            miss = miss[~hit]
        a[miss] = -1
        return a, b

    def arrays(self) -> list[np.ndarray]:
        return [self.keys, self.a, self.b]

    @classmethod
    def of(cls, arrays: list[np.ndarray], probes: int) -> HashTable:
        t = cls.__new__(cls)
        t.keys, t.a, t.b = arrays
        t.bits, t.probes = len(t.keys).bit_length() - 1, probes
        return t


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all ranges [start, start + length), one after the other."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    full = lengths > 0
    s, n = starts[full], lengths[full]
    if not len(s):
        return out[:0]
    at = np.cumsum(n)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


class Vocabulary:
    """Merges and strings of a byte-level BPE vocabulary with an end-of-word suffix; fixed size, so fit for broadcast."""

    def __init__(self, path: str):
        raw = json.load(open(path, encoding="utf-8"))
        model, vocab = raw["model"], raw["model"]["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.special = [(t["content"], t["id"]) for t in raw["added_tokens"]]
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.uint32) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = (left << np.uint32(16)) | right
        _, first = np.unique(keys[::-1], return_index=True)
        first = len(keys) - 1 - first  # of a pair listed twice the last counts
        self.pairs = HashTable(keys[first], first.astype(np.int32), made[first])
        names = [b""] * (max([*vocab.values(), *(i for _, i in self.special)]) + 1)
        for s, i in [*vocab.items(), *self.special]:
            names[i] = s.encode()
        lengths = np.array([len(x) + 1 for x in names])
        self.name_data = np.frombuffer(b"".join(x + b" " for x in names), np.uint8)
        self.name_at, self.name_len = np.cumsum(lengths) - lengths, lengths

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = self.pairs.get((left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32))
        return np.where(rank < 0, INF, rank), made

    def merge_one(self, symbols: list[int]) -> list[int]:
        """One long word, by a heap of pairs."""
        n = len(symbols)
        sym, after, before, alive = list(symbols), [*range(1, n), -1], list(range(-1, n - 1)), [True] * n
        rank, made = self.rank(np.array(sym[:-1]), np.array(sym[1:]))
        heap = [(int(r), i, sym[i], sym[i + 1], int(m)) for i, (r, m) in enumerate(zip(rank, made, strict=True)) if r != INF]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j], after[i] = new, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0:
                    r, m = self.rank(np.array([sym[x]]), np.array([sym[y]]))
                    if r[0] != INF:
                        heapq.heappush(heap, (int(r[0]), x, sym[x], sym[y], int(m[0])))
        return [s for s, ok in zip(sym, alive, strict=True) if ok]

    def merge(self, data: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words (bytes at[i] .. at[i] + length[i]), flat, and their numbers."""
        counts = np.zeros(len(at), np.int64)
        parts, order = [], []
        bounds = [0, 2, 4, 6, 8, 11, 14, 18, 24, 32, 48, 96]
        for low, high in zip(bounds, bounds[1:], strict=False):
            some = np.flatnonzero((length > low) & (length <= high))
            for k in range(0, len(some), 1 << 15):
                w = some[k : k + (1 << 15)]
                ids, n = self._merge_block(data, at[w], length[w], high)
                counts[w] = n
                parts.append(ids)
                order.append(w)
        for w in np.flatnonzero(length > bounds[-1]):
            b = data[at[w] : at[w] + length[w]]
            ids = self.merge_one([*self.inner[b[:-1]].tolist(), int(self.last[b[-1]])])
            counts[w] = len(ids)
            parts.append(np.array(ids, np.int32))
            order.append(np.array([w]))
        if not parts:
            return np.zeros(0, np.int32), counts
        got, order = np.concatenate(parts), np.concatenate(order)
        ends = np.cumsum(counts[order])
        start = np.empty(len(at), np.int64)
        start[order] = ends - counts[order]
        return got[spread(start, counts)], counts

    def _merge_block(self, data: np.ndarray, at: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n, cols = len(at), np.arange(width)
        pos = np.minimum(at[:, None] + cols, len(data) - 1)
        b = data[pos]
        ends = cols == (length - 1)[:, None]
        sym = np.where(ends, self.last[b], self.inner[b])
        size = length.copy()
        rank, made = np.full((n, width), INF, np.int32), np.zeros((n, width), np.int32)
        r, m = self.rank(sym[:, :-1].ravel(), sym[:, 1:].ravel())
        rank[:, :-1], made[:, :-1] = r.reshape(n, -1), m.reshape(n, -1)
        rank[cols >= (size - 1)[:, None]] = INF
        out_sym = sym.copy()
        rows = np.arange(n)
        while True:
            j = rank.argmin(1)
            k = np.arange(len(rows))
            go = rank[k, j] != INF
            if not go.all():
                out_sym[rows[~go]] = sym[~go]
                rows, sym, rank, made, size_now, j = rows[go], sym[go], rank[go], made[go], size[rows[go]], j[go]
                k = np.arange(len(rows))
            else:
                size_now = size[rows]
            if not len(rows):
                break
            new = made[k, j]
            gap = (cols >= (j + 1)[:, None]).astype(np.int64)
            take = np.minimum(cols + gap, width - 1)
            sym = np.take_along_axis(sym, take, 1)
            sym[k, j] = new
            take = np.minimum(cols + (cols >= j[:, None]), width - 1)
            rank, made = np.take_along_axis(rank, take, 1), np.take_along_axis(made, take, 1)
            rank[:, -1] = INF
            size_now = size_now - 1
            size[rows] = size_now
            inner = np.flatnonzero(j > 0)
            x, y = self.rank(sym[inner, j[inner] - 1], new[inner])
            rank[inner, j[inner] - 1], made[inner, j[inner] - 1] = x, y
            has = j + 1 < size_now
            inner = np.flatnonzero(has)
            x, y = self.rank(new[inner], sym[inner, j[inner] + 1])
            rank[inner, j[inner]], made[inner, j[inner]] = x, y
            inner = np.flatnonzero(~has)
            rank[inner, j[inner]] = INF
        keep = cols < size[:, None]
        return out_sym[keep].astype(np.int32), size


SURROGATES = range(0xD800, 0xE000)


#: In a table of characters: their class, and whether Python doesn't know them, or lower-cases or composes them unlike the library.
CLASS, ODD = 7, 8


@lru_cache(1)
def char_table() -> np.ndarray:
    """By code point, as the library matches them: 0 other, 1 letter, 2 number, 3 white space, plus ODD; places for special tokens follow."""
    from tokenizers import Regex, pre_tokenizers

    kinds = [(k, pre_tokenizers.Split(Regex(x), "removed", invert=True)) for k, x in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+"))]
    out = np.zeros(0x110000 + 2, np.uint8)
    for start in range(0, 0x110000, 1 << 11):  # in parts, to spare the driver's memory
        part = [c for c in range(max(1, start), start + (1 << 11)) if c not in SURROGATES]
        if not part:
            continue
        for k, split in kinds:
            for _, (a, b) in split.pre_tokenize_str("".join(map(chr, part))):
                out[part[a:b]] = k
        known = [c for c in part if unicodedata.category(chr(c)) != "Cn"]
        texts = "\0".join(map(chr, known))
        theirs, ours = (x.split("\0") for x in (library_normalizer().normalize_str(texts), lowered(texts)))
        out[part] |= ODD
        out[[c for c, a, b in zip(known, theirs, ours, strict=False) if a == b or b.isspace()]] &= CLASS
    out[0x110000:] = 4
    return out


@lru_cache(1)
def library_normalizer():
    from tokenizers import Regex, normalizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])


def lowered(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")  # each character by itself: no final sigma
    return text.lower()


def normalized(text: str, table: np.ndarray) -> str:
    """NFC and lower case, as the library makes them; its runs of white space are left to the splitting."""
    if text.isascii() or not (table[np.frombuffer(text.encode("utf-32-le"), np.uint32)] & ODD).any():
        return lowered(text)
    return library_normalizer().normalize_str(text)


class Pieces:
    """The pre-tokens of some texts: bytes, where each begins and ends, and which text it is of."""

    def __init__(self, texts: list[str], special: list[tuple[str, int]], table: np.ndarray):
        parts, marks, at, chars = [], [], [], 0
        split = re.compile("(" + "|".join(re.escape(s) for s, _ in special) + ")") if special else None
        known = {s: i for i, (s, _) in enumerate(special)}
        for t in texts:
            at.append(chars)
            pieces = split.split(t) if split and "<|" in t else [t]
            for p in pieces:
                if p in known and len(pieces) > 1:
                    marks.append((chars, known[p]))
                    p = "\0"
                else:
                    p = normalized(p, table)
                parts.append(p)
                chars += len(p)
            parts.append(" ")
            chars += 1
        joined = "".join(parts)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if marks:
            cp = cp.copy()
            for p, k in marks:
                cp[p] = 0x110000 + k
        kind = table[cp] & CLASS
        self.data = np.frombuffer(joined.encode(), np.uint8)
        if len(self.data) == len(cp):
            byte_at = None
        else:
            plain = np.where(cp < 0x110000, cp, 0)  # a special token holds one byte's place
            size = 1 + (plain > 0x7F) + (plain > 0x7FF).astype(np.int8) + (plain > 0xFFFF)
            byte_at = np.zeros(len(cp) + 1, np.int64)
            np.cumsum(size, out=byte_at[1:])
        start = np.ones(len(cp), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2) | (kind[1:] == 4)
        quote = np.flatnonzero((cp == 0x27) & start)
        if len(quote):
            far = np.concatenate([cp, np.zeros(2, np.uint32)])
            a, b = far[quote + 1], far[quote + 2]
            one = (a == 0x73) | (a == 0x74) | (a == 0x6D) | (a == 0x64)
            two = ((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))
            for hit, n in ((one, 1), (two & ~one, 2)):
                q = quote[hit]
                start[q + 1] = False
                start[q + 1 + n] = True
        edge = np.flatnonzero(start)
        words = kind[edge] != 3
        end = np.append(edge[1:], len(cp))[words]
        self.char_at = edge[words]
        self.char_end = end
        self.mark = np.where(kind[self.char_at] == 4, cp[self.char_at].astype(np.int64) - 0x110000, -1) if marks else None
        self.at = self.char_at if byte_at is None else byte_at[self.char_at]
        self.end = end if byte_at is None else byte_at[end]
        self.text_at = np.array([*at, chars], np.int64)
        self.first = np.searchsorted(self.char_at, self.text_at)  # pieces of text i: first[i] .. first[i + 1]

    def strings(self, which: np.ndarray) -> pa.Array:
        """These pieces, as an Arrow array of bytes."""
        length = (self.end - self.at)[which]
        offsets = np.zeros(len(which) + 1, np.int64)
        np.cumsum(length, out=offsets[1:])
        return pa.Array.from_buffers(pa.large_binary(), len(which), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[spread(self.at[which], length)])])


class Lexicon:
    """A minimal acyclic transducer: sum of outputs along a word's path = its ordinal among the sorted words."""

    def __init__(self, words: list[bytes], vocabulary: Vocabulary):
        words = sorted(set(words))
        # Sorted words are added one by one; states that can no longer change are replaced by an equal one if there is any.
        register: dict[tuple, int] = {}
        trans: list[dict[int, int]] = [{}]
        final: list[bool] = [False]
        path, previous = [0], b""

        def settle(depth: int) -> None:
            while len(path) > depth + 1:
                state = path.pop()
                key = (final[state], tuple(trans[state].items()))
                same = register.setdefault(key, state)
                if same != state:
                    trans[path[-1]][previous[len(path) - 1]] = same
                    trans[state] = None  # nothing leads here any more

        for w in words:
            common = 0
            while common < min(len(w), len(previous)) and w[common] == previous[common]:
                common += 1
            settle(common)
            previous = w
            for b in w[common:]:
                trans.append({})
                final.append(False)
                trans[path[-1]][b] = len(trans) - 1
                path.append(len(trans) - 1)
            final[path[-1]] = True
        settle(0)
        register.clear()
        live, todo = {0: 0}, [0]
        while todo:
            for t in trans[todo.pop()].values():
                if t not in live:
                    live[t] = len(live)
                    todo.append(t)
        below: dict[int, int] = {}
        stack = [(0, False)]
        while stack:
            s, seen = stack.pop()
            if s in below:
                continue
            if seen:
                below[s] = final[s] + sum(below[t] for t in trans[s].values())
            else:
                stack.append((s, True))
                stack += [(t, False) for t in trans[s].values() if t not in below]
        keys, to, outs = [], [], []
        for s, number in live.items():
            passed = int(final[s])
            for b, t in sorted(trans[s].items()):
                keys.append(number << 8 | b)
                to.append(live[t])
                outs.append(passed)
                passed += below[t]
        self.edges = HashTable(np.array(keys, np.uint32), np.array(to, np.int32), np.array(outs, np.int32))
        self.final = np.zeros(len(live), np.uint8)
        for s, number in live.items():
            self.final[number] = final[s]
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words) or b"\0", np.uint8)
        self.ids, counts = vocabulary.merge(data, np.cumsum(lengths) - lengths, lengths)
        self.count = counts.astype(np.int32)
        self.id_at = (np.cumsum(counts) - counts).astype(np.int64)

    def packed(self) -> bytes:
        arrays = [*self.edges.arrays(), self.final, self.ids, self.count, self.id_at]
        head = json.dumps({"probes": self.edges.probes, "arrays": [[a.dtype.str, len(a)] for a in arrays]}).encode()
        return len(head).to_bytes(8, "little") + head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """From a packed file, mapped into memory: processes that map it share its pages."""
        with open(path, "rb") as f:
            memory = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int.from_bytes(memory[:8], "little")
        head, at, arrays = json.loads(memory[8 : 8 + n]), 8 + n, []
        for kind, size in head["arrays"]:
            a = np.frombuffer(memory, np.uint8, size * np.dtype(kind).itemsize, at).view(kind) if size else np.zeros(0, kind)
            arrays.append(a)
            at += a.nbytes + -a.nbytes % 8
        x = cls.__new__(cls)
        x.edges = HashTable.of(arrays[:3], head["probes"])
        x.final, x.ids, x.count, x.id_at = arrays[3:]
        return x

    def find(self, p: Pieces) -> np.ndarray:
        """Each piece's ordinal, or -1. All pieces walk one byte at a time together."""
        found = np.full(len(p.at), -1, np.int32)
        if not len(self.ids):
            return found
        length = p.end - p.at
        live = np.arange(len(p.at))
        state, out = np.zeros(len(live), np.int64), np.zeros(len(live), np.int32)
        step = 0
        while len(live):
            to, plus = self.edges.get((state << 8 | p.data[p.at[live] + step]).astype(np.uint32))
            ok = to >= 0
            live, state, out = live[ok], to[ok].astype(np.int64), out[ok] + plus[ok]
            step += 1
            over = length[live] == step
            end = over & (self.final[state] != 0)
            found[live[end]] = out[end]
            live, state, out = live[~over], state[~over], out[~over]
        return found


class Encoder:
    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None, table: np.ndarray):
        self.vocabulary, self.lexicon, self.table = vocabulary, lexicon, table

    def piece_ids(self, p: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A flat array of ids, and where each piece's ids begin there and how many they are."""
        known = self.lexicon.find(p) if self.lexicon else np.full(len(p.at), -1, np.int32)
        v = self.vocabulary
        begin, count = np.zeros(len(p.at), np.int64), np.zeros(len(p.at), np.int64)
        hit = known >= 0
        pool = [self.lexicon.ids if self.lexicon else np.zeros(0, np.int32)]
        if self.lexicon:
            begin[hit], count[hit] = self.lexicon.id_at[known[hit]], self.lexicon.count[known[hit]]
        rest = ~hit
        if p.mark is not None:
            own = p.mark >= 0
            rest &= ~own
            pool.append(np.array([i for _, i in v.special], np.int32))
            begin[own], count[own] = len(pool[0]) + p.mark[own], 1
        rest = np.flatnonzero(rest)
        if len(rest):
            coded = p.strings(rest).dictionary_encode()
            words = coded.dictionary
            offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
            data = np.frombuffer(words.buffers()[2], np.uint8)
            ids, n = v.merge(data, offsets[:-1], np.diff(offsets))
            which = coded.indices.to_numpy(zero_copy_only=False)
            base = sum(map(len, pool))
            begin[rest], count[rest] = base + (np.cumsum(n) - n)[which], n[which]
            pool.append(ids)
        return np.concatenate(pool), begin, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, flat, and the bounds of each text's."""
        p = Pieces(texts, self.vocabulary.special, self.table)
        pool, begin, count = self.piece_ids(p)
        ends = np.concatenate([[0], np.cumsum(count)])
        return pool[spread(begin, count)], ends[p.first]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Each text's token strings, joined by one space."""
        v = self.vocabulary
        length = v.name_len[ids]
        data = v.name_data[spread(v.name_at[ids], length)].tobytes()
        ends = np.concatenate([[0], np.cumsum(length)])[bounds]
        return [data[a : max(a, b - 1)] for a, b in zip(ends, ends[1:], strict=False)]


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about `limit` characters together, with the first one's place; null is the empty text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield at, [x or "" for x in texts[at : i + 1]]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, [x or "" for x in texts[at:]]


def frequent_words(docs: DataFrame, special: list[tuple[str, int]], text_col: str = "text", limit: int = LEXICON_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """The `limit` most frequent pre-tokens (bytes `word`, `n`), ties by bytes.

    Every document is counted. A partition reports the words it saw `min_count` times or more, so a count is
    short by less than min_count for each partition; only speed depends on this, never a result.
    """

    table = docs.sparkSession.sparkContext.broadcast(char_table())  # of fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: pd.Series | None = None
        pending: list[pd.Series] = []
        for batch in batches:
            for _, texts in slices(batch.column(0).to_pylist(), 1 << 22):
                p = Pieces(texts, special, table.value)
                which = np.arange(len(p.at)) if p.mark is None else np.flatnonzero(p.mark < 0)
                if not len(which):
                    continue
                coded = p.strings(which).dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
                keep = np.flatnonzero(n > 1)
                pending.append(pd.Series(n[keep], coded.dictionary.take(pa.array(keep)).to_pylist()))
                if len(pending) >= 8:
                    total = pd.concat([*pending, *([total] if total is not None else [])]).groupby(level=0).sum()
                    pending = []
                    if len(total) > 16 * limit:
                        total = total.nlargest(8 * limit)
        if pending or total is not None:
            total = pd.concat([*pending, *([total] if total is not None else [])]).groupby(level=0).sum()
            total = total[total >= min_count]
            for k in range(0, len(total), 1 << 16):
                part = total.iloc[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part.index.to_list(), pa.binary()), pa.array(part.to_numpy(), pa.int64())], ["word", "n"])

    counted = docs.select(F.col(text_col)).mapInArrow(count, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(limit)


@lru_cache(4)
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(path)


_workers: dict[str, Encoder] = {}


def worker_encoder(name: str, vocabulary: Vocabulary, table: np.ndarray) -> Encoder:
    """One encoder for each lexicon and Python process."""
    if name not in _workers:
        _workers.clear()
        _workers[name] = Encoder(vocabulary, Lexicon.mapped(SparkFiles.get(name)), table)
    return _workers[name]


def handed_out(spark: SparkSession, packed: bytes) -> str:
    """The name of a file that Spark hands to every executor, those that join later too. The driver's own file goes with the driver."""
    folder = tempfile.mkdtemp(prefix="tidewright-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = f"lexicon-{uuid.uuid4().hex}"
    with open(f"{folder}/{name}", "wb") as f:
        f.write(packed)
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def build_lexicon(spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", limit: int = LEXICON_WORDS) -> bytes:
    """The packed lexicon: at most `limit` words of at most 64 bytes reach the driver."""
    words = frequent_words(docs, vocabulary.special, text_col, limit).filter(F.length("word") <= 64)
    return Lexicon([bytes(r.word) for r in words.select("word").collect()], vocabulary).packed()


def encode_decode(spark: SparkSession, docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS, keep_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Columns: the id column, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids and decoded.
    """
    vocabulary = vocabulary_of(tokenizer_path)
    docs = docs.select(F.col(id_col), F.col(text_col))
    packed = build_lexicon(spark, docs, vocabulary, text_col, lexicon_words)
    shared, name = spark.sparkContext.broadcast((vocabulary, char_table())), handed_out(spark, packed)  # both of bounded size
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(name, *shared.value)
        for batch in batches:
            for at, texts in slices(batch.column(1).to_pylist()):
                ids, bounds = encoder.encode(texts)
                decoded = encoder.decode(ids, bounds)
                raw = ids.astype("<u4")
                each = [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
                out = [
                    batch.column(0).slice(at, len(texts)),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in each]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                ]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    out += [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())), pa.array([x.decode() for x in decoded])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names)

    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")
    return docs.mapInArrow(run, schema)
