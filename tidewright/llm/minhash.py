"""Near-duplicate classes by improved consistent weighted sampling.

A text's features are its five-word shingles, weighted by sublinear term
frequency times a smoothed inverse document frequency. Consistent weighted
samples of the features are banded; texts that share a band meet a leader of
their bucket, and a pair counts only when its exact weighted Jaccard similarity
reaches the threshold. Linked texts form classes.

Scale: exact copies collapse to one node first; a bucket of m texts makes m - 1
pairs with its leader first; what that joins into one class is not compared again. Texts outside a bucket's
largest class then meet a few of that class, and those still outside meet their whole
bucket: pair by pair in small buckets, by pairs of blocks within a task in large ones, where only links
leave the task. So no two texts of different classes in one bucket stay uncompared; the price is that in such a bucket each text
outside its largest class is copied once for each block of ALL_BLOCK texts. A pair's samples are compared before its texts are fetched.
A bucket, a class, a hub of links or a group of equal texts may hold any share of the rows: what belongs to its key is joined
to its rows by way of `salts` parts (see `attached`), so no task holds more than its part. Document frequencies are kept in a hashed table of
fixed size over all documents: a document adds a bounded number of shingles, so
the table's error relative to the number of documents does not grow with it.

Defined results: null text is empty text; texts without words are linked only to
equal texts; a text of fewer than five words is one shingle; rows with equal
texts share a class, repeated rows included; a null id is kept and ranks after
all others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import shared_path, written

WORDS = 5
THRESHOLD = 0.8
#: Samples of a text; they are cut into bands as the threshold needs.
SAMPLES = 64
#: Counters of the document-frequency table, rows of the table of random numbers.
DF_SLOTS, RANDOM_ROWS = 1 << 16, 1 << 13
#: idf = 1 + ln((1 + SMOOTH) / (df / N + SMOOTH)): mild, so that 0.8 keeps its meaning within large groups of copies.
SMOOTH = 3.0
SLICE_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def banding(threshold: float) -> tuple[int, int, int]:
    """(bands, rows of each, least samples in common) for a threshold.

    Rows are the most (up to 4) with which a pair at the threshold shares a band but for a chance of 1 in 1,000. Four deviations below
    the threshold, a chance of 1 in 20,000 at 0.8, pairs aren't compared exactly.
    """
    rows = next((r for r in (4, 3, 2) if (1 - threshold**r) ** (SAMPLES // r) <= 1e-3), 1)
    return SAMPLES // rows, rows, int(SAMPLES * threshold - 4 * (SAMPLES * threshold * (1 - threshold)) ** 0.5)


def attached(rows: DataFrame, keys: list[str], values: DataFrame, part: str, salts: int, how: str = "inner") -> DataFrame:
    """`rows` joined with the few rows that `values` has for each key, a key's rows dealt over `salts` parts by the column `part`.

    First each (key, part) that occurs, at most `salts` for a key, meets the values; then the rows meet their (key, part).
    """
    if salts == 1:
        return rows.join(values, keys, how)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(part), F.lit(salts)))
    return dealt.join(dealt.select(*keys, "_salt").distinct().join(values, keys, how), [*keys, "_salt"]).drop("_salt")


def salts_of(spark: SparkSession) -> int:
    """Parts of a key: so many that one that has a third of all rows is as small as a task's share of the rest."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    out = []
    for base in (_P, inverse):
        a = np.full(n, base, np.uint64)
        a[0] = 1
        out.append(np.cumprod(a))
    return out[0], out[1]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each lower-cased word and the bounds of each text's words, without a loop over words."""
    texts = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = at[:-1][at[:-1] < len(data)]
    first[cut] = inside[cut]
    start = np.flatnonzero(first)
    stop = np.zeros(len(data) + 1, bool)
    stop[1:] = inside
    stop[1:-1] &= ~inside[1:] | first[1:]
    end = np.flatnonzero(stop)
    up, down = _powers(max(1 << 21, 1 << (len(data) + 1).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), np.searchsorted(start, at)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, term frequency), sorted, each shingle of a text once."""
    h, at = word_hashes(texts)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    end = at[1:][doc]
    i = np.arange(len(h))
    value = np.zeros(len(h), np.uint64)
    for k in range(WORDS):
        j = i + k
        ok = j < end
        value[ok] += h[j[ok]] * _STEPS[k]
    use = (i + WORDS <= end) | ((n[doc] < WORDS) & (i == at[:-1][doc]))
    doc, value = doc[use], mixed(value[use])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    head = np.flatnonzero(new)
    return doc[head], value[head], np.diff(np.append(head, len(doc)))


def weights(value: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return ((1 + np.log(tf)) * idf[(value >> np.uint64(48)).astype(np.int64)]).astype(np.float32)


@lru_cache(1)
def _random(samples: int) -> tuple[np.ndarray, ...]:
    g = np.random.Generator(np.random.PCG64(20240607))
    shape = (RANDOM_ROWS, samples)
    r = g.gamma(2.0, 1.0, shape).astype(np.float32).clip(1e-4)
    c = np.log(g.gamma(2.0, 1.0, shape).clip(1e-9)).astype(np.float32)
    beta = g.random(shape).astype(np.float32)
    return r, (1 / r).astype(np.float32), beta, c


def samples(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n_docs: int, block: int = 4096) -> np.ndarray:
    """Each text's consistent weighted samples: a 32-bit print of (shingle, quantised weight) for each of them.

    For shingle x of weight S: t = floor(ln S / r + b), ln a = ln c - r * (t - b + 1); the least a wins.
    """
    k = SAMPLES
    r, inverse, beta, c = _random(k)
    row = (value & np.uint64(RANDOM_ROWS - 1)).astype(np.int64)
    low = ((value >> np.uint64(13)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    log = np.log(weight).astype(np.float32)
    owners, least = [], []
    for a in range(0, len(doc), block):
        b = min(a + block, len(doc))
        at = row[a:b]
        rr, bb = r[at], beta[at]
        t = np.floor(log[a:b, None] * inverse[at] + bb)
        key = c[at] - rr * (t - bb + 1) + np.float32(256)
        np.maximum(key, 0, out=key)
        mark = low[a:b, None] ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
        whole = (key.view(np.uint32).astype(np.uint64) << np.uint64(32)) | mark
        d = doc[a:b]
        heads = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        least.append(np.minimum.reduceat(whole, heads, axis=0))
        owners.append(d[heads])
    out = np.full((n_docs, k), np.iinfo(np.uint64).max, np.uint64)
    for d, x in zip(owners, least, strict=True):
        out[d] = np.minimum(out[d], x)
    return (out & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def text_slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about SLICE_BYTES of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES)) + 1
        yield batch.slice(at, to - at)
        at = to


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and `th`, a 128-bit key of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.unhex(F.md5(text)).alias("th"))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents have a shingle of each slot, and how many documents there are; all of them are counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DF_SLOTS, np.int64), 0
        for batch in batches:
            for part in text_slices(batch, 0):
                n += part.num_rows
                _, value, _ = shingles(part.column(0))
                total += np.bincount((value >> np.uint64(48)).astype(np.int64), minlength=DF_SLOTS)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.append(total, n)])], ["counts"])

    sums = docs.select("text").mapInArrow(count, "counts array<long>").select(F.posexplode("counts").alias("slot", "n")).groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros(DF_SLOTS + 1, np.int64)
    for slot, n in sums.toPandas().itertuples(index=False):  # DF_SLOTS + 1 rows, whatever the input
        out[slot] = n
    return out[:-1], int(out[-1])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    df, n = document_frequencies(docs)
    return (1 + np.log((1 + SMOOTH) / (np.minimum(df / max(n, 1), 1) + SMOOTH))).astype(np.float32)


def signatures(spark: SparkSession, docs: DataFrame, idf: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """(id, th, marks, bands) of every row; bands is null for a text without words."""
    shared = spark.sparkContext.broadcast(idf)
    n_bands, n_rows, _ = banding(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1):
                doc, value, tf = shingles(part.column(1))
                marks = samples(doc, value, weights(value, tf, shared.value), part.num_rows)
                got = marks[:, : n_bands * n_rows].reshape(part.num_rows, n_bands, n_rows)
                key = np.zeros((part.num_rows, n_bands), np.uint64)
                for k in range(n_rows):
                    key = mixed(key * _P + got[:, :, k].astype(np.uint64) + np.uint64(1))
                some = np.zeros(part.num_rows, bool)
                some[doc] = True
                bands = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * n_bands, pa.int32()), pa.array(key.view(np.int64).ravel()), mask=pa.array(~some))
                marks = pa.array([x.tobytes() for x in marks], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), marks, bands], ["id", "th", "marks", "bands"])

    return docs.select("id", "text", "th").mapInArrow(run, "id long, th binary, marks binary, bands array<long>")


def similar(spark: SparkSession, pairs: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Of pairs (a, b, text_a, text_b) those (a, b) whose weighted Jaccard similarity reaches the threshold."""
    shared = spark.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 2):
                sides = [(d, v, weights(v, tf, shared.value)) for d, v, tf in (shingles(part.column(i)) for i in (2, 3))]
                total = sum(np.bincount(d, w, part.num_rows) for d, _, w in sides)
                d, v, w = (np.concatenate(x) for x in zip(*sides, strict=True))
                order = np.lexsort((v, d))
                d, v, w = d[order], v[order], w[order]
                both = np.flatnonzero((d[1:] == d[:-1]) & (v[1:] == v[:-1]))
                common = np.bincount(d[both], np.minimum(w[both], w[both + 1]), part.num_rows)
                yield part.select([0, 1]).filter(pa.array(common >= threshold * (total - common) - 1e-6))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of edges (a, b); label is the least node. Alternates large and small stars until nothing changes."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    state, salts = None, salts_of(spark)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = attached(both.where("v > u"), ["u"], low, "v", salts).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = written(spark, small, "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label"))


def alike(pairs: DataFrame, least: int) -> DataFrame:
    """Of pairs (a, b, marks_a, marks_b) those (a, b) with at least `least` samples in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(1) >= least))

    return pairs.select("a", "b", "marks_a", "marks_b").mapInArrow(run, "a binary, b binary")


#: Leaders of a bucket in the second turn; texts of a bucket that is compared by blocks in the third, and the blocks' sizes.
LEADERS = 4
#: A text in more than 1 / MANY of a turn's pairs is dealt by parts.
MANY = 1024
LARGE = 64
OUT_BLOCK, ALL_BLOCK = 512, 1024


def crossed(spark: SparkSession, rows: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Links (a, b) between the texts outside and all texts of a bucket, by pairs of blocks.

    `rows` has band, key, ob, cb (the pair of blocks), out, th, label and text. A task holds one pair of blocks, takes the
    similarity of all their texts as sums over shared shingles, and returns only the links between classes.
    """
    shared = spark.sparkContext.broadcast(idf)

    def run(table: pa.Table) -> pa.Table:
        out = table["out"].to_numpy(zero_copy_only=False).astype(bool)
        th, label = table["th"].to_pylist(), table["label"].to_pylist()
        doc, value, tf = shingles(table["text"].combine_chunks())
        # The n-th occurrence of a shingle in a text is a feature of its own, so that shared weight is a plain product.
        level = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
        row, shingle = np.repeat(doc, tf), np.repeat(value, tf)
        gain = np.where(level > 0, np.log((level + 1) / np.maximum(level, 1)), 1.0) * shared.value[(shingle >> np.uint64(48)).astype(np.int64)]
        total = np.bincount(row, gain, len(th))
        _, column, n = np.unique(mixed(shingle + level.astype(np.uint64) * _P), return_inverse=True, return_counts=True)
        new = np.cumsum(n > 1) - 1
        use = n[column] > 1
        row, column, gain = row[use], new[column[use]], gain[use]
        order = np.argsort(column, kind="stable")
        row, column, gain = row[order], column[order], gain[order]
        place = np.zeros(len(th), np.int64)
        place[out], place[~out] = np.arange(out.sum()), np.arange((~out).sum())
        common = np.zeros((int(out.sum()), int((~out).sum())), np.float32)
        width = 2048
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            i, j = np.searchsorted(column, [c, c + width])
            r, k, g = row[i:j], column[i:j] - c, gain[i:j]
            x, y = np.zeros((common.shape[0], width), np.float32), np.zeros((common.shape[1], width), np.float32)
            o = out[r]
            x[place[r[o]], k[o]] = g[o]
            y[place[r[~o]], k[~o]] = 1
            common += x @ y.T
        whole = total[out][:, None] + total[~out][None] - common
        i, j = np.nonzero(common >= threshold * whole - 1e-4)
        left, right = np.flatnonzero(out)[i], np.flatnonzero(~out)[j]
        links = [(min(th[p], th[q]), max(th[p], th[q])) for p, q in zip(left, right, strict=True) if label[p] != label[q]]
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([x for _, x in links], pa.binary())})

    return rows.groupBy("band", "key", "ob", "cb").applyInArrow(run, "a binary, b binary")


def classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, th, class_th, class_id) of every row: class_id is the least id of the class, class_th the key of its text."""
    rows = keyed(docs, id_col, text_col)
    idf = inverse_frequencies(rows)
    salts, common = salts_of(spark), banding(threshold)[2]
    signed = written(spark, signatures(spark, rows, idf, threshold), "signatures")
    nodes = signed.groupBy("th").agg(F.min("id").alias("id"), F.first("marks").alias("marks"), F.first("bands").alias("bands"))
    slots = nodes.where("bands is not null").select("th", F.posexplode("bands").alias("band", "key"))
    sizes = slots.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = written(spark, attached(slots, ["band", "key"], sizes, "th", salts).select("band", "key", "th", "n"), "buckets")
    wanted = written(spark, buckets.select("th").distinct().join(nodes.select("th", "id", "marks"), "th"), "wanted")
    keys = wanted.select(F.col("th").alias("key_th"), F.col("id").alias("key_id"))
    texts = written(spark, rows.join(keys, (rows.th == keys.key_th) & rows.id.eqNullSafe(keys.key_id)).select("th", "text").dropDuplicates(["th"]), "texts")
    labels: DataFrame | None = None
    links: list[str] = []

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar. The leader of a large bucket is in all of its pairs: what belongs to such a text goes to its pairs by parts."""
        pairs = written(spark, pairs.distinct(), "pairs")
        most = max(LARGE, pairs.count() // MANY)
        # At most 2 * MANY texts, which bounds the broadcast.
        hubs = pairs.select(F.explode(F.array("a", "b")).alias("hub")).groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") > most).select("hub", F.lit(salts).alias("parts"))
        hubs = written(spark, hubs, "hubs")
        some = not hubs.isEmpty()
        hubs = F.broadcast(hubs)

        def with_both(rows: DataFrame, values: DataFrame, value: str) -> DataFrame:
            if not some:  # no text is dealt by parts: six joins less in the driver's plans
                for x in "ab":
                    rows = rows.join(values.select(F.col("th").alias(x), F.col(value).alias(f"{value}_{x}")), x)
                return rows
            dealt = values.select("th", value).join(hubs, F.col("th") == F.col("hub"), "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
            for x, y in ("ab", "ba"):
                part = F.pmod(F.xxhash64(y), F.coalesce(F.col("parts"), F.lit(1))).cast("int").alias("part")
                rows = rows.join(hubs, F.col(x) == F.col("hub"), "left").select(*rows.columns, part)
                rows = rows.join(dealt.select(F.col("th").alias(x), "part", F.col(value).alias(f"{value}_{x}")), [x, "part"]).drop("part")
            return rows

        close = written(spark, alike(with_both(pairs, wanted, "marks"), common), "close")
        return similar(spark, with_both(close, texts, "text"), idf, threshold)

    for turn in range(3):
        if labels is None:
            now = buckets.withColumn("label", F.col("th"))
        else:
            now = buckets.join(labels, buckets.th == labels.node, "left").select("band", "key", "th", "n", F.coalesce("label", "th").alias("label"))
        if turn:
            now = written(spark, now, "labelled")  # read twice
        pair = [F.least("th", "lead").alias("a"), F.greatest("th", "lead").alias("b")]
        if turn == 0:
            leaders = now.groupBy("band", "key").agg(F.min("th").alias("lead"))
            found = verified(attached(now, ["band", "key"], leaders, "th", salts).where("th <> lead").select(*pair))
        else:
            # A bucket is open while its texts are of two classes or more. Each pair of two classes has a text outside the largest.
            parts = now.groupBy("band", "key", "label").agg(F.count("*").alias("of_label"))
            most = parts.groupBy("band", "key").agg(F.max(F.struct("of_label", "label")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("band", "key", F.col("most.label").alias("largest"))
            now = written(spark, attached(now, ["band", "key"], most, "th", salts).withColumn("out", F.col("label") != F.col("largest")), "open")
            if now.isEmpty():
                break
            if turn == 1:
                part = F.pmod(F.xxhash64("th"), F.lit(LEADERS)).alias("part")
                leaders = now.where("not out").groupBy("band", "key", part).agg(F.min("th").alias("lead"))
                found = verified(attached(now.where("out"), ["band", "key"], leaders, "th", salts).select(*pair))
            else:
                leaders = now.where(f"out and n <= {LARGE}").select("band", "key", F.col("th").alias("lead"), F.col("label").alias("lead_label"))
                found = verified(now.join(leaders, ["band", "key"]).where("label <> lead_label").select(*pair))
                large = now.where(f"n > {LARGE}")
                cuts = large.groupBy("band", "key").agg(F.ceil(F.count_if("out") / OUT_BLOCK).alias("obs"), F.ceil(F.count("*") / ALL_BLOCK).alias("cbs"))
                large = attached(large, ["band", "key"], cuts, "th", salts).join(texts, "th")
                h, every = F.xxhash64("th"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
                outside = large.where("out").withColumn("ob", F.pmod(h, F.col("obs"))).withColumn("cb", every("cbs"))
                inside = large.withColumn("out", F.lit(False)).withColumn("cb", F.pmod(h, F.col("cbs"))).withColumn("ob", every("obs"))
                cols = ["band", "key", "ob", "cb", "out", "th", "label", "text"]
                found = found.union(crossed(spark, outside.select(*cols).union(inside.select(*cols)), idf, threshold))
        path = shared_path(spark, "links")
        found.write.parquet(path)
        links.append(path)
        if not spark.read.schema("a binary, b binary").parquet(path).isEmpty():
            labels = components(spark, spark.read.schema("a binary, b binary").parquet(*links))
    # Classes of texts first, a row for each text; then of rows.
    found = nodes.select("th", "id")
    if labels is None:
        found = found.withColumn("class_th", F.col("th"))
    else:
        found = found.join(labels, found.th == labels.node, "left").select("th", "id", F.coalesce("label", "th").alias("class_th"))
    least = found.groupBy("class_th").agg(F.min("id").alias("class_id"))
    found = attached(found.drop("id"), ["class_th"], least, "th", salts)
    return attached(signed.select("id", "th"), ["th"], found, "id", salts).select("id", "th", "class_th", "class_id")


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One whole row of each class: that of the least id (among its rows, of the least text key)."""
    found = classes(spark, docs, id_col, text_col)
    kept = found.where(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("class_th").agg(F.first("id").alias("kept_id"), F.min("th").alias("kept_th")).select("kept_id", "kept_th")
    key = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).cast("long").alias("row_id"), key.alias("row_th"))
    joined = rows.join(kept, (rows.row_th == kept.kept_th) & rows.row_id.eqNullSafe(kept.kept_id))
    return joined.dropDuplicates(["row_th", "row_id"]).select("row.*")
