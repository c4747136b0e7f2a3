"""Removal of lines that many documents share, over levelled sorted runs of line hashes.

Each row's lines become keys (stripped, A-Z lower-cased) and the keys 128-bit hashes, each once per row. The rows are dealt into
batches. A run is a table of (hash, documents) that is bucketed and sorted by hash, so joins of runs merge bucket by bucket and need no
shuffle. Each new batch is counted by hash, its hashes that a run already knows to be common are taken out by merge-anti-joins, and
what is left becomes a run of level 0. When a level has FANOUT runs they are compacted: merged by hash, counts added, into one run of
the next level. After the last batch all runs are merged, and hashes with enough documents are common.

A common hash isn't counted any further, which changes nothing: its count is large enough already.

Scale: counting combines in each task before rows move, so a line that a third of all documents have costs no task more than its part.
Where rows meet the common hashes, those that had more than 1/HEAVY of the first batch (at most HEAVY, which bounds the broadcast) are
met by broadcast; no other hash holds a large share. What goes back to a document is bounded by its own lines.

Defined results: null text is empty text, one empty line; empty keys are never common; each row is a document of its own, repeated
rows too (rows of equal id and text share one entry, spread by adaptive execution alone); a null id is kept; an empty table gives an
empty result; extra columns don't matter (only id and text are read).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import remove, shared_path, written

LEAST = 10
BATCHES, FANOUT = 4, 2
HEAVY = 4096
WHITE = b" \t\n\v\f\r"


def keys_of(text: bytes) -> list[bytes]:
    """The keys of a text's lines, in order (only A-Z of UTF-8 bytes are lower-cased)."""
    return [x.strip(WHITE) for x in text.lower().split(b"\n")]


def hashed(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [[hashed(x) for x in {*keys_of(t.as_py())} if x] for t in b.column(1)]
        yield pa.record_batch([b.column(0), pa.array(found, pa.list_(pa.binary()))], ["k", "hashes"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_lines, n_dropped, digests, texts = [], [], [], []
        for text, drop in zip(b.column(1), b.column(2), strict=True):
            text, gone = text.as_py(), set(drop.as_py() or ())
            lines = text.split(b"\n")
            if gone:
                kept = [x for x, k in zip(lines, keys_of(text), strict=True) if not k or hashed(k) not in gone]
                text = b"\n".join(kept)
                n_dropped.append(len(lines) - len(kept))
            else:
                n_dropped.append(0)
            n_lines.append(len(lines))
            digests.append(hashlib.sha256(text).hexdigest())
            texts.append(text)
        cols = [b.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())]
        yield pa.record_batch(cols, ["id", "n_lines", "n_dropped", "kept_sha256", "kept"])


class Runs:
    """Levelled sorted runs of (h, n): the number n of documents in which a key of hash h was found."""

    def __init__(self, spark: SparkSession, least: int = LEAST, fanout: int = FANOUT):
        self.spark, self.least, self.fanout = spark, least, fanout
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, df: DataFrame) -> str:
        name = f"tidewright_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.parts, "h").sortBy("h").format("parquet").option("path", shared_path(self.spark, "run")).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        path = self.spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first().data_type
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, path)

    def _compacted(self, names: list[str]) -> str:
        """The runs as one. Two at a time, newest first: both sides are bucketed and sorted by h, so a merge needs no shuffle."""
        while len(names) > 1:
            a, b = names[-2:]
            both = self.spark.table(a).hint("merge").join(self.spark.table(b).withColumnRenamed("n", "m"), "h", "full_outer")
            run = self._write(both.select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")))
            self._drop(a)
            self._drop(b)
            names = [*names[:-2], run]
        return names[0]

    def add(self, hashes: DataFrame) -> str:
        """A batch's hashes, one row (h) for each document and key, as a run; full levels are compacted. Returns the run's name until then."""
        new = hashes.groupBy("h").agg(F.count("*").alias("n"))
        for name in (x for level in self.levels for x in level):
            new = new.hint("merge").join(self.spark.table(name).where(F.col("n") >= self.least).select("h"), "h", "left_anti")
        level, run = 0, self._write(new)
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return run
            full, self.levels[level] = self.levels[level], []
            run = self._compacted(full)
            level += 1

    def common(self) -> DataFrame:
        """(h) found in `least` documents or more, after all runs have become one."""
        run = self._compacted([x for level in reversed(self.levels) for x in level])
        self.levels = [*([] for _ in self.levels[1:]), [run]]
        return self.spark.table(run).where(F.col("n") >= self.least).select("h")

    def close(self) -> None:
        """Removes the runs; nothing that reads them may be used any more."""
        for level in self.levels:
            for x in level:
                self._drop(x)
        self.levels = []


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, batches: int = BATCHES) -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256, kept) of every row; `kept` is the text without its common lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text))))
    rows = docs.select(key.alias("k"), F.col(id_col).alias("id"), text.cast("binary").alias("text"))
    lines = rows.select("k", "text").mapInArrow(_line_hashes, "k binary, hashes array<binary>").withColumn("batch", F.pmod(F.xxhash64("k"), F.lit(batches)).cast("int"))
    path = shared_path(spark, "lines")
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("k binary, hashes array<binary>, batch int").parquet(path)
    pairs, runs = lines.select("k", F.explode("hashes").alias("h"), "batch"), Runs(spark, least)
    try:
        for i in range(batches):
            run = runs.add(pairs.where(F.col("batch") == i).select("h"))
            if i == 0:
                first = spark.table(run)
                total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
                heavy = written(spark, first.where((F.col("n") >= least) & (F.col("n") * HEAVY > total)).select("h"), "heavy")
        common = written(spark, runs.common(), "common")
    finally:
        runs.close()
    pairs = pairs.select("k", "h")
    hot = pairs.join(F.broadcast(heavy), "h", "left_semi")
    rest = pairs.join(F.broadcast(heavy), "h", "left_anti").join(common, "h", "left_semi")
    gone = hot.union(rest).groupBy("k").agg(F.collect_set("h").alias("gone"))
    return rows.join(gone, "k", "left").select("id", "text", "gone").mapInArrow(_kept, docs.select(F.col(id_col).alias("id")).schema.simpleString()[7:-1].replace("id:", "id ") + ", n_lines long, n_dropped long, kept_sha256 string, kept string")
