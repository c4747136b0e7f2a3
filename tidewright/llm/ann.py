"""Approximate nearest neighbours: inverted lists, scanned dimension by dimension.

Vectors are rotated by a fixed random orthogonal matrix, so that any few of the rotated dimensions are a fair
sample of a distance. Within each probed list columns are taken in blocks: after each
block, a hypothesis test on the partial distance (is the whole distance above the query's bound?) drops candidates
early. What is left is measured exactly, in double precision, on the original vectors.

The lists' centres are fitted on at most SAMPLE vectors (least id hashes); every vector is
indexed. How many lists a query probes is set on the same sample, as the least number
that finds TARGET of the true neighbours there by brute force; vectors without any
cluster structure therefore need most lists, clustered ones few.

Scale: a list larger than BLOCK_ROWS is cut into blocks by an id hash, and so are the queries that probe it;
a task holds one block of each. A block gives at most k rows for a query. There are up to MAX_LISTS lists, as many as centres can be
fitted on the sample; beyond LIST_ROWS * MAX_LISTS vectors lists get longer (more blocks, not larger tasks), so work then grows with
queries times rows.

Defined results: null, zero, non-finite vectors and those with null components or of another than the most frequent
length take no part; equal vectors rank by id; of rows with equal ids each is a candidate, and a query's own id is none; a query
row that is repeated is asked once, rows of one id with different vectors are queries of their own; fewer than k candidates
are all returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.common import written

SAMPLE = 20_000
LIST_ROWS, MAX_LISTS = 512, 4096
BLOCK_ROWS, BLOCK_QUERIES = 4096, 8192
TARGET = 0.97
COLUMNS = 16
#: Strength of the test: how many deviations the partial distance must be beyond its bound.
EPSILON = 2.1
SEED = 7


def valid(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def fit(sample: np.ndarray, lists: int, k: int) -> tuple[np.ndarray, int]:
    """Centres by k-means, and the number of lists to probe."""
    centres = sample[np.random.default_rng(SEED).permutation(len(sample))[:lists]].copy()
    for _ in range(8):
        own = np.concatenate([squares(sample[i : i + 4096], centres).argmin(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=lists)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    own = np.concatenate([squares(sample[i : i + 4096], centres).argmin(1) for i in range(0, len(sample), 4096)])
    ask = sample[: min(256, len(sample))]
    away = squares(ask, sample)
    away[np.arange(len(ask)), np.arange(len(ask))] = np.inf
    near = np.argsort(away, 1)[:, : min(k, len(sample) - 1)]
    place = np.argsort(np.argsort(squares(ask, centres), 1), 1)
    at = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    if not len(at):
        return centres, lists
    return centres, int(min(lists, at[min(len(at) - 1, int(np.ceil(TARGET * len(at))))] + 1))


def scan(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, vector's place, distance) of each query's k best in this block."""
    d = queries.shape[1]
    q, v = queries @ turn, vectors @ turn
    step = min(COLUMNS, d)
    out = []
    for a in range(0, len(q), 512):
        part = q[a : a + 512]
        first = squares(part[:, :step], v[:, :step])
        # A bound for each query: the k-th best among those that look best so far.
        some = min(len(v), 4 * k)
        look = np.argpartition(first, some - 1, 1)[:, :some] if some < len(v) else np.tile(np.arange(len(v)), (len(part), 1))
        whole = ((part[:, None, :] - v[look]) ** 2).sum(2)
        whole[ids[look] == query_ids[a : a + 512, None]] = np.inf
        bound = np.sort(whole, 1)[:, min(k, some) - 1] if some >= k else np.full(len(part), np.inf)
        limit = lambda n, which: bound[which] * (n / d) * ((1 + EPSILON / np.sqrt(n)) ** 2 if n < d else 1) * 1.0001 + 1e-5
        i, j = np.nonzero(first <= limit(step, slice(None))[:, None])
        sums = first[i, j]
        for c in range(step, d, COLUMNS):
            e = min(c + COLUMNS, d)
            sums = sums + ((part[i, c:e] - v[j, c:e]) ** 2).sum(1)
            ok = sums <= limit(e, i)
            i, j, sums = i[ok], j[ok], sums[ok]
        own = ids[j] != query_ids[a + i]
        i, j = i[own], j[own]
        exact = np.sqrt(((queries[a + i].astype(np.float64) - vectors[j].astype(np.float64)) ** 2).sum(1))
        order = np.lexsort((ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        head = np.searchsorted(i, i)
        best = np.arange(len(i)) - head < k
        out.append((a + i[best], j[best], exact[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search(spark: SparkSession, vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for the rows whose id is divisible by `every`."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v")).where(valid(F.col("v")) & F.col("id").isNotNull())
    shape = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = shape.d, shape["count"]
    rows = rows.where(F.size("v") == d)
    got = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()  # at most SAMPLE vectors
    sample = np.array(got.v.tolist(), np.float64)
    lists = int(min(MAX_LISTS, max(1, n // LIST_ROWS), len(sample)))
    centres, probes = fit(sample, lists, k)
    shared = spark.sparkContext.broadcast((centres, rotation(d)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value[0]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)
                away = squares(x, c)
                near = np.argsort(away, 1, kind="stable")[:, :probes].astype(np.int32)
                ask = part.column(0).to_numpy() % every == 0
                probed = pa.array([p if a else None for p, a in zip(near.tolist(), ask, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(near[:, 0]), pa.array([r.tobytes() for r in x], pa.binary()), probed], ["id", "list", "v", "probed"])

    indexed = written(spark, rows.select("id", "v").mapInArrow(assign, "id long, list int, v binary, probed array<int>"), "lists")
    # Repeated rows ask the same question: one of them asks it.
    ask = indexed.where("probed is not null").select(F.col("id").alias("query_id"), F.col("v").alias("qv"), "probed").dropDuplicates(["query_id", "qv"]).select("query_id", "qv", F.explode("probed").alias("to"))
    sizes = indexed.groupBy("list").agg(F.count("*").alias("n"))
    asked = ask.groupBy(F.col("to").alias("list")).agg(F.count("*").alias("m"))
    cuts = F.broadcast(sizes.join(asked, "list").select("list", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("parts"), F.ceil(F.col("m") / BLOCK_QUERIES).cast("int").alias("shares")))  # at most MAX_LISTS rows
    each = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    held = indexed.select("id", "v", "list").join(cuts, "list").withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int")).select("id", "v", "list", "part", each("shares").alias("share"))
    cut = cuts.select(F.col("list").alias("to"), F.col("parts").alias("to_parts"), F.col("shares").alias("to_shares"))
    ask = ask.join(F.broadcast(cut), "to").withColumn("to_share", F.pmod(F.xxhash64("query_id", "qv"), F.col("to_shares")).cast("int")).select("query_id", "qv", "to", "to_share", each("to_parts").alias("to_part"))

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "asked": []})
        x, y = (np.frombuffer(b"".join(t), np.float64).reshape(-1, d) for t in (left.qv, right.v))
        turn = shared.value[1].astype(np.float64)
        i, j, score = scan(x, left.query_id.to_numpy(), y, right.id.to_numpy(), turn, k)
        return pd.DataFrame({"query_id": left.query_id.to_numpy()[i], "vec_id": right.id.to_numpy()[j], "score": score, "asked": pd.util.hash_array(left.qv.to_numpy()[i]).view(np.int64)})

    found = ask.groupBy("to", "to_part", "to_share").cogroup(held.groupBy("list", "part", "share")).applyInPandas(probe, "query_id long, vec_id long, score double, asked long")
    best = Window.partitionBy("query_id", "asked").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
