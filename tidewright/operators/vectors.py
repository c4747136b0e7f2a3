"""Queries against all rows by dot product, blocks against blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.recovery import spread
from tidewright.sources.shared import written

#: Rows and queries of a block.
ROWS, QUERIES = 4096, 512
BLOCK = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def packed(v: DataFrame, most: int) -> DataFrame:
    """Rows (vec_id, embedding) as blocks (dim, ids, vectors) of at most `most` rows of one length; a row with a null has no score and is left out."""
    whole = v.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, flat = b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy(zero_copy_only=False), b.column(1).flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == dim)
                for k in range(0, len(at), most):
                    own = at[k : k + most]
                    rows = flat[starts[own][:, None] + np.arange(dim)]
                    yield pa.RecordBatch.from_pylist([{"dim": dim, "ids": ids[own].tobytes(), "vectors": rows.tobytes()}], schema=BLOCK)

    return whole.mapInArrow(run, "dim int, ids binary, vectors binary")


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, least: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of a block of queries and one of rows: of each query, scores above `least` that are among the `most` best, and some more.

    Products of matrices only tell which rows may be among them, with room for their rounding; scores are sums in the order of the components.
    """
    dim = q.shape[1]
    with np.errstate(all="ignore"):
        about = (q @ v.T + 1) / 2
        room = 4 * dim * np.finfo(float).eps * (1 + np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)).max(axis=1, keepdims=True))
        # Where something isn't finite, or ids come twice, every row is looked at.
        plain = bool(np.isfinite(about).all() and np.isfinite(room).all() and len(np.unique(ids)) == len(ids))
        own = q_ids[:, None] == ids[None, :]
        if plain:
            about[own] = -np.inf
            may = about > least - room
            if len(ids) > most:
                may &= about >= np.partition(about, len(ids) - most, axis=1)[:, len(ids) - most, None] - 2 * room
        else:
            may = ~own
        i, j = np.nonzero(may)
        score = np.zeros(len(i))
        for k in range(dim):
            score = score + v[j, k] * q[i, k]
        score = (score + 1) / 2
        kept = ~(score <= least)  # as in Spark, NaN is above all
    return q_ids[i[kept]], ids[j[kept]], score[kept]


def best_in_blocks(v: DataFrame, queries: str | Column, least: float, distance: int, keep: int) -> DataFrame:
    """(query_id, vec_id, score) of rows (vec_id, embedding) against the queries among them: all that count where the best `keep` rows, whose ids keep their `distance`, are sought.

    Each row that is taken rules out the ids nearer than `distance`, so those taken are among the best 1 + (keep - 1) * (2 * distance - 1) ids of a query, and among as many
    of each block. Every row is scored; work is that of queries times rows, a task holds one block of each.
    """
    most = 1 + (keep - 1) * (2 * distance - 1)
    rows = spread(written(packed(v, ROWS), "rows"))
    asked = written(packed(v.where(queries), QUERIES), "queries").select(*[F.col(c).alias(f"q_{c}") for c in BLOCK.names])
    pairs = rows.hint("shuffle_replicate_nl").crossJoin(asked).where("dim = q_dim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                p = {c: b.column(c)[k].as_py() for c in b.schema.names}
                ids, q_ids = (np.frombuffer(p[c], np.int64) for c in ("ids", "q_ids"))
                block, q = (np.frombuffer(p[c]).reshape(-1, p["dim"]) for c in ("vectors", "q_vectors"))
                yield pa.RecordBatch.from_arrays(list(map(pa.array, best(q_ids, q, ids, block, least, most))), schema=FOUND)

    return pairs.mapInArrow(run, "query_id long, vec_id long, score double")
