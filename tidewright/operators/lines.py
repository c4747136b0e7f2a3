"""Operators on lines of text with times: nearby events, merged timelines, filled labels, shared indices, roles of alternatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators import intervals as iv


def best_nearby(rows: DataFrame, events: DataFrame, keys: list[str], radius: int, score: Column, weight: float = 0.035, longest: float = 5.0, unit: float = 1.0) -> DataFrame:
    """Each row (id, start, end) with the best of the events (event_id, at) within `radius` of it, by score less `weight` for each unit of distance.

    Ties go to the greater score, then to the lesser event id. Both sides are dealt to time buckets of the radius' width.
    """
    a = rows.withColumn("l_start", F.col("start") - radius).withColumn("l_end", F.col("end") + radius)
    b = events.withColumn("r_start", F.col("at")).withColumn("r_end", F.col("at"))
    near = iv.overlap_join(a, b, keys, 2 * radius, strict=False)
    away = F.least(F.abs(F.col("at") - F.col("start")) / unit, F.lit(longest))
    near = near.withColumn("score", score).withColumn("objective", F.col("score") - weight * away)
    best = F.max_by(F.struct("event_id", "score", "objective"), F.struct("objective", "score", -F.col("event_id"))).alias("b")
    return near.groupBy(*keys, "id").agg(best).select(*keys, "id", "b.*")


def merged(lines: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Lines of equal keys (their index and text among them) that lie within `gap` of each other become one, from the first start to the last end."""
    return iv.coalesced(lines, keys, gap=gap)


def filled(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """Missing labels take the one before them, at the beginning the one after; `run` numbers runs of equal labels."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.last(label, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(label, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return iv.runs(df.withColumn(label, F.coalesce(before, after)), keys, order, F.col(label))


def shared_with_next(df: DataFrame, keys: list[str], order: list[str], indices: str, gap: int) -> DataFrame:
    """Rows that share indices with the next row, which starts at most `gap` after their end: both ids and what they share."""
    w = Window.partitionBy(*keys).orderBy(*order)
    nxt = F.lead(F.struct("id", "start", indices)).over(w)
    j = df.withColumn("_next", nxt).where(F.col("_next.start") - F.col("end") <= gap)
    return j.withColumn("shared", F.array_sort(F.array_intersect(indices, f"_next.{indices}"))).where(F.size("shared") > 0).select(*keys, "id", F.col("_next.id").alias("next_id"), "shared")


def alternative_roles(lines: DataFrame, keys: list[str], metadata: Column, native: Column) -> DataFrame:
    """`role` of lines of equal keys: metadata; the original, if one line is left or one of those left is native; else unknown."""
    w = Window.partitionBy(*keys)
    rest = ~metadata
    left, natives = F.count_if(rest).over(w), F.count_if(rest & native).over(w)
    return lines.withColumn("role", F.when(metadata, "metadata").when((left == 1) | (native & (natives == 1)), "original").otherwise("unknown"))
