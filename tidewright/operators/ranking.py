"""Numbers over a whole table, without a window that holds it."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[Column], out: str = "number", by: tuple[str, ...] = ()) -> DataFrame:
    """`df` with the place of each row, from 1, in the order given; with `by`, its place among the rows of equal `by`.

    Rows are dealt to partitions by ranges of the order; a partition numbers its own rows and adds the rows of
    those before it, of which only the counts, one for each partition, meet in one task. The ranges are kept on the
    executors' disks, since a second sampling could cut them elsewhere; a lost part is cut from the same ranges again.
    The order must be total for reruns to agree.
    """
    parts = df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    counts = counts.select("_part", *[F.col(c).alias(f"_by_{c}") for c in by], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    same = [parts["_part"] == counts["_part"], *[parts[c].eqNullSafe(counts[f"_by_{c}"]) for c in by]]
    found = parts.join(F.broadcast(counts), same).drop(counts["_part"], *[f"_by_{c}" for c in by])  # a row for each partition
    return found.withColumn(out, F.col("_before") + own).drop("_part", "_before")
