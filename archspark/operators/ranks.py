"""Gapless ranks of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut

#: Runs of rows (part, group) that may be broadcast.
FEW = 100_000


def ranked(rows: DataFrame, group: str, order: list[str], out: str = "rank") -> DataFrame:
    """rows with ``out``, the place from 1 of each in its group by ``order`` (of rows that tie, any one first).

    Rows are dealt by ranges of (group, order) and stored in order with their place in the part; counts of each part and group
    give where a part begins. A group may be most of the rows: none is sorted in one task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    placed = cut(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))  # the id has the part above the place
    runs = placed.groupBy("__part", F.col(group).alias("__group")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    runs = cut(runs.select(F.col("__part").alias("__p"), "__group", (F.coalesce(before, F.lit(0)) - F.col("__first") + 1).alias("__shift")), "runs")
    same = (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__group"))
    return placed.join(F.broadcast(runs) if runs.count() <= FEW else runs, same).select(*rows.columns, (F.col("__at") + F.col("__shift")).cast("int").alias(out))
