"""Keyed rows from batches of events, told on as signed changes, and logs of signed rows.

``changes`` compares the newest event of each key in a batch with what a log holds for these keys: an event takes back what its
key had (sign -1) and adds what it says (sign 1). The newest is that with the largest place (``seq``), of equal ones a row before a
deletion and then the row with the larger values, so that the order of arrival does not matter: late events change nothing,
repeated ones neither. A deletion is held too, so that what was said before it stays deleted, however late it comes.

``Log`` keeps signed sums by batch: batch n is a segment, and ``FAN`` segments of one size are merged into one when the last of
them is there, so that a state is read from at most ``FAN - 1`` segments a size and each row is written again once a size.
A batch that runs again writes its own segments again. What neither the last state nor the one before it needs is removed.

All of it is joins and aggregates: a Python state function costs some 4 ms a key, which is what a scan of thousands of rows does.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 8


def covering(n: int) -> list[tuple[int, int]]:
    """The segments (first, last batch) that together are batches 0 to n, large ones first."""
    out, at, rest = [], 0, n + 1
    while rest > 0:
        size = 1
        while size * FAN <= rest:
            size *= FAN
        out.append((at, at + size - 1))
        at, rest = at + size, rest - size
    return out


def completed(n: int) -> list[tuple[int, int]]:
    """Segments of more than one batch that end with batch n, small ones first."""
    out, size = [], FAN
    while (n + 1) % size == 0:
        out.append((n - size + 1, n))
        size *= FAN
    return out


@dataclass(frozen=True)
class Log:
    """Sums by keys in a folder; schema: that of keys and sums. Rows whose sums are all 0 are not there."""

    path: str
    keys: tuple[str, ...]
    sums: tuple[str, ...]
    schema: str

    def _segment(self, first: int, last: int) -> str:
        return f"{self.path}/segment={first}-{last}"

    def _summed(self, rows: DataFrame) -> DataFrame:
        sums = rows.groupBy(*self.keys).agg(*[F.sum(c).cast("long").alias(c) for c in self.sums])
        return sums.where(reduce(or_, [F.col(c) != 0 for c in self.sums]))

    def _read(self, spark: SparkSession, segments: list[tuple[int, int]]) -> DataFrame:
        return spark.read.schema(self.schema).parquet(*[self._segment(*s) for s in segments])

    def read(self, spark: SparkSession, n: int, only: DataFrame | None = None) -> DataFrame:
        """The sums after batch n, the last or the one before it, where the columns of only have its values; nothing before the first."""
        if n < 0:
            return spark.createDataFrame([], self.schema)
        rows = self._read(spark, covering(n))
        if only is not None:
            rows = rows.join(only.select(*[F.col(c).alias(f"__{c}") for c in only.columns]), reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in only.columns]), "left_semi")
        return self._summed(rows)

    def batch(self, spark: SparkSession, n: int) -> DataFrame:
        """What batch n alone has changed."""
        return self._read(spark, [(n, n)])

    def write(self, rows: DataFrame, n: int) -> None:
        """Adds batch n, all of whose predecessors are there, and merges what it completes."""
        spark = rows.sparkSession
        self._summed(rows).write.mode("overwrite").parquet(self._segment(n, n))
        for first, last in completed(n):
            part = (last - first + 1) // FAN
            inner = [(at, at + part - 1) for at in range(first, last + 1, part)]
            self._summed(self._read(spark, inner)).write.mode("overwrite").parquet(self._segment(first, last))
        self._expire(spark, {*covering(n), *covering(n - 1), (n, n)})

    def _expire(self, spark: SparkSession, needed: set[tuple[int, int]]) -> None:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/segment=*")
        files = where.getFileSystem(conf)
        for s in files.globStatus(where) or []:
            m = re.search(r"segment=(\d+)-(\d+)$", str(s.getPath()))
            if m and (int(m[1]), int(m[2])) not in needed:
                files.delete(s.getPath(), True)


def changes(events: DataFrame, log: Log, keys: list[str], n: int) -> DataFrame:
    """Batch n's changes of log, whose keys are columns of events, ``live`` and ``seq``, and which sums ``sign``.

    events: rows with ``deleted`` (null: false) and ``seq`` (null: before all others); a deleted row's values are null. A null key is a key.
    """
    values = [c for c in log.keys if c not in (*keys, "seq", "live")]
    live = ~F.coalesce(F.col("deleted"), F.lit(False))
    state = F.struct(F.coalesce(F.col("seq"), F.lit(-(1 << 63))).alias("seq"), live.alias("live"), *[F.when(live, F.col(c)).alias(c) for c in values])
    new = events.groupBy(*keys).agg(F.max(state).alias("new"))
    held = log.read(events.sparkSession, n - 1, events.select(*keys).distinct())
    held = held.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct("seq", "live", *values).alias("held"))
    both = new.join(held, reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left").where("held is null or new > held")
    signed = F.array(F.struct(F.col("held").alias("r"), F.lit(-1).cast("long").alias("sign")), F.struct(F.col("new").alias("r"), F.lit(1).cast("long").alias("sign")))
    told = both.select(*keys, F.explode(signed).alias("x")).where("x.r is not null")
    return told.select(*keys, *[F.col(f"x.r.{c}").alias(c) for c in ("seq", "live", *values)], "x.sign")
