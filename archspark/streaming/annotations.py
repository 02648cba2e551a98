"""The annotations that hold, kept up to date from a stream of additions.

A micro-batch is a log like any other; what held before is a log as well, with lower
sequence numbers. Targets are dealt to ``BUCKETS`` by a hash. A batch reads and writes only
the buckets that it adds to, each as ``version=<batch>/bucket=<n>``, beside earlier versions:
a batch that is run again replaces only what it wrote itself. When a batch is done, versions
that neither it nor the batch before it needs are removed, so that the folder holds each
bucket twice at most and the last two states can be read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.views import ANNOTATION, current_annotations, target_key

LOG = ANNOTATION + ", seq long"
BUCKETS = 64


def _folders(spark: SparkSession, path: str, pattern: str) -> list[tuple[int, int, str]]:
    """(version, bucket or -1, path) of the folders that match."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}")
    found = [str(s.getPath()) for s in where.getFileSystem(conf).globStatus(where) or []]
    parts = [re.search(r"/version=(\d+)(?:/bucket=(\d+))?$", f) for f in found]
    return [(int(m[1]), int(m[2] or -1), f) for m, f in zip(parts, found, strict=True) if m]


def _newest(spark: SparkSession, path: str, batch: int) -> dict[int, tuple[int, str]]:
    """For each bucket its last (version, path) up to a batch."""
    newest: dict[int, tuple[int, str]] = {}
    for version, bucket, folder in _folders(spark, path, "version=*/bucket=*"):
        if version <= batch:
            newest[bucket] = max(newest.get(bucket, (-1, "")), (version, folder))
    return newest


def _read(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.schema(LOG).parquet(*folders) if folders else spark.createDataFrame([], LOG)


def state(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """What held after a batch, the last one that ended or the one before it; nothing before the first."""
    return _read(spark, [folder for _, folder in _newest(spark, path, batch).values()])


def _expire(spark: SparkSession, path: str, batch: int) -> None:
    """Removes what the states after this batch and the one before it do not need."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    needed = {folder for _, folder in _newest(spark, path, batch - 1).values()}
    held = {version for version, _, folder in _folders(spark, path, "version=*/bucket=*") if version >= batch or folder in needed}
    old = [f for v, _, f in _folders(spark, path, "version=*/bucket=*") if v < batch and f not in needed]
    old += [f for v, _, f in _folders(spark, path, "version=*") if v < batch and v not in held]
    for folder in old:
        where = jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(conf).delete(where, True)


def keep(additions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts the query. additions: a stream of LOG rows; path: the folder of versions."""
    bucket = F.pmod(F.xxhash64("targetType", target_key()), F.lit(BUCKETS)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = _newest(spark, path, number - 1)
        touched = {r["bucket"] for r in batch.select(bucket.alias("bucket")).distinct().collect()}  # BUCKETS at most
        before = _read(spark, [known[b][1] for b in sorted(touched & known.keys())])
        held = current_annotations(before.unionByName(batch.select(*before.columns))).select(*before.columns, bucket.alias("bucket"))
        out = held.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static")
        out.partitionBy("bucket").parquet(f"{path}/version={number}")
        _expire(spark, path, number)

    return additions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
