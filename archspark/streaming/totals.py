"""Counts and sums of files, kept up to date from a stream of files that come, change, move or go.

A log has each file's last row: where a file changes, its old part is taken back from the sums and its new one added, so that
only changed files are read and only sums that change are written. Where two languages tie for most lines, the one met first is found among the files of these alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.storage import cut
from .changes import Log, changes

FILE = "repo string, path string, owner string, language string, lines long, size_bytes long, n_symbols long"
#: A file as it is from ``seq`` on, or that it is gone.
EVENT = FILE + ", deleted boolean, seq long"
_COLUMNS = tuple(c.split()[0] for c in FILE.split(", "))
_NUMBERS = ("files", "lines", "size_bytes", "symbols")


def files_log(path: str) -> Log:
    return Log(f"{path}/files", (*_COLUMNS, "seq", "live"), ("sign",), FILE + ", seq long, live boolean, sign long")


def sums_log(path: str) -> Log:
    return Log(f"{path}/sums", ("repo", "owner", "language"), _NUMBERS, "repo string, owner string, language string, " + ", ".join(f"{c} long" for c in _NUMBERS))


def keep(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts the query on a stream of EVENT rows; path: a folder that only this checkpoint writes to. The sums are made from what the log of files got."""

    def add(batch: DataFrame, n: int) -> None:
        held, sums = files_log(path), sums_log(path)
        held.write(changes(batch, held, ["repo", "path"], n), n)
        sign = F.col("sign")
        parts = held.batch(batch.sparkSession, n).where("live")
        sums.write(parts.select("repo", "owner", "language", sign.alias("files"), (sign * F.col("lines")).alias("lines"), (sign * F.col("size_bytes")).alias("size_bytes"), (sign * F.col("n_symbols")).alias("symbols")), n)

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def files(spark: SparkSession, path: str, n: int) -> DataFrame:
    """FILE rows that there are after batch n."""
    return files_log(path).read(spark, n).where("live").select(*_COLUMNS)


def events(before: DataFrame, after: DataFrame, seq: int) -> DataFrame:
    """EVENT rows that make the files before (FILE) into those after: what is new or differs, and what is gone."""
    rest = [c for c in _COLUMNS if c not in ("repo", "path")]
    a, b = (df.select("repo", "path", F.struct(*rest).alias(side)) for df, side in ((before, "a"), (after, "b")))
    both = a.join(b, ["repo", "path"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("repo", "path", *[F.col(f"b.{c}").alias(c) for c in rest], F.col("b").isNull().alias("deleted"), F.lit(seq).cast("long").alias("seq"))


def _measured(spark: SparkSession, path: str, n: int, keys: list[str]) -> DataFrame:
    """keys, the sums, ``languages`` (language -> lines) and ``main_language``, of rows whose keys are known."""
    sums = sums_log(path).read(spark, n)
    for k in (*keys, "language"):
        sums = sums.where(F.col(k).isNotNull())
    per = sums.groupBy(*keys, "language").agg(*[F.sum(c).alias(c) for c in _NUMBERS])
    entry = F.struct("language", "lines")
    rows = per.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _NUMBERS], F.array_sort(F.collect_list(entry)).alias("entries"), F.max("lines").alias("most"))  # an entry for each known language
    rows = rows.withColumn("best", F.filter("entries", lambda e: e["lines"] == F.col("most")))
    rows = cut(rows, "totals")
    ties = rows.where(F.size("best") > 1).select(*keys, F.explode("best.language").alias("language"))
    main = F.col("best")[0]["language"]
    if not ties.isEmpty():
        first = files(spark, path, n).join(ties, [*keys, "language"], "left_semi").groupBy(*keys).agg(F.min_by("language", "path").alias("first"))
        rows, main = rows.join(first, keys, "left"), F.coalesce("first", main)
    return rows.select(*keys, *_NUMBERS, F.map_from_entries("entries").alias("languages"), main.alias("main_language"))


def component_metrics(spark: SparkSession, path: str, n: int) -> DataFrame:
    """As ``metrics.component_metrics`` of the files after batch n."""
    return _measured(spark, path, n, ["repo", "owner"])


def repository_totals(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(repo, files, lines, size_bytes, symbols, languages, main_language) after batch n."""
    return _measured(spark, path, n, ["repo"])


def language_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(language, lines) over all repositories after batch n."""
    return sums_log(path).read(spark, n).groupBy("language").agg(F.sum("lines").alias("lines"))
