"""The deepest of given directories at or above each place, by one sweep over sorted paths.

Paths are ordered by their parts, so that a directory comes right before all that is in it. A task that goes through
them in this order keeps a stack of the open directories: what is not above the next path is closed, and the top is the answer. Paths are dealt to
tasks by ranges; the directories that are open where a range begins are those above its border, and are looked up
once for each border. A path is one row, whatever its depth, and no key stands for a whole tree.

An empty path is the root and lies above all others of its repository. Paths that repeat count once. Python
bisects and keeps the stack; sorting and shuffling are Spark's.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.storage import counted_cut

#: Paths that one task sweeps, about.
RANGE_ROWS = 200_000
#: Paths of the sample, for each range, that borders are chosen from.
SAMPLE = 32

FOUND = "repo string, place string, top string"


def parts_of(path: Column) -> Column:
    """A path as an array that sorts directories before what is in them; the root is empty."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, "/", -1))


def _key(repo: str, path: str) -> tuple[str, list[str]]:
    return repo, path.split("/") if path else []


def is_inside(path: str, top: str) -> bool:
    return not top or path == top or path.startswith(f"{top}/")


def _dealt(borders: list[tuple[str, list[str]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = [bisect_right(borders, _key(r, p)) for r, p in zip(b.column("repo").to_pylist(), b.column("place").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part, pa.int32())], names=[*b.schema.names, "part"])

    return run


def _swept(open_at: dict[int, tuple[str, list[str]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, repo, stack = None, None, []
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for part, r, path, opens, asked in zip(*(b.column(c).to_pylist() for c in ("part", "repo", "place", "opens", "asked")), strict=True):
                if part != now:
                    now, (repo, stack) = part, open_at.get(part, (None, []))
                    stack = list(stack)
                if r != repo:
                    repo, stack = r, []
                while stack and not is_inside(path, stack[-1]):
                    stack.pop()
                if opens:
                    stack.append(path)
                if asked and stack:
                    for column, value in zip(out, (r, path, stack[-1]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["repo", "place", "top"])

    return run


def enclosing(places: DataFrame, tops: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(repo, place, top) of the distinct places (repo, place) that lie in or are one of tops (repo, path): the deepest such."""
    tops, some = counted_cut(tops.select("repo", F.col("path").alias("place")).distinct(), "tops")
    if not some:
        return places.sparkSession.createDataFrame([], FOUND)
    flags = lambda opens: [F.lit(opens).alias("opens"), F.lit(not opens).alias("asked")]
    marks = places.where("place is not null").select("repo", "place", *flags(False)).unionByName(tops.select("repo", "place", *flags(True)))
    marks, n = counted_cut(marks.groupBy("repo", "place").agg(F.max("opens").alias("opens"), F.max("asked").alias("asked")), "places")
    parts = max(1, -(-n // range_rows))
    if parts == 1:
        dealt, open_at = marks.withColumn("part", F.lit(0)).coalesce(1), {}
    else:
        sample = sorted(_key(r["repo"], r["place"]) for r in marks.select("repo", "place").orderBy(F.xxhash64("repo", "place")).limit(SAMPLE * parts).collect())
        borders = [sample[k * SAMPLE] for k in range(1, parts) if k * SAMPLE < len(sample)]
        dealt = marks.mapInArrow(_dealt(borders), "repo string, place string, opens boolean, asked boolean, part int").repartition(len(borders) + 1, "part")
        open_at = _open_at(borders, tops)
    ordered = dealt.sortWithinPartitions("part", "repo", parts_of(F.col("place")))
    return ordered.mapInArrow(_swept(open_at), FOUND)


def _open_at(borders: list[tuple[str, list[str]]], tops: DataFrame) -> dict[int, tuple[str, list[str]]]:
    """For each range the repository of its border and the tops above it, from the root on: as many rows as borders have parts."""
    rows = [(k, repo, "/".join(path)) for k, (repo, path) in enumerate(borders, 1)]
    above = tops.sparkSession.createDataFrame(rows, "part int, repo string, border string").where("border <> ''").select("part", "repo", F.posexplode(T.ancestors(F.col("border"))).alias("depth", "place"))
    found: dict[int, tuple[str, list[str]]] = {}
    for r in above.join(tops, ["repo", "place"]).orderBy("part", "depth").collect():
        found.setdefault(r["part"], (r["repo"], []))[1].append(r["place"])
    return found
