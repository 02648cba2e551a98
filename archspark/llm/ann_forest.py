"""Nearest neighbours by a hash-prefix forest.

Each tree hashes a vector to a 64-bit string (signs of random projections) and keeps
the rows as a sorted array of such strings. A query descends in every tree to the rows
with the longest common prefix, then all trees ascend together, one bit at a time, and
give their further candidates; the candidates' cosines are computed on the vectors.

The ascent stops by a bound and not at a count: with a current k-th best cosine s, two
vectors agree in a bit with probability p = 1 - acos(s)/pi, so that at depth d a row
that near is in none of L prefix buckets with probability (1 - p^d)^L. The query goes
on until that is below ``miss``. A query that has very near neighbours ends deep in
the trees; one that has none goes up to the roots, where every row is a candidate.
No bucket and no candidate list is capped.

Rows are dealt to blocks of about ``block_rows`` at random. A block's forest (vectors, sorted arrays)
is built once and is a row of the index, a table in the shared folder. Queries go to all tasks in
groups of at most ``query_bytes``, one after the other, each a broadcast that ends with its group; a task goes through its blocks, carries each
query's k nearest from block to block, which ends later ascents sooner, and returns these. The best k of
all tasks are the answer. Each row is shuffled once, and so is a task's result for each query.
Equal vectors, however many, are only rows of their blocks.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part; null
ids neither. Vectors of unequal length are no candidates of each other. A query
with fewer than k candidates gets all of them. Ties go to the smaller id. A query id that
repeats is asked once (of several vectors the least one); repeated candidates are rows like
others. A candidate is left out only if its id is the query's own. Scores are sums in the order of
components, so that equal vectors tie. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, fresh_path, query_groups, read

TREES = 24
BITS = 64
MISS = 0.03
BLOCK_ROWS = 4096
QUERY_BYTES = 32 << 20

INDEX = "dim int, ids binary, vectors binary, codes binary, places binary"
FOUND = "query_id long, vec_id long, score double"


def usable(column: str) -> str:
    """SQL condition: a vector that has a cosine with others."""
    return f"{column} is not null and size({column}) > 0 and forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists({column}, x -> x <> 0)"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with each of b, for the choice of pairs: the last bits depend on the rows beside."""
    a, b = (_tame(x.astype(np.float64)) for x in (a, b))
    return (a @ b.T) / (np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :])


#: Cosines of a matrix product are this near to those of ``pair_cosines``.
MARGIN = 1e-9


def pair_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the row of b beside it, in double precision on the original vectors.

    Products are added component after component: a pair has one score, whatever stands beside it and whichever is first.
    """
    a, b = (_tame(x.astype(np.float64)) for x in (a, b))
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for x, y in zip(a.T, b.T, strict=True):
        dot += x * y
        aa += x * x
        bb += y * y
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def _tame(x: np.ndarray) -> np.ndarray:
    """Rows whose squares would overflow or vanish times a power of two, which changes no cosine; others as they are."""
    exponent = np.frexp(np.abs(x).max(axis=1, initial=0, keepdims=True))[1]
    return np.where(np.abs(exponent) > 400, np.ldexp(x, -exponent), x)


@cache
def hyperplanes(dim: int, trees: int, seed: int = 7) -> np.ndarray:
    """trees x 64 x dim directions; the same for every task."""
    return np.random.default_rng([seed, dim, trees]).standard_normal((trees, BITS, dim))


def strings(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """trees x rows hash strings; the first projection is the highest bit."""
    out = np.zeros((len(planes), len(x)), np.uint64)
    for t, plane in enumerate(planes):
        signs = x @ plane.T >= 0
        out[t] = np.packbits(signs, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


@dataclass
class Forest:
    """A block's rows, and for each tree their hash strings in order with the rows' places."""

    ids: np.ndarray
    x: np.ndarray
    codes: np.ndarray
    places: np.ndarray

    @classmethod
    def grown(cls, ids: np.ndarray, x: np.ndarray, trees: int = TREES) -> Forest:
        codes = strings(unit(x), hyperplanes(x.shape[1], trees))
        places = np.argsort(codes, axis=1, kind="stable").astype(np.uint32)
        return cls(ids, x, np.take_along_axis(codes, places, axis=1), places)

    @classmethod
    def loaded(cls, dim: int, ids: bytes, vectors: bytes, codes: bytes, places: bytes) -> Forest:
        n = len(ids) // 8
        return cls(np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(n, dim), np.frombuffer(codes, "<u8").reshape(-1, n), np.frombuffer(places, "<u4").reshape(-1, n))

    def stored(self) -> tuple[int, bytes, bytes, bytes, bytes]:
        return self.x.shape[1], self.ids.astype("<i8").tobytes(), self.x.astype("<f8").tobytes(), self.codes.astype("<u8").tobytes(), self.places.astype("<u4").tobytes()

    def ranges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end), each query x depth x tree: the rows that share so many leading bits, in each sorted array."""
        trees, queries = codes.shape
        first, end = (np.empty((queries, BITS + 1, trees), np.int32) for _ in range(2))
        for depth in range(BITS + 1):
            span = np.uint64((1 << (BITS - depth)) - 1)
            for t in range(trees):
                first[:, depth, t] = np.searchsorted(self.codes[t], codes[t] & ~span, "left")
                end[:, depth, t] = np.searchsorted(self.codes[t], codes[t] | span, "right")
        return first, end

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, miss: float = MISS, known: list[np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's row, positions of its nearest rows, their cosines), best first. known: the best scores that each query has from elsewhere."""
        n, trees = len(self.ids), len(self.codes)
        own, u = unit(self.x), unit(queries)
        first, end = self.ranges(strings(u, hyperplanes(queries.shape[1], trees)))
        # The longest prefix that any row of any tree shares with the query: there the ascent starts.
        deepest = (end > first).any(axis=2).sum(axis=1) - 1
        flat, base = self.places.ravel(), np.tile(np.arange(trees) * n, 2)
        for q in range(len(queries)):
            seen = self.ids == query_ids[q]
            places, scores = [], []
            best = np.zeros(0) if known is None else known[q]
            low, high = end[q, deepest[q]], end[q, deepest[q]]
            for depth in range(int(deepest[q]), -1, -1):
                a, b = first[q, depth], end[q, depth]
                # Each tree's rows that the shorter prefix adds, on both sides.
                starts, sizes = np.concatenate([a, high]) + base, np.concatenate([low - a, b - high])
                low, high = a, b
                if total := int(sizes.sum()):
                    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
                    mark = np.zeros(n, bool)
                    mark[flat[shift + np.arange(total)]] = True
                    found = np.flatnonzero(mark & ~seen)
                    if len(found):
                        seen[found] = True
                        places.append(found)
                        scores.append(own[found] @ u[q])
                        best = np.sort(np.concatenate([best, scores[-1]]))[-k:]
                if depth and len(best) == k:
                    p = 1 - np.arccos(np.clip(best[0], -1, 1)) / np.pi
                    if (1 - p**depth) ** trees <= miss:
                        break
            if not places:
                continue
            # Exact measure and ties: a margin around the k-th keeps equal scores together.
            have = np.concatenate(places)[np.concatenate(scores) >= best[0] - MARGIN]
            exact = pair_cosines(np.broadcast_to(queries[q], (len(have), queries.shape[1])), self.x[have])
            order = np.lexsort((self.ids[have], -exact))[:k]
            yield q, have[order], exact[order]


def _vectors(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_length(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of each vector length."""
    sizes = np.array([len(x) for x in table.column("embedding")], np.int64)
    for dim in np.unique(sizes):
        part = table.filter(pa.array(sizes == dim))
        yield part.column("vec_id").to_numpy(), _vectors(part.column("embedding"))


def index(rows: DataFrame, trees: int = TREES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A table with the forest of each block of rows (vec_id, embedding)."""
    spark = rows.sparkSession
    n = rows.count()
    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block_rows), min(cores, n // 512))
    # A row's place in the scan deals repeated rows to different blocks.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))

    def grow(table: pa.Table) -> pa.Table:
        made = [Forest.grown(ids, x, trees).stored() for ids, x in _by_length(table)]
        kinds = (pa.int32(), *[pa.binary()] * 4)
        return pa.table([pa.array([m[i] for m in made], t) for i, t in enumerate(kinds)], names=["dim", "ids", "vectors", "codes", "places"])

    tasks = min(blocks, max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return cut(dealt.repartition(tasks, "block").groupBy("block").applyInArrow(grow, INDEX), "forest")


def _searched(shared, k: int, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, tuple[np.ndarray, np.ndarray]] = {x.shape[1]: (ids, x) for ids, x in shared.value}
        near: dict[int, list[list[tuple[float, int]]]] = {dim: [[] for _ in ids] for dim, (ids, _) in asked.items()}
        for b in batches:
            for row in range(b.num_rows):
                forest = Forest.loaded(*[b.column(c)[row].as_py() for c in range(5)])
                if (dim := forest.x.shape[1]) in asked:
                    ids, x = asked[dim]
                    known = [np.array(sorted(-s for s, _ in best)) for best in near[dim]]
                    for q, at, score in forest.search(ids, x, k, miss, known):
                        near[dim][q] = sorted([*near[dim][q], *zip((-score).tolist(), forest.ids[at].tolist(), strict=True)])[:k]
        for dim, (ids, _) in asked.items():
            out = [(i, vec_id, -s) for i, best in zip(ids.tolist(), near[dim], strict=True) for s, vec_id in best]
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], names=["query_id", "vec_id", "score"])

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int, trees: int = TREES, miss: float = MISS, block_rows: int = BLOCK_ROWS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows; both sides have vec_id and embedding."""
    spark = rows.sparkSession
    bound_batches(spark)
    keep = lambda d: d.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(f"vec_id is not null and {usable('embedding')}")
    forests = index(keep(rows), trees, block_rows)
    asked = cut(keep(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    found = fresh_path(spark, "found")
    for part in query_groups(asked, "embedding", query_bytes):
        shared = spark.sparkContext.broadcast(list(_by_length(part)))
        forests.mapInArrow(_searched(shared, k, miss), FOUND).write.mode("append").parquet(found)
        shared.destroy()  # what it was for is written
    found = spark.read.schema(FOUND).parquet(found)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    rows = read(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 50 = 0"), 5)
