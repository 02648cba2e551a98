"""Exact top-k search by inner product with a pivot-distance index.

With M the greatest length of any row, a row x is taken as x' = (x, sqrt(M^2 - |x|^2)) and a query q as (q, 0). Then
|q - x'|^2 = |q|^2 + M^2 - 2 q.x, so that the greatest products are the nearest points, for which
the triangle inequality holds (Jagadish et al., "iDistance", 2005).

1. ``PIVOTS`` points are fitted on a bounded sample (``SAMPLE_ROWS``). Every row is keyed by its nearest
   pivot and the distance r to it, and dealt by ranges of this key to blocks of at most ``BLOCK_ROWS``: a block holds
   sorted annuli around one pivot or a few. Blocks are rows of a table in the shared folder. Equal rows, however many, lie in
   neighbouring blocks.
2. Queries go to all tasks in groups of at most ``QUERY_BYTES``, one after the other, each a broadcast that ends with its group.
3. Seeds: a query is compared with the annuli that hold its own place (its nearest pivot, its distance). The k-th best
   product there bounds its answer from below and gives a radius around the query.
4. Every task goes through its blocks ring by ring (annuli of at most ``RING`` rows), for each query from the nearest ring on. A ring
   around pivot p from r0 to r1 is no nearer than d(q, p) - r1, r0 - d(q, p) and, since its rows have no nearer
   pivot, (d(q, p) - d(q, p*)) / 2. Once that exceeds the radius, which shrinks with each better row, the
   query leaves the block. The best k of all tasks are the answer, ties to the smaller id.

Nothing is left out but what the bounds rule out; on vectors without near neighbours these rule out little, and
the work is queries times rows. Distances are computed in double precision and compared with a
margin; products are exact: as doubles while all sums stay below 2^53, else the rows within the
rounding error of the bound are multiplied as whole numbers.

Cases: vectors that are null or hold null or non-finite components take no part, null ids neither; zero and empty vectors do.
Components whose 256-fold is no finite double count as non-finite. Vectors of unequal length are no candidates of each
other. A query with fewer than k candidates gets all of them. A query id that repeats is asked once (of
several vectors the least one); repeated candidates are rows like others; a candidate is left out only if its id
is the query's own. A product beyond 64 bits is given as the nearest long (one beyond 38 digits is ordered as the
largest of 38). An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, fresh_path, query_groups, read

PIVOTS = 64
SAMPLE_ROWS = 8192
BLOCK_ROWS = 4096
RING = 1024
QUERY_BYTES = 32 << 20
#: Distances are compared with this margin, in parts of the greatest length.
MARGIN = 1e-6
#: Whole numbers up to here are exact as doubles.
EXACT = float(1 << 53)
_MOST = 10**38 - 1

KEYED = "dim int, pivot int, r double, vec_id long, tie long, vector binary"
BLOCK = "dim int, ids binary, pivots binary, r binary, vectors binary"
FOUND = "query_id long, vec_id long, score decimal(38,0)"


def scaled(column: str) -> Column:
    """Components as floor(256 x), which are whole numbers in doubles."""
    return F.expr(f"transform({column}, x -> 256 * double(x) - pmod(256 * double(x), 1D))")


def usable(column: str) -> str:
    return f"{column} is not null and forall({column}, x -> x is not null and not isnan(x) and abs(256 * double(x)) < double('Infinity'))"


@dataclass
class Pivots:
    """The greatest squared length of a row, and for each vector length the pivots, with the added coordinate."""

    square: float
    points: dict[int, np.ndarray]

    def raised(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.square - (x * x).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def of(self, dim: int) -> np.ndarray:
        """Pivots of a vector length; the origin for one that the sample lacks."""
        return self.points.get(dim, np.zeros((1, dim + 1)))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Distances of points (with the added coordinate) to all pivots."""
        p = self.of(x.shape[1] - 1)
        return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * x @ p.T, 0))


def centres(x: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """Pivots of a sample: means of its cells, begun with points far from each other."""
    chosen, far = [0], np.full(len(x), np.inf)
    while len(chosen) < min(count, len(x)):
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        if not far.max() > 0:
            break
        chosen.append(int(far.argmax()))
    p = x[chosen]
    for _ in range(rounds):
        cell = ((p * p).sum(axis=1)[None, :] - 2 * x @ p.T).argmin(axis=1)
        sums = np.zeros_like(p)
        np.add.at(sums, cell, x)
        size = np.bincount(cell, minlength=len(p))
        p = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], p)
    return p


def _by_length(ids: pa.Array, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of each vector length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for dim in np.unique(sizes):
        own = np.flatnonzero(sizes == dim)
        yield own, flat[offsets[own][:, None] + np.arange(dim)].astype(np.float64).reshape(len(own), dim)


def fitted(rows: DataFrame, count: int = PIVOTS, sample_rows: int = SAMPLE_ROWS) -> Pivots:
    """Pivots on a sample of at most sample_rows rows (vec_id, v), chosen by hash."""
    square = rows.agg(F.max(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)"))).first()[0] or 0.0
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample_rows).toArrow()
    pivots = Pivots(square * (1 + 1e-12), {})
    for _, x in _by_length(sample.column("vec_id"), sample.column("v")):
        pivots.points[x.shape[1]] = centres(pivots.raised(x), count)
    return pivots


def _keyed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ties = b.column(0).to_numpy(), b.column(2).to_numpy()
            for own, x in _by_length(b.column(0), b.column(1)):
                d = shared.value.distances(shared.value.raised(x))
                pivot = d.argmin(axis=1)
                raw = [row.tobytes() for row in x.astype("<f8")]
                arrays = [pa.array([x.shape[1]] * len(own), pa.int32()), pa.array(pivot.astype(np.int32)), pa.array(d[np.arange(len(own)), pivot]), pa.array(ids[own]), pa.array(ties[own]), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in KEYED.split(",")])

    return run


def _blocks(block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def given() -> pa.RecordBatch:
            dims, pivots, r, ids, vectors = zip(*held, strict=True)
            held.clear()
            packed = [np.array(ids, "<i8"), np.array(pivots, "<i4"), np.array(r, "<f8")]
            values = [[dims[0]], *[[p.tobytes()] for p in packed], [b"".join(vectors)]]
            kinds = [pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=[c.split()[0] for c in BLOCK.split(",")])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 3, 5)), strict=True):
                if held and (held[0][0] != row[0] or len(held) == block_rows):
                    yield given()
                held.append(row)
        if held:
            yield given()

    return run


def index(rows: DataFrame, pivots: Pivots, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A table of blocks of sorted annuli, which hold every row of rows (vec_id, v) once."""
    spark = rows.sparkSession
    n, cores = rows.count(), spark.sparkContext.defaultParallelism
    tasks = max(1, -(-n // block_rows), min(cores, n // 512))
    keyed = rows.withColumn("tie", F.monotonically_increasing_id()).mapInArrow(_keyed(spark.sparkContext.broadcast(pivots)), KEYED)  # PIVOTS points a length
    order = ["dim", "pivot", "r", "vec_id", "tie"]
    return cut(keyed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(_blocks(block_rows), BLOCK), "annuli")


@dataclass
class Asked:
    """Queries of one length, with what is known of their answers in a task."""

    ids: np.ndarray
    x: np.ndarray
    square: float
    distances: np.ndarray
    k: int
    least: np.ndarray  # a product that the k-th best has at least; -inf: none known
    own: np.ndarray  # squared lengths
    best: list[list[tuple[int, int]]] = field(default_factory=list)  # (-product, id)

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray, pivots: Pivots, k: int, known: dict[int, float]) -> Asked:
        flat = np.concatenate([x, np.zeros((len(x), 1))], axis=1)
        return cls(ids, x, pivots.square, pivots.distances(flat), k, np.array([known.get(i, -np.inf) for i in ids.tolist()]), (x * x).sum(axis=1), [[] for _ in ids])

    def radius(self) -> np.ndarray:
        """How near a row must be to be among the k best, with the margin."""
        return np.sqrt(np.maximum(self.own + self.square - 2 * self.least, 0)) + MARGIN * (np.sqrt(self.own) + np.sqrt(self.square)) + MARGIN

    def offer(self, who: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Takes rows into account for the queries ``who``."""
        q = self.x[who]
        products = q @ x.T
        error = 0.0
        if (top := x.shape[1] * np.abs(q).max(initial=0) * np.abs(x).max(initial=0)) >= EXACT:
            error = top * 1e-14 * x.shape[1]
        row, column = np.nonzero(~(products < (self.least[who] - error)[:, None]) & (ids[None, :] != self.ids[who][:, None]))
        bounds = np.searchsorted(row, np.arange(len(who) + 1))
        for i, (a, z) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if a == z:
                continue
            at, of = column[a:z], who[i]
            if error:
                scores = [sum(int(u) * int(v) for u, v in zip(self.x[of], x[c], strict=True)) for c in at]
            else:
                s = products[i, at]
                if len(at) > 4 * self.k:
                    good = s >= np.partition(s, -self.k)[-self.k]
                    at, s = at[good], s[good]
                    if len(at) > 4 * self.k:  # many ties: the smallest ids
                        first = np.lexsort((ids[at], -s))[: self.k]
                        at, s = at[first], s[first]
                scores = s.astype(np.int64).tolist()
            best = self.best[of] = sorted([*self.best[of], *zip([-v for v in scores], ids[at].tolist(), strict=True)])[: self.k]
            if len(best) == self.k:
                self.least[of] = max(self.least[of], float(-best[-1][0]) - error)


@dataclass
class Annuli:
    """A block: rows by (pivot, r), and its rings (pivot, first, end)."""

    ids: np.ndarray
    x: np.ndarray
    r: np.ndarray
    rings: list[tuple[int, int, int]]

    @classmethod
    def loaded(cls, dim: int, ids: bytes, pivots: bytes, r: bytes, vectors: bytes) -> Annuli:
        n = len(ids) // 8
        pivot = np.frombuffer(pivots, "<i4")
        edges = np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1], [True]])).tolist()
        rings = [(int(pivot[a]), k, min(k + RING, z)) for a, z in zip(edges[:-1], edges[1:], strict=True) for k in range(a, z, RING)]
        return cls(np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(n, dim), np.frombuffer(r, "<f8"), rings)

    def seed(self, asked: Asked) -> None:
        """Compares queries with the rings that hold their own place."""
        nearest = asked.distances.argmin(axis=1)
        own = asked.distances[np.arange(len(nearest)), nearest]
        for pivot, a, z in self.rings:
            slack = MARGIN * np.sqrt(asked.square) + MARGIN
            who = np.flatnonzero((nearest == pivot) & (own >= self.r[a] - slack) & (own <= self.r[z - 1] + slack))
            if len(who):
                asked.offer(who, self.ids[a:z], self.x[a:z])

    def expand(self, asked: Asked) -> int:
        """Goes through the rings, from each query's nearest on, until the bounds exceed its radius. Returns the pairs compared."""
        d, compared = asked.distances, 0
        nearest = d.min(axis=1)
        lower = np.stack([np.maximum.reduce([d[:, p] - self.r[z - 1], self.r[a] - d[:, p], (d[:, p] - nearest) / 2]) for p, a, z in self.rings], axis=1)
        order = np.argsort(lower, axis=1, kind="stable")
        going = np.arange(len(d))
        for step in range(len(self.rings)):
            ring = order[going, step]
            near = ~(lower[going, ring] > asked.radius()[going])  # what is no number is near
            going, ring = going[near], ring[near]
            if not len(going):
                break
            for k in np.unique(ring).tolist():
                _, a, z = self.rings[k]
                asked.offer(going[ring == k], self.ids[a:z], self.x[a:z])
                compared += int((ring == k).sum()) * (z - a)
        return compared


def _searched(shared, k: int, seeds: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, parts, known = shared.value
        asked = {x.shape[1]: Asked.of(ids, x, pivots, k, known) for ids, x in parts}
        for b in batches:
            for row in range(b.num_rows):
                block = Annuli.loaded(*[b.column(c)[row].as_py() for c in range(5)])
                if (one := asked.get(block.x.shape[1])) is not None:
                    (block.seed if seeds else block.expand)(one)
        for one in asked.values():
            out = [(i, vec_id, Decimal(max(-_MOST, min(_MOST, -s)))) for i, best in zip(one.ids.tolist(), one.best, strict=True) for s, vec_id in best]
            kinds = (pa.int64(), pa.int64(), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], names=["query_id", "vec_id", "score"])

    return run


def largest_products(rows: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, query_bytes: int = QUERY_BYTES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows with the greatest inner product; both sides have vec_id and embedding."""
    spark = rows.sparkSession
    bound_batches(spark)
    keep = lambda d: d.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(f"vec_id is not null and {usable('embedding')}").select("vec_id", scaled("embedding").alias("v"))
    used = keep(rows)
    fit = fitted(used, pivots, sample_rows)
    blocks = index(used, fit, block_rows)
    asked = cut(keep(queries).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = fresh_path(spark, "products")
    for part in query_groups(asked, "v", query_bytes):
        parts = [(part.column("vec_id").to_numpy()[own], x) for own, x in _by_length(part.column("vec_id"), part.column("v"))]
        first = spark.sparkContext.broadcast((fit, parts, {}))
        seeds = blocks.mapInArrow(_searched(first, k, True), FOUND).withColumn("rank", F.row_number().over(by)).where(F.col("rank") == k)
        known = {r["query_id"]: float(r["score"]) for r in seeds.select("query_id", "score").collect()}  # a number for each query of the group
        first.destroy()
        second = spark.sparkContext.broadcast((fit, parts, known))
        blocks.mapInArrow(_searched(second, k, False), FOUND).write.mode("append").parquet(found)
        second.destroy()  # what it was for is written
    best = spark.read.schema(FOUND).parquet(found).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    low, high = -(1 << 63), (1 << 63) - 1
    inside = F.greatest(F.lit(Decimal(low)).cast("decimal(38,0)"), F.least(F.lit(Decimal(high)).cast("decimal(38,0)"), F.col("score")))
    return best.select("query_id", "rank", "vec_id", inside.cast("long").alias("score"))


def op12_pivot_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every vector whose id is divisible by 50."""
    rows = read(spark, sf_dir, "embeddings")
    return largest_products(rows, rows.where("vec_id % 50 = 0"), 5)


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on len(c.e) = len(q.e) and c.vec_id <> q.vec_id where q.vec_id % 50 = 0
), r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
