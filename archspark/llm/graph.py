"""Connected components of an edge table, by alternating stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): a large star
links each node's larger neighbours to the smallest of them, a small star does so for
the smaller ones; stars remain after a logarithmic number of rounds. Each round needs
a minimum for each node (partial aggregation) and a join, so that a node with most of
the edges makes no large group; the join's skew is left to AQE, which splits it.

Tasks first keep a forest of their edges only. If no more than ``FEW`` edges are left (a bound that is
checked), one task joins the forests; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SCHEMA = "u long, v long"
#: Edges (16 bytes each) that one task may join.
FEW = 500_000


def spanning(u: list[int], v: list[int]) -> tuple[list[int], list[int]]:
    """(node, smallest node) of the components of the edges."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while (up := root[x]) != top:
            root[x], x = top, up
        return top

    for a, b in zip(u, v, strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    nodes = [x for x in root if find(x) != x]
    return nodes, [root[x] for x in nodes]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        u, v = spanning(b.column(0).to_pylist(), b.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = [(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches]
    nodes, roots = spanning([x for u, _ in both for x in u], [x for _, v in both for x in v])
    tops = sorted(set(roots))
    for a in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[a : a + 100_000], pa.int64()), pa.array(roots[a : a + 100_000], pa.int64())], names=["id", "component"])
    yield pa.RecordBatch.from_arrays([pa.array(tops, pa.int64())] * 2, names=["id", "component"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all nodes that have an edge to another node; component is the smallest id.

    edges: columns u and v, long, either direction, repeats and loops allowed. An empty
    table gives an empty result.
    """
    pairs = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    now = cut(pairs.mapInArrow(_forests, SCHEMA).distinct(), "edges")
    seen = _state(now)
    if seen[0] <= FEW:
        return now.coalesce(1).mapInArrow(_stars, "id long, component long")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = cut(small.where("u <> v").distinct(), "small")
        if (state := _state(now)) == seen:
            break
        seen = state
    roots = now.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
