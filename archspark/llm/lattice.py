"""Near-duplicate vectors by lattice hashing.

Each table projects unit vectors on ``PARTS`` random orthonormal sets of eight
directions and decodes every part to its nearest point of the lattice E8 (Conway and
Sloane, 1982); the points together with the label are the vector's cell. A vector also
probes the ``PROBES`` cells that one step to a neighbouring lattice point brings nearest. A
pair at cosine 0.98 shares no cell in eight tables with a chance of about 1 in 10,000 (of 20,000 pairs none to two
are missed at each of 2 to 256 dimensions).

1. Rows with equal label and vector are one class, whatever their number.
2. Narrow rows (cell, class) find the cells with at least two classes, one of them at
   home; only these take vectors along.
3. A cell with many classes is compared block against block, in as many tasks as there are
   pairs of blocks: matrix products in double precision, and no pair leaves a task. What
   leaves it is each class's count of links and a spanning forest of them.
4. A pair that meets in several cells is counted in one: the first of its common cells in
   the order of tables, which both vectors' codes decide.
5. Components come from the forests, and rows get their class's results.

Cases: vectors that are null, empty, zero or hold null or non-finite components, rows with a
null label or id: no links, their own component (null for a null id), kept if they have an
id. Vectors of unequal length never link. Rows that repeat an id are vectors like others, each
with its own links, component and kept; classes are told apart by a stored key. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann_forest import MARGIN, cosines, pair_cosines, unit, usable
from .common import bound_batches, cut, mix, read, salted
from .graph import components, spanning
from .minhash import by_run, chunks

TABLES, PARTS, PROBES = 8, 3, 6
#: Edge of the lattice in the unit vectors' space of 64 dimensions; others scale with the projections' length.
SCALE = 0.3
BLOCK = 512


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with whole coordinates and an even sum."""
    point = np.rint(x)
    error = x - point
    odd = np.flatnonzero(point.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(error[odd]).argmax(axis=1)
    point[odd, worst] += np.where(error[odd, worst] >= 0, 1.0, -1.0)
    return point


def e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 = D8 and D8 + 1/2."""
    whole, half = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


@cache
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, the steps to neighbouring points."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1.0, -1.0), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


@cache
def _directions(dim: int, table: int) -> np.ndarray:
    """dim x 8 * PARTS directions; orthonormal while the dimension allows it."""
    rng = np.random.default_rng([29, dim, table])
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-8 * PARTS // dim))], axis=1)[:, : 8 * PARTS]


def _key(points: np.ndarray, table: int, salt: np.ndarray) -> np.ndarray:
    """64-bit keys of lattice points (doubled, they are whole)."""
    key = mix(salt + np.uint64((table + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    for column in np.rint(2 * points).astype(np.int64).view(np.uint64).T:
        key = mix(key * np.uint64(0xD1342543DE82EF95) + column)
    return key


def cells(u: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """rows x TABLES x (1 + PROBES) cell keys of unit vectors; the home cell comes first."""
    steps, dim = shortest(), u.shape[1]
    scale = SCALE * (64 / dim) ** 0.5
    out = np.empty((len(u), TABLES, 1 + PROBES), np.uint64)
    for t in range(TABLES):
        x = u @ _directions(dim, t) / scale
        home = np.concatenate([e8(x[:, 8 * p : 8 * p + 8]) for p in range(PARTS)], axis=1)
        out[:, t, 0] = _key(home, t, salt)
        farther = np.concatenate([2 - 2 * (x - home)[:, 8 * p : 8 * p + 8] @ steps.T for p in range(PARTS)], axis=1)
        near = np.argpartition(farther, PROBES, axis=1)[:, :PROBES]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(farther, near, axis=1), axis=1, kind="stable"), axis=1)
        for k in range(PROBES):
            point = home.copy()
            for p in range(PARTS):
                own = np.flatnonzero(near[:, k] // 240 == p)
                point[own, 8 * p : 8 * p + 8] += steps[near[own, k] % 240]
            out[:, t, 1 + k] = _key(point, t, salt)
    return out


def _salt(labels: np.ndarray) -> np.ndarray:
    return mix(labels.astype(np.int64).view(np.uint64) + np.uint64(17))


def _by_length(table: pa.Table | pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of each vector length."""
    column = table.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    flat, sizes = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    for dim in np.unique(sizes):
        own = np.flatnonzero(sizes == dim)
        yield own, flat[offsets[own][:, None] + np.arange(dim)]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for own, x in _by_length(b, "embedding"):
            for a in range(0, len(own), 2048):
                part = own[a : a + 2048]
                keys = cells(unit(x[a : a + 2048]), _salt(b.column("label").to_numpy()[part])).view(np.int64)
                rep = np.repeat(b.column("rep").to_numpy()[part], keys.shape[1] * keys.shape[2])
                home = np.zeros(keys.shape, bool)
                home[:, :, 0] = True
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(rep), pa.array(home.ravel())], names=["cell", "rep", "home"])


def _linked(limit: float):
    """Links of block i with block j of each cell: counts for each class, and a forest.

    The runs of a batch are gone through one by one for their near pairs; what is known of
    these pairs' vectors (all their cells) is computed once for the batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in chunks(batches, 3):
            cell, block_i, block_j, block, rep, home, size, label = (t.column(c).to_numpy() for c in ("cell", "i", "j", "block", "rep", "home", "size", "label"))
            run_of = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            links, us, vs = np.zeros(t.num_rows, np.int64), [], []
            for own, x in _by_length(t, "embedding"):
                ps, qs = [], []
                bounds = np.searchsorted(run_of[own], np.arange(len(edges)))
                for a0, z0 in zip(bounds[:-1], bounds[1:], strict=True):
                    part = own[a0:z0]
                    if len(part) < 2:
                        continue
                    i, j = block_i[part[0]], block_j[part[0]]
                    a, z = np.flatnonzero(block[part] == i) + a0, np.flatnonzero(block[part] == j) + a0
                    cos = cosines(x[a], x[z])
                    near = (cos >= limit - MARGIN) & (home[own[a]][:, None] | home[own[z]][None, :]) & (rep[own[a]][:, None] != rep[own[z]][None, :])
                    if i == j:
                        near &= a[:, None] < z[None, :]
                    p, q = np.nonzero(near)
                    border = np.flatnonzero(cos[p, q] < limit + MARGIN)
                    linked = np.ones(len(p), bool)
                    for s in range(0, len(border), 8192):
                        at = border[s : s + 8192]
                        linked[at] = pair_cosines(x[a[p[at]]], x[z[q[at]]]) >= limit
                    p, q = p[linked], q[linked]
                    ps.append(a[p])
                    qs.append(z[q])
                p, q = (np.concatenate(k) if k else np.zeros(0, np.int64) for k in (ps, qs))
                if not len(p):
                    continue
                met = np.unique(np.concatenate([p, q]))
                keys = cells(unit(x[met]), _salt(label[own[met]]))
                for s in range(0, len(p), 32_768):
                    m, n = np.searchsorted(met, p[s : s + 32_768]), np.searchsorted(met, q[s : s + 32_768])
                    here = cell[own[met[m]]]
                    smaller = rep[own[met[m]]] < rep[own[met[n]]]
                    m, n = np.where(smaller, m, n), np.where(smaller, n, m)
                    # In each table: the smaller's home if the other is there, else the other's home if the smaller probes it.
                    at_m = (keys[n] == keys[m][:, :, :1]).any(axis=2)
                    at_n = (keys[m] == keys[n][:, :, :1]).any(axis=2)
                    first = (at_m | at_n).argmax(axis=1)
                    row = np.arange(len(m))
                    where = np.where(at_m[row, first], keys[m, first, 0], keys[n, first, 0])
                    counts = where.view(np.int64) == here
                    left, right = own[met[m[counts]]], own[met[n[counts]]]
                    np.add.at(links, left, size[right])
                    np.add.at(links, right, size[left])
                    us.append(rep[left])
                    vs.append(rep[right])
            if us and len(u := np.concatenate(us)):
                nodes, roots = spanning(u.tolist(), np.concatenate(vs).tolist())
                some = np.flatnonzero(links)
                rows = [pa.array([*rep[some].tolist(), *[None] * len(nodes)], pa.int64()), pa.array([*links[some].tolist(), *[None] * len(nodes)], pa.int64()), pa.array([*[None] * len(some), *nodes], pa.int64()), pa.array([*[None] * len(some), *roots], pa.int64())]
                yield pa.RecordBatch.from_arrays(rows, names=["rep", "links", "u", "v"])

    return run


def near_vectors(rows: DataFrame, limit: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of rows (vec_id, embedding, label)."""
    bound_batches(rows.sparkSession)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    rows = rows.withColumn("__in", F.expr(f"coalesce(vec_id is not null and label is not null and {usable('embedding')}, false)"))
    used = rows.where("__in")
    # A class has a key of its own, stored with it: an id may stand at several vectors.
    classes = used.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("rep"), "id", "label", "embedding", "size"), "classes")
    narrow = cut(classes.select("rep", "label", "embedding").mapInArrow(_cells, "cell long, rep long, home boolean"), "cells")
    shared = narrow.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.max("home").alias("home"), F.min("rep").alias("r0"), F.max("rep").alias("r1")).where("home and r0 <> r1")
    shared = shared.select("cell", "m", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    members = salted(narrow, shared, "cell", "m", narrow.count(), "rep")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "home").join(classes.drop("id"), "rep")
    ordered = by_run(dealt.select("cell", "i", "j", "block", "rep", "home", "size", "label", "embedding"), "cell", "i", "j")
    found = cut(ordered.mapInArrow(_linked(limit), "rep long, links long, u long, v long"), "links")
    counts = found.where("rep is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    comp = cut(components(found.where("u is not null").select("u", "v")).withColumnRenamed("id", "rep"), "components")
    least = comp.join(classes.select("rep", "id"), "rep").groupBy("component").agg(F.min("id").alias("least"))
    known = classes.join(counts, "rep", "left").join(comp.join(least, "component").select("rep", "least"), "rep", "left")
    known = known.select("label", "embedding", "size", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    same = F.struct("label", "embedding").alias("same")
    linked = salted(used.select("vec_id", same), known.select(same, "size", "n_links", "component_id"), "same", "size", used.count(), "vec_id").select("vec_id", "n_links", "component_id")
    alone = rows.where("not __in").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_e8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.98 within a label."""
    return near_vectors(read(spark, sf_dir, "embeddings"))


ORACLE = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where embedding is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as u, b.vec_id as v from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98
), reach as (
  select vec_id as id, vec_id as to_id from embeddings
  union select r.id, l.v from reach r join links l on l.u = r.to_id
), c as (select id, min(to_id) as component_id from reach group by id
), n as (select u, count(*) as n from links group by u)
select x.vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, c.component_id, x.vec_id = c.component_id as kept
from embeddings x join c on c.id = x.vec_id left join n on n.u = x.vec_id
"""
