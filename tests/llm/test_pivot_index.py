"""Exact search against brute force."""

import math

import numpy as np
import pytest

from archspark.llm import pivot_index


def plain(rows, queries, k):
    """{query id: [(vec_id, score)]} by whole numbers."""
    whole = lambda v: None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * float(x)) for x in v]
    have = [(i, whole(v)) for i, v in rows if i is not None and whole(v) is not None]
    out = {}
    for q, v in sorted(((q, whole(v)) for q, v in queries if q is not None and whole(v) is not None), reverse=True):
        found = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, x in have if i != q and len(x) == len(v))[:k]
        out[q] = [(i, -s) for s, i in found]
    return {q: v for q, v in out.items() if v}


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


SCHEMA = "vec_id long, embedding array<float>, rank int, score double, v string, dim int"


def check(spark, rows, queries, k=5, schema=SCHEMA, **how):
    table = lambda x: spark.createDataFrame([(i, v, 1, 2.0, "v", 3) for i, v in x], schema)
    assert answers(pivot_index.largest_products(table(rows), table(queries), k, **how)) == plain(rows, queries, k)


@pytest.mark.parametrize("block_rows", [64, 4096])
def test_clusters(spark, block_rows):
    """Near groups, rows of unlike lengths, many equal rows, several blocks and groups of queries."""
    rng = np.random.default_rng(block_rows)
    centre = rng.standard_normal((12, 16))
    x = (centre[rng.integers(0, 12, 900)] + 0.05 * rng.standard_normal((900, 16))) * rng.uniform(0.2, 3, (900, 1))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(5000 + i, rows_v) for i, rows_v in enumerate([x[3].astype(np.float32).tolist()] * 300)]
    check(spark, rows, [r for r in rows if r[0] % 25 == 0], block_rows=block_rows, query_bytes=30 * 136, pivots=8)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(40)]
    rows += [(50, None), (100, []), (101, []), (150, [None, 1.0, 1.0]), (200, [float("nan"), 1.0, 1.0]), (250, [float("inf"), 0.0, 1.0]), (300, [0.0, 0.0, 0.0]), (350, [1.0]), (400, [2.0]), (None, [1.0, 1.0, 1.0]), (450, [1e30, -1e30, 3.0]), (7, [9.0, 9.0, 9.0]), (7, [9.0, 9.0, 9.0]), (500, [1.0, 2.0, 3.0, 4.0])]
    queries = [r for r in rows if r[0] is not None and r[0] % 50 == 0 and r[0] != 450] + [(0, rows[1][1])]
    check(spark, [r for r in rows if r[0] != 450], queries)
    assert not pivot_index.largest_products(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], SCHEMA), 5).count()


def test_products_beyond_doubles(spark):
    """Whole numbers where sums leave 2^53, and the nearest long where they leave 64 bits."""
    rng = np.random.default_rng(2)
    schema = SCHEMA.replace("array<float>", "array<double>")
    rows = [(i, (rng.integers(-(2**40), 2**40, 6) / 256.0).tolist()) for i in range(60)]
    rows += [(100 + i, [float(2**39) / 256 + i / 256, 1 / 256, 0, 0, 0, 0]) for i in range(8)]
    rows = [(i, [x / 2**10 for x in v]) for i, v in rows]
    check(spark, rows, rows[:6] + rows[-3:], schema=schema)
    big = [(i, [1e30 * (i + 1), 1.0]) for i in range(4)]
    table = spark.createDataFrame([(i, v, 1, 2.0, "v", 3) for i, v in big], SCHEMA)
    got = answers(pivot_index.largest_products(table, table.where("vec_id = 0"), 3))
    assert [s for _, s in got[0]] == [(1 << 63) - 1] * 3


def test_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(3)
    order = rng.permutation(1200)
    rows = [(int(i), [float(k % 3), 1.0]) for k, i in enumerate(order)]
    check(spark, rows, [r for r in rows if r[0] % 100 == 0], block_rows=100)


def test_bounds_spare_work():
    """On clustered rows most pairs are ruled out, and none that counts."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((40, 32)) * 256
    x = np.floor(centre[rng.integers(0, 40, 4000)] + 6 * rng.standard_normal((4000, 32)))
    pivots = pivot_index.Pivots(float((x * x).sum(axis=1).max()), {})
    pivots.points[32] = pivot_index.centres(pivots.raised(x), 40)
    d = pivots.distances(pivots.raised(x))
    own = d.argmin(axis=1)
    by = np.lexsort((d[np.arange(len(x)), own], own))
    block = pivot_index.Annuli.loaded(32, by.astype("<i8").tobytes(), own[by].astype("<i4").tobytes(), d[by, own[by]].astype("<f8").tobytes(), x[by].astype("<f8").tobytes())
    asked = pivot_index.Asked.of(np.arange(100), x[:100], pivots, 5, {})
    block.seed(asked)
    asked.best = [[] for _ in asked.ids]
    compared = block.expand(asked)
    for q in range(100):
        want = sorted((-int(s), i) for i, s in enumerate((x @ x[q]).tolist()) if i != q)[:5]
        assert asked.best[q] == want
    assert compared < 0.5 * 100 * 4000


def test_index_holds_every_row_once(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i % 500, rng.integers(-9, 9, 4).astype(float).tolist()) for i in range(1500)] + [(9, [1.0, 1.0, 1.0, 1.0])] * 1000, "vec_id long, v array<double>")
    blocks = pivot_index.index(rows, pivot_index.fitted(rows, 8), 128).collect()
    ids = np.concatenate([np.frombuffer(b.ids, "<i8") for b in blocks])
    assert len(ids) == 2500 and max(len(b.ids) // 8 for b in blocks) <= 128
    assert sorted(ids.tolist()) == sorted([i % 500 for i in range(1500)] + [9] * 1000)
    for b in blocks:
        assert (np.diff(np.frombuffer(b.pivots, "<i4")) >= 0).all()
