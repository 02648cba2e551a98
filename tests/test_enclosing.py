"""The deepest enclosing directory, against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from archspark.operators import components as C
from archspark.operators.enclosing import enclosing


def plain(place, tops):
    """By the definition: the longest of the directories at or above."""
    if place == "":
        return "" if "" in tops else None
    parts = place.split("/")
    above = ["", *("/".join(parts[: k + 1]) for k in range(len(parts)))]
    return next((p for p in reversed(above) if p in tops), None)


def run(spark, places, tops, range_rows):
    rows = spark.createDataFrame([(r, p) for r, p in places], "repo string, place string")
    dirs = spark.createDataFrame([(r, p) for r, p in tops], "repo string, path string")
    got = {(r.repo, r.place): r.top for r in enclosing(rows, dirs, range_rows).collect()}
    by = {}
    for r, p in tops:
        by.setdefault(r, set()).add(p)
    want = {(r, p): plain(p, by.get(r, set())) for r, p in places}
    assert got == {k: v for k, v in want.items() if v is not None}


@pytest.mark.parametrize("range_rows", [3, 40, 10_000])
def test_sweep(spark, range_rows):
    """Several repositories, names that sort between a directory and what is in it, ranges that begin deep inside open directories."""
    rng = random.Random(range_rows)
    names = ["a", "a-b", "a b", "a.b", "b", "A", "é", "z", "\x01", "a€"]
    path = lambda: "/".join(rng.choice(names) for _ in range(rng.randrange(0, 6)))
    places = [(rng.choice("qrs"), path()) for _ in range(400)]
    tops = [(r, p) for r, p in {(rng.choice("qr"), path()) for _ in range(60)}]
    run(spark, places, tops, range_rows)
    run(spark, places, [*tops, ("q", ""), ("s", "")], range_rows)


@pytest.mark.parametrize("range_rows", [20, 10_000])
def test_deep_trees(spark, range_rows):
    """Two hundred levels, with a directory open at every third and borders inside."""
    deep = ["d"] * 200
    places = [("r", "/".join(deep[:k]) + ("/x" if k % 2 and k else "")) for k in range(201)]
    tops = [("r", "/".join(deep[:k])) for k in range(0, 201, 3)]
    run(spark, places, tops, range_rows)


def test_no_places_and_no_tops(spark):
    run(spark, [], [("r", "a")], 10)
    run(spark, [("r", "a"), ("r", "")], [], 10)


def test_nearest_keeps_rows_and_columns(spark):
    rows = spark.createDataFrame([("r", "", 1, "t"), ("r", "a/b/c.py", 2, "t"), ("r", "a/b/c.py", 3, "t"), ("r", "a", 4, "t"), ("q", "a/x", 5, "t")], "repo string, path string, n int, top string")
    comps = spark.createDataFrame([("r", ""), ("r", "a"), ("r", "a/b/c.py")], "repo string, path string")
    got = C.nearest(rows, comps, "owner")
    assert got.columns == ["repo", "path", "n", "top", "owner"]
    assert sorted((r.n, r.owner) for r in got.collect()) == [(1, None), (2, "a"), (3, "a"), (4, ""), (5, None)]
    nested = C.nested_in(rows, spark.createDataFrame([("r", "a"), ("r", "a/b/c.py")], "repo string, path string"))
    assert [(r.repo, r.path) for r in nested.collect()] == [("r", "a/b/c.py")]


def test_no_key_stands_for_a_tree(spark):
    """A row a place and no more: neither ancestors nor the root are exploded, and rows are not shuffled by their repository."""
    rows = spark.range(500).select(F.lit("r").alias("repo"), F.concat(F.lit("a/b/c/d/e/f"), F.col("id").cast("string"), F.lit("/x")).alias("path"))
    comps = rows.limit(3).select("repo", F.lit("a").alias("path")).distinct()
    shown = C.owners(rows, comps)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in shown and "explode" not in shown
    dealt = [line for line in shown.splitlines() if "hashpartitioning(" in line]
    assert all("place" in line for line in dealt)
