"""Plans that should stay as they are: no Python in regex stages, columns and filters in the scan."""

import pytest
from pyspark.sql import functions as F

from archspark.operators import components as C
from archspark.operators import symbols
from archspark.plans import registry
from archspark.plans.analyze import file_facts

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_extraction_is_native(spark):
    files = spark.createDataFrame([("r", "a.py", "python", "import os")], "repo string, path string, language string, content string")
    shown = plan(file_facts(files))
    assert "Python" not in shown and "Arrow" not in shown and "Exchange" not in shown


def test_owner_lookup_is_an_equality_join(spark):
    rows = spark.range(10).select(F.lit("r").alias("repo"), F.concat(F.lit("a/b/"), F.col("id").cast("string")).alias("path"))
    shown = plan(C.owners(rows, rows.limit(2)))
    assert "NestedLoop" not in shown and "Cartesian" not in shown


def test_only_needed_columns_are_read(spark):
    shown = plan(registry.connection_counts(spark, SF))
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>" in shown
    assert "n_chars" not in plan(registry.component_metrics(spark, SF))


def test_tree_queries_have_no_cross_join(spark):
    for name in ("top_level", "import_edges", "port_edges", "induced_edges"):
        assert "CartesianProduct" not in plan(registry.QUERIES[name](spark, SF))


def test_visible_components_are_not_one_partition(spark):
    from archspark.operators import views

    comps = spark.createDataFrame([("a", None, "project", []), ("b", "a", "module", ["x"]), ("c", "a", "service", [])], "id string, parent_id string, type string, files array<string>")
    edges = spark.createDataFrame([], "source string, target string")
    shown = views.visible(comps, edges, "a")
    assert "Window" not in plan(shown) and [r.id for r in shown.collect()] == ["c"]


def test_trees_of_any_depth(spark):
    from archspark.operators import views

    n = 67
    chain = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(n)], "id string, parent_id string").coalesce(1)
    assert views.lineage(chain).selectExpr("max(size(trail))").first()[0] == n


def test_unreadable_entries_are_told(spark, tmp_path):
    from archspark.sources import tree

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("x = 1")
    (tmp_path / "gone.py").symlink_to(tmp_path / "nowhere")
    rows = {r.path: r.error for r in tree.read_tree(spark, {"t": str(tmp_path)}).collect()}
    assert rows["a"] is None and rows["a/x.py"] is None and "nowhere" in rows["gone.py"] or "gone.py" in rows["gone.py"]


def test_walks_are_split_below_the_top(tmp_path):
    from archspark.sources import tree

    for k in range(5):
        (tmp_path / "src" / f"p{k}" / "q").mkdir(parents=True)
    options = {"names": "t", "roots": str(tmp_path), "parts": "5"}
    parts = tree._Reader(options).partitions()
    assert sum(p.deep for p in parts) == 5 and sorted(p.rel for p in parts if not p.deep) == ["", "src"]


def test_a_flat_folder_is_read_by_several_tasks(spark, tmp_path):
    from archspark.sources import tree

    (tmp_path / "a" / "flat").mkdir(parents=True)
    for k in range(10_000):
        (tmp_path / "a" / "flat" / f"f{k:05d}.txt").write_text("x")
    parts = [p for p in tree._Reader({"names": "t", "roots": str(tmp_path)}).partitions() if p.rel == "a/flat"]
    assert len(parts) == 5 and not any(p.deep for p in parts)
    rows = tree.read_tree(spark, {"t": str(tmp_path)})
    assert rows.where("name like 'f%.txt'").count() == 10_000 and rows.select("path").distinct().count() == 10_002
    assert tree.name_ranges([("a", 1), ("b", tree.SPLIT_BYTES), ("c", 1)]) == [(None, "a"), ("b", "b"), ("c", None)]


def test_filters_reach_the_walk(spark, tmp_path):
    """What filters leave out is not read, and walks end where nothing is asked for."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, IsNull, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

    from archspark.sources import tree

    for path, text in {"src/a.py": "x = 1", "src/b.ts": "y", "src/deep/c.py": "z" * 50, "docs/d.py": "w", "e.py": ""}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "src" / "gone.py").symlink_to(tmp_path / "nowhere")
    roots = {"t": str(tmp_path), "u": str(tmp_path / "src")}
    every = tree.read_tree(spark, roots).collect()
    for filters, test in (
        ([EqualTo(("is_dir",), True)], lambda r: r.is_dir), ([Not(EqualTo(("is_dir",), True)), GreaterThan(("size",), 0)], lambda r: not r.is_dir and (r.size or 0) > 0), ([EqualTo(("dir",), "src")], lambda r: r.dir == "src"),
        ([In(("repo",), ("u", "x")), Not(EqualTo(("name",), "a.py"))], lambda r: r.repo == "u" and r.name != "a.py"), ([StringContains(("path",), "deep")], lambda r: "deep" in r.path), ([IsNotNull(("size",))], lambda r: r.size is not None),
        ([Not(GreaterThan(("size",), 3))], lambda r: r.size is not None and r.size <= 3), ([EqualTo(("path",), "src")], lambda r: r.path == "src"), ([EqualTo(("dir",), "")], lambda r: r.dir == ""),
        ([EqualTo(("repo",), "t"), StringStartsWith(("path",), "src/"), StringEndsWith(("name",), ".py"), LessThanOrEqual(("size",), 20)], lambda r: r.repo == "t" and r.path.startswith("src/") and r.name.endswith(".py") and r.size is not None and r.size <= 20),
    ):
        got = tree.read_tree(spark, roots, filters=filters)
        key = lambda r: (r.repo, r.path, bytes(r.content or b""))
        assert sorted(map(key, got.collect())) == sorted(key(r) for r in every if test(r)), filters
        assert got.count() == sum(map(bool, map(test, every)))  # the same rows again
    asked = {"names": "t\nu", "roots": "\n".join(roots.values()), "filters": tree.as_text([EqualTo(("repo",), "t"), StringStartsWith(("path",), "src/deep/")])}
    assert {(p.repo, p.rel) for p in tree._Reader(asked).partitions()} == {("t", ""), ("t", "src"), ("t", "src/deep")}
    for bad in (IsNull(("size",)), EqualTo(("content",), b"x"), GreaterThan(("name",), "a"), EqualTo(("error",), "x")):
        with pytest.raises(ValueError):
            tree.read_tree(spark, roots, filters=[bad])


def test_ranks_of_one_large_group(spark):
    """No window over rows and no single partition; ties, nulls and small groups beside a large one."""
    from archspark.operators.ranks import ranked

    data = [("big", k % 700, k, "x") for k in range(2000)] + [("small", 3, 1, "x"), (None, 2, 1, "y"), (None, 1, 2, "y"), ("big", None, 5, "x")]
    rows = spark.createDataFrame(data, "repo string, a int, b int, __group string")
    got = ranked(rows.drop("__group"), "repo", ["a", "b"])
    assert "Window" not in plan(got) and "SinglePartition" not in plan(got)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    want = {}
    for repo in ("big", "small", None):
        own = sorted((r for r in data if r[0] == repo), key=key)
        want |= {(repo, r[1], r[2]): k for k, r in enumerate(own, 1)}
    assert {(r.repo, r.a, r.b): r.rank for r in got.collect()} == want and got.count() == len(data)


def test_stored_tables_are_released(spark):
    import os

    from archspark.sources import storage

    kept = storage.cut(spark.range(5), "kept")
    with storage.released():
        inside = storage.cut(spark.range(7), "inside")
        assert inside.count() == 7
        path = inside.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert os.path.isdir(path)
    assert not os.path.exists(path) and kept.count() == 5


@pytest.mark.parametrize("name", ["python_symbols", *(f"{kind}_{language}" for kind in ("facts", "symbols") for language in ("swift", "python", "rust", "typescript", "go", "ruby"))])
def test_texts_of_a_small_table_are_dealt_to_tasks_and_parsed_in_place(spark, name):
    df = registry.QUERIES[name](spark, SF)
    shown = plan(df)
    assert "Join" not in shown and shown.count("Exchange") == 1
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert min(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()) > 0.7 * df.count() / df.rdd.getNumPartitions()


def test_files_of_trees_are_read_once(spark):
    """The tree is stored before it is used, and symbols are found in place: the plan neither walks it nor joins it with itself."""
    made = registry.QUERIES["scanned_trees"](spark, SF)
    shown = plan(made)
    assert "source_tree" not in shown and "_found(" in shown and "_parse(" not in shown


def test_symbols_in_place(spark):
    """The same symbols as by ``parsed``; languages without a parser have null."""
    files = spark.createDataFrame([("r", "a.py", "python", "def f():\n    return 1\n"), ("r", "b.md", "markdown", "# x"), ("r", "c.go", "go", None), ("r", "d.py", "python", "x = 1\n")], "repo string, path string, language string, content string")
    placed = symbols.with_symbols(files)
    want = {r["path"]: r["symbols"] for r in symbols.parsed(files).collect()}
    assert {r["path"]: r["symbols"] for r in placed.collect()} == want | {"b.md": None}
    assert "Exchange" not in plan(placed)
