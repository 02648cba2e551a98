"""The JSON document in parts against the one that the driver makes."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from archspark.plans import disk_queries, registry
from archspark.sources import export

COMPONENT = "repo string, id string, parent_id string, path string, name string, type string, language string, port long, files array<string>, config_files array<struct<type:string,path:string>>, metrics struct<files:long,languages:map<string,long>>, docs struct<purpose:string,routes:array<struct<method:string,path:string>>>"


def architecture(spark, comps, many=3):
    edges = spark.range(many).select(F.col("id").cast("string").alias("source"), F.lit("é\"\n}").alias("target"), F.lit("http").alias("type"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("protocol"), F.col("id").alias("port"), F.lit(False).alias("bidirectional"), (F.col("id") % 2).alias("stage"), F.struct(F.col("id").alias("k0")).alias("at"))
    symbols = spark.range(many).select(F.col("id").cast("string").alias("id"), F.lit("{x]},").alias("name"), F.lit("all").alias("repo"), F.lit(0).alias("ordinal"), (-F.col("id")).alias("rank"))
    files = spark.range(many).select(F.lit("all").alias("repo"), F.concat(F.lit("f"), "id").alias("path"), F.lit(None).cast("string").alias("module_doc"))
    stats = spark.createDataFrame([(many, {"go": 1})], "total_files long, languages map<string,long>")
    info = spark.createDataFrame([("b", None), ("a", "url")], "repo string, repository string")
    return SimpleNamespace(name="n", description=None, repository=None, generated_at="now", root_path="", components=comps, relationships=edges, symbols=symbols, files=files, stats=stats, info=info)


def components(spark):
    """Screens before others, then by path; one below an unknown parent is left out; names hold what ends and begins objects."""
    row = lambda id_, parent, path, name="x", config=None, metrics=None, docs=None: ("all", id_, parent, path, name, "t", None, None, [], config, metrics, docs)
    rows = [row("r", None, "", "]}"), row("q", None, "z", '{"children":['), row("r/b", "r", "b", config=[("a", None), (None, None)]), row("r/a", "r", "a", "\n,é", metrics=(1, {"go": 2}), docs=(None, [("GET", None)])), row("r/__ui__/s", "r", "x"), row("lost", "nowhere", "l")]
    rows += [row(f"r/a/{i}", "r/a", f"{i:03d}") for i in range(40)] + [row(f"deep{i}", f"deep{i - 1}" if i else "r/b", "d") for i in range(3)]
    return spark.createDataFrame(rows, COMPONENT)


@pytest.mark.parametrize("many", [0, 25])
@pytest.mark.parametrize("compact", [True, False])
def test_parts_are_the_document(spark, tmp_path, many, compact):
    arch = architecture(spark, components(spark), many)
    stats = export.save_json(arch, str(tmp_path / "out" / "a.json"), compact)
    assert json.loads((tmp_path / "out" / "a.json").read_text(encoding="utf-8")) == json.loads(json.dumps(export.document(arch)))
    assert stats["stats"]["total_files"] == many


def test_no_components(spark, tmp_path):
    arch = architecture(spark, components(spark).limit(0))
    export.save_json(arch, str(tmp_path / "a.json"))
    assert json.loads((tmp_path / "a.json").read_text())["components"] == []


def test_tree_of_many_files(spark, tmp_path, monkeypatch):
    """Files of seven lines: most begin inside components of earlier files."""
    monkeypatch.setattr(export, "FILE_LINES", 7)
    arch, want = architecture(spark, components(spark)), []
    export.write_document(arch, str(tmp_path / "d"))
    todo = [(c, 0) for c in export.tree(arch.components)]
    while todo:
        c, depth = todo.pop()
        want.append((c["id"], depth, len(c["children"])))
        todo += [(x, depth + 1) for x in c["children"]]
    assert sorted(map(tuple, export.document_tree(spark, str(tmp_path / "d")).collect())) == sorted(want)
    assert export.document_list(spark, str(tmp_path / "d"), "files").count() == 3


def test_cycle(spark, tmp_path):
    comps = spark.createDataFrame([("all", "a", None, "", "x", "t", None, None, [], None, None, None), ("all", "a", "a", "", "x", "t", None, None, [], None, None, None)], COMPONENT)
    with pytest.raises(ValueError, match="cycle"):
        export.write_document(architecture(spark, comps), str(tmp_path / "d"))


def test_query_makes_nothing_whole_on_the_driver(spark, monkeypatch):
    def whole(*_):
        raise AssertionError("tables are brought to the driver")

    monkeypatch.setattr(export, "document", whole)
    monkeypatch.setattr(export, "tree", whole)
    made = registry.QUERIES["exported_document"](spark, "/root/testdata/sf0.001")
    assert made.where("what = 'files'").first()["n"] == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert disk_queries.exported_document.__doc__
