from archspark.streaming import annotations


def test_versions(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = lambda *r: spark.createDataFrame(list(r), annotations.LOG).coalesce(1).write.mode("append").parquet(source)
    run = lambda: annotations.keep(spark.readStream.schema(annotations.LOG).parquet(source), out, str(tmp_path / "cp")).awaitTermination()
    rows(("1", "c", "component", "c", "", "a", None, 1), ("2", "c", "file", "f", "", "x", None, 2))
    run()
    rows(("3", "c", "component", "c", "", "b", None, 3))
    run()
    assert {(r["id"], r["text"]) for r in annotations.state(spark, out, 1).collect()} == {("3", "b"), ("2", "x")}
    assert annotations.state(spark, out, -1).count() == 0


def test_only_touched_buckets_are_written_and_old_versions_go(spark, tmp_path):
    source, out = str(tmp_path / "in"), tmp_path / "out"
    rows = lambda *r: spark.createDataFrame(list(r), annotations.LOG).coalesce(1).write.mode("append").parquet(source)
    run = lambda: annotations.keep(spark.readStream.schema(annotations.LOG).parquet(source), str(out), str(tmp_path / "cp")).awaitTermination()
    texts = lambda n: {r["targetId"]: r["text"] for r in annotations.state(spark, str(out), n).collect()}
    seen = {}
    rows(*[(str(i), "c", "file", f"f{i}", "", "old", None, i) for i in range(300)])
    run()
    seen |= {f"f{i}": "old" for i in range(300)}
    assert texts(0) == seen
    for n in range(1, 5):
        rows((f"n{n}", "c", "file", "f7", "", f"text {n}", None, 1000 + n), (f"m{n}", "c", "file", None, "", " ", None, 2000 + n), (f"k{n}", f"k{n}", "symbol", None, "", "s", None, 3000 + n))
        run()
        before, seen = seen, seen | {"f7": f"text {n}", f"k{n}": "s"}
        assert texts(n) == seen and texts(n - 1) == before
        assert len(list(out.glob(f"version={n}/bucket=*"))) <= 3
    held = [p.name for p in out.glob("version=*/bucket=*")]
    assert max(map(held.count, held)) <= 2


def test_a_batch_that_is_run_again_replaces_its_own_version(spark, tmp_path):
    import shutil

    source, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "cp"
    rows = lambda *r: spark.createDataFrame(list(r), annotations.LOG).coalesce(1).write.mode("append").parquet(source)
    run = lambda: annotations.keep(spark.readStream.schema(annotations.LOG).parquet(source), out, str(cp)).awaitTermination()
    for n in range(3):
        rows(("a", "c", "file", "f", "", f"text {n}", None, n), (f"b{n}", "c", "file", f"g{n}", "", "x", None, 10 + n))
        run()
    want = sorted(map(str, annotations.state(spark, out, 2).collect()))
    for done in (cp / "commits" / "2", cp / "commits" / ".2.crc"):
        if done.exists():
            done.unlink()
    shutil.rmtree(f"{out}/version=2")
    run()
    assert sorted(map(str, annotations.state(spark, out, 2).collect())) == want and len(want) == 4
