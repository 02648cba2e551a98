import random
import shutil

from pyspark.sql import functions as F

from archspark.operators import metrics
from archspark.streaming import changes, totals

COLUMNS = [c.split()[0] for c in totals.FILE.split(", ")]


def test_segments_cover_all_batches():
    for n in range(700):
        found = changes.covering(n)
        assert [b for first, last in found for b in range(first, last + 1)] == list(range(n + 1))
        assert len(found) <= (changes.FAN - 1) * 4
        assert set(found) <= {(b, b) for b in range(n + 1)} | {s for b in range(n + 1) for s in changes.completed(b)}
        for first, last in changes.completed(n):
            assert set(changes.covering(n - 1)) | {(n, n), *changes.completed(n)} >= {(at, at + (last - first + 1) // 8 - 1) for at in range(first, last + 1, (last - first + 1) // 8)}


class Folder:
    """A stream's source, state and result."""

    def __init__(self, spark, tmp_path):
        self.spark, self.source, self.out, self.checkpoint = spark, str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "cp"

    def add(self, *rows):
        self.spark.createDataFrame(list(rows), totals.EVENT).coalesce(1).write.mode("append").parquet(self.source)

    def run(self, one_by_one=False):
        stream = self.spark.readStream.schema(totals.EVENT)
        if one_by_one:
            stream = stream.option("maxFilesPerTrigger", 1)
        totals.keep(stream.parquet(self.source), self.out, str(self.checkpoint)).awaitTermination()

    def files(self, n):
        return sorted(tuple(r[c] for c in COLUMNS) for r in totals.files(self.spark, self.out, n).collect())


def plain(df):
    return sorted((r.asDict() for r in df.select("repo", "owner", "files", "lines", "size_bytes", "symbols", "languages", "main_language").collect()), key=str)


def test_any_series_of_changes_gives_a_full_analysis(spark, tmp_path):
    """Files that come, change, move and go; ties of languages; batches enough for a merge of segments."""
    rng = random.Random(7)
    at, held, states = Folder(spark, tmp_path), {}, []
    for n in range(10):
        batch = []
        for path in rng.sample(range(30), 12):
            repo = f"r{path % 2}"
            if rng.random() < 0.25:
                batch.append((repo, f"p{path}", None, None, None, None, None, True, n))
                held.pop((repo, f"p{path}"), None)
            else:
                row = (f"o{rng.randrange(3)}", rng.choice(["go", "rust", "swift"]), rng.randrange(3), rng.randrange(100), rng.randrange(4))
                batch.append((repo, f"p{path}", *row, False, n))
                held[repo, f"p{path}"] = row
        at.add(*batch)
        states.append(sorted((*k, *v) for k, v in held.items()))
    at.run(one_by_one=True)
    assert at.files(9) == states[9] and at.files(8) == states[8]
    for n in (8, 9):
        files = spark.createDataFrame(states[n], totals.FILE)
        assert plain(totals.component_metrics(spark, at.out, n)) == plain(metrics.component_metrics(files))
    whole = {r["repo"]: r for r in totals.repository_totals(spark, at.out, 9).collect()}
    want = metrics.repository_stats(files, files.select("repo", F.col("owner").alias("path")).distinct(), files.select("repo").limit(0)).collect()
    assert {r["repo"]: (r["total_files"], r["total_lines"], r["languages"], r["main_language"]) for r in want} == {k: (r["files"], r["lines"], r["languages"], r["main_language"]) for k, r in whole.items()}
    kept = {p.name for p in (tmp_path / "out" / "sums").glob("segment=*")}
    assert kept == {"segment=0-7", "segment=8-8", "segment=9-9"}


def test_late_and_repeated_events_change_nothing(spark, tmp_path):
    at = Folder(spark, tmp_path)
    new, old, gone = ("r", "a", "o", "go", 5, 1, 1, False, 7), ("r", "a", "x", "rust", 9, 9, 9, False, 3), ("r", "b", None, None, None, None, None, True, 5)
    at.add(new, gone)
    at.run()
    at.add(old, new, new, ("r", "b", "o", "go", 1, 1, 1, False, 4), ("r", "c", "o", "go", 1, 2, 3, None, None))
    at.run()
    assert at.files(1) == [("r", "a", "o", "go", 5, 1, 1), ("r", "c", "o", "go", 1, 2, 3)]
    assert at.files(0) == [("r", "a", "o", "go", 5, 1, 1)]
    assert at.files(-1) == []


def test_of_equal_places_the_larger_values_hold_in_any_order(spark, tmp_path):
    a, b = ("r", "a", "o", "go", 1, 1, 1, False, 1), ("r", "a", "p", "go", 2, 1, 1, False, 1)
    found = []
    for k, rows in enumerate(((a, b), (b, a))):
        at = Folder(spark, tmp_path / str(k))
        for row in rows:
            at.add(row)
            at.run()
        found.append(at.files(1))
    assert found[0] == found[1] == [("r", "a", "p", "go", 2, 1, 1)]


def test_null_keys_are_keys(spark, tmp_path):
    at = Folder(spark, tmp_path)
    at.add((None, "a", "o", "go", 1, 1, 1, False, 1), ("r", None, "o", "go", 1, 1, 1, False, 1), (None, None, "o", "go", 1, 1, 1, False, 1))
    at.run()
    at.add((None, "a", "o", "go", 2, 1, 1, False, 2), (None, None, None, None, None, None, None, True, 2))
    at.run()
    found = totals.files(spark, at.out, 1).select("repo", "path", "lines").collect()
    assert set(map(tuple, found)) == {("r", None, 1), (None, "a", 2)} and len(found) == 2
    assert totals.language_lines(spark, at.out, 1).collect()[0]["lines"] == 3


def test_a_batch_that_is_run_again_gives_the_same(spark, tmp_path):
    at = Folder(spark, tmp_path)
    for n in range(3):
        at.add(("r", "a", f"o{n}", "go", n, n, n, False, n), ("r", f"b{n}", "o", "rust", 1, 1, 1, False, n))
        at.run()
    want = at.files(2), plain(totals.component_metrics(spark, at.out, 2))
    for done in (at.checkpoint / "commits" / "2", at.checkpoint / "commits" / ".2.crc"):
        if done.exists():
            done.unlink()
    shutil.rmtree(f"{at.out}/sums/segment=2-2")
    at.run()
    assert (at.files(2), plain(totals.component_metrics(spark, at.out, 2))) == want
    assert len(want[0]) == 4


def test_events_between_two_analyses(spark):
    before = spark.createDataFrame([("r", "a", "o", "go", 1, 1, 1), ("r", "b", "o", "go", 1, 1, 1), ("r", "c", None, "go", 1, 1, 1)], totals.FILE)
    after = spark.createDataFrame([("r", "a", "o", "go", 1, 1, 1), ("r", "b", "p", "go", 1, 1, 1), ("r", "d", "o", "go", 2, 2, 2), ("r", "c", None, "go", 1, 1, 1)], totals.FILE)
    found = sorted((r["path"], r["owner"], r["deleted"], r["seq"]) for r in totals.events(before, after, 4).collect())
    assert found == [("b", "p", False, 4), ("d", "o", False, 4)]
    assert [(r["path"], r["deleted"]) for r in totals.events(after, before.where("path <> 'c'"), 5).orderBy("path").collect()] == [("b", False), ("c", True), ("d", True)]
