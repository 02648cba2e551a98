"""Names in texts, against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from archspark.operators import names


def tables(spark, texts, words):
    return spark.createDataFrame(texts, "repo string, text string"), spark.createDataFrame(words, "repo string, word string")


def plain(texts, words):
    return {(r, t, w) for r, t in texts for q, w in words if r == q and t and w and w in t}


@pytest.mark.parametrize(("shard", "bucket"), [(3, 4), (1, 1000), (1000, 1), (20_000, 50_000)])
def test_matches(spark, shard, bucket):
    rng = random.Random(shard)
    letters = "ab:/é"
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    texts = [(rng.choice("rs"), word(14)) for _ in range(120)] + [("r", None), ("only texts", "ab")]
    words = [(rng.choice("rs"), word(4)) for _ in range(40)] + [("r", None), ("only words", "ab")]
    got = names.matches(*tables(spark, texts, words), shard, bucket).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == plain(texts, words)


def test_a_repository_of_like_addresses_is_many_groups(spark):
    """All addresses begin alike, as does one name: no group has more than its share, and no row stands for a piece."""
    texts = spark.range(6000).select(F.lit("r").alias("repo"), F.concat(F.lit("http://host"), F.col("id").cast("string"), F.lit(":80/path")).alias("text"))
    words = spark.range(90).select(F.lit("r").alias("repo"), F.concat(F.lit("host"), F.col("id").cast("string"), F.lit(":")).alias("word")).unionByName(spark.createDataFrame([("r", "http"), ("r", "://")], "repo string, word string"))
    by_shard, by_bucket = names.dealt(texts, words, shard_words=50, bucket_texts=500)
    sizes = [r["count"] for r in by_shard.groupBy(*names.GROUP).count().collect()]
    assert sum(sizes) == 6000 * 2 and len(sizes) == 24 and max(sizes) < 650
    sizes = [r["count"] for r in by_bucket.groupBy(*names.GROUP).count().collect()]
    assert sum(sizes) == 92 * 12 and max(sizes) < 75
    found = names.matches(texts, words, 50, 500)
    assert {r["word"]: r["count"] for r in found.where("word in ('http', '://', 'host7:')").groupBy("word").count().collect()} == {"http": 6000, "://": 6000, "host7:": 1}
    shown = names.containing(*tables(spark, [("r", "http://a")], [("r", "a")]), "text", "word")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in shown and "Cartesian" not in shown


def test_rows_keep_their_columns(spark):
    texts = spark.createDataFrame([("r", "http://api-one:80", 1), ("r", "x", 2), ("r", "x", 3)], "repo string, low string, n int")
    words = spark.createDataFrame([("r", "api-one", "a"), ("r", ":80", "b"), ("r", ":80", "c"), ("r", "x", "d"), ("q", "x", "e")], "repo string, sign string, target string")
    got = names.containing(texts, words, "low", "sign")
    assert sorted((r.n, r.sign, r.target) for r in got.collect()) == [(1, ":80", "b"), (1, ":80", "c"), (1, "api-one", "a"), (2, "x", "d"), (3, "x", "d")]
