"""Which of a repository's names stand in which of its texts, by automata (Aho and Corasick, 1975).

The names of a repository are cut into shards of about ``SHARD_WORDS``, its distinct texts into buckets of about
``BUCKET_TEXTS``. A group is one shard with one bucket: it makes the shard's automaton and runs each
text through it once, whatever the number of names. A row is a name or a text; there are none for pieces of texts, and
a repository with most texts is as many groups as it has buckets.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_WORDS = 20_000
BUCKET_TEXTS = 50_000

GROUP = ["repo", "shard", "bucket"]


def dealt(texts: DataFrame, words: DataFrame, shard_words: int = SHARD_WORDS, bucket_texts: int = BUCKET_TEXTS) -> tuple[DataFrame, DataFrame]:
    """(texts, words) by group: each text once for each shard of its repository's words, each word once for each bucket of its texts.

    Hashes deal them evenly. Texts and words (repo, text or word) are distinct; null and empty ones are left out.
    """
    fresh = lambda rows, c: rows.where(F.col(c) != "").select(F.col("repo").alias("repo"), c).distinct()  # noqa: E731  # columns of their own: both may come from one table
    texts, words = fresh(texts, "text"), fresh(words, "word")
    many = lambda rows, n, out: rows.groupBy("repo").agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(out))
    sizes = many(words, shard_words, "shards").join(many(texts, bucket_texts, "buckets"), "repo")
    turn = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    by_shard = texts.join(sizes, "repo").select("repo", turn("shards").alias("shard"), own("text", "buckets").alias("bucket"), "text")
    by_bucket = words.join(sizes, "repo").select("repo", own("word", "shards").alias("shard"), turn("buckets").alias("bucket"), "word")
    return by_shard, by_bucket


def _searched(texts: pa.Table, words: pa.Table) -> pa.Table:
    found: tuple[list, list, list] = ([], [], [])
    if words.num_rows and texts.num_rows:
        repo, automaton = texts.column("repo")[0].as_py(), ahocorasick.Automaton()
        for w in words.column("word").to_pylist():
            automaton.add_word(w, w)
        automaton.make_automaton()
        for text in texts.column("text").to_pylist():
            for w in {w for _, w in automaton.iter(text)}:
                for column, value in zip(found, (repo, text, w), strict=True):
                    column.append(value)
    return pa.table([pa.array(c, pa.string()) for c in found], names=["repo", "text", "word"])


def matches(texts: DataFrame, words: DataFrame, shard_words: int = SHARD_WORDS, bucket_texts: int = BUCKET_TEXTS) -> DataFrame:
    """(repo, text, word) of the texts (repo, text) and the words (repo, word) that they contain, each pair once."""
    by_shard, by_bucket = dealt(texts, words, shard_words, bucket_texts)
    return by_shard.groupBy(*GROUP).cogroup(by_bucket.groupBy(*GROUP)).applyInArrow(_searched, "repo string, text string, word string")


def containing(texts: DataFrame, words: DataFrame, text: str, word: str) -> DataFrame:
    """texts (repo, ...) joined with the words (repo, ...) that they contain."""
    pairs = matches(texts.select("repo", F.col(text).alias("text")), words.select("repo", F.col(word).alias("word")))
    pairs = pairs.select("repo", F.col("text").alias(text), F.col("word").alias(word))
    return texts.join(pairs, ["repo", text]).join(words, ["repo", word])
