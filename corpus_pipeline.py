"""A corpus made ready for training: four stages, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.llm import langid, minhash, packing, quality
from archspark.llm.common import cut, read, spread

#: Documents whose most likely language is less likely than this go, as do those without a letter.
LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language; the columns of docs.

    Each row is judged by its own text, whatever its id: null and repeated ids are rows like others, repeated rows stay
    all or none. Null and empty texts and texts without a letter go. A null lang is not learned from; with no lang at
    all every document goes. An empty table gives no rows; further columns of any name are carried.
    """
    known = langid.recognises(spark, langid.train(docs), LANGUAGE_SCORE)
    return spread(docs).where(known(F.col("text").cast("string")))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least the operator's threshold; the columns of docs.

    Each row is judged by its own text, whatever its id: null and repeated ids are rows like others, repeated rows stay
    all or none. Null and empty texts have the score of a text whose measures are all 0; a score that ties the threshold
    stays. Without labels every score is 0.5. An empty table gives no rows; further columns of any name are carried.
    """
    good = quality.reaches(spark, quality.train(docs, read(spark, sf_dir, "labels")), quality.THRESHOLD)
    return spread(docs).where(good(F.col("text").cast("string")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, 0.8), that with the smallest id; the columns of docs.

    Null ids come last; of rows with equal texts, repeated ids or null ids included, one stays, and of equal ids any one. Rows
    without words (null and empty texts too) are in no group and stay. An empty table gives no rows; further columns of any
    name are carried. Ids may be null or repeated, so rows get a key, which is stored with them: one made again could be
    another after an executor is lost.
    """
    key = _free_name(docs)
    rows = cut(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    found = minhash.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), width=5, percent=80).select(F.col("doc_id").alias(key), "component_id")
    ids = found.join(rows.select(key, F.col("doc_id").alias("id")), key)
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", key)).alias("first"))
    return rows.join(first.select(F.col("first")[key].alias(key)), key, "left_semi").drop(key)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of 1024 tokens.

    A null or empty text has the end id alone; null and repeated ids are documents like others, each packed. Pieces of one
    length are told apart by id, piece and checksum, so that it does not matter which of equal rows is where. An empty
    table gives no rows; other columns are not carried.
    """
    return packing.pack(docs)


def _free_name(docs: DataFrame) -> str:
    """A column name that docs does not have."""
    name, have = "__row", {c.lower() for c in docs.columns}
    while name in have:
        name += "_"
    return name


STAGES = [("language ID", language_id), ("quality classifier", quality_filter), ("MinHash near-dedup", near_dedup), ("best-fit packing", best_fit)]

#: SQL can't express a trained classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, "stage")
    return docs
