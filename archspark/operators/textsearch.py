"""Search with errors in a stored index: many phrases at once, by pairs of letters.

A field matches a phrase of m letters if some part of it turns into the phrase by at most ``allowed(m)`` edits (Sellers,
1980): two fifths of the phrase's letters, and so few that a pair of letters must stay. The phrase may have several words, and a long
field costs a match nothing: it is the part that counts.

``build`` stores each distinct text once, where it stands (row and field), and for each distinct pair of neighbouring letters of a
text a posting (gram, text), bucketed by the pair and a salt, so that a pair that most texts have is in as many buckets as there
are salts. ``search`` joins the phrases' pairs with the postings: of m - 1 pairs of a phrase at most two are lost by an edit, so that
texts with fewer than m - 1 - 2 ``allowed(m)`` of them are out without being looked at (the count filter). What is left is verified by the
bit-parallel edit distance (Myers, 1999), in Arrow batches, a text once for each phrase, however many rows have it. No text is
compared with a phrase that shares too little with it.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .. import values as V
from ..functions import text as T
from ..sources.storage import at_exit, cut, fresh_path

#: Fields with what their distance is multiplied by; less the multiple's excess over 1 is added.
FIELDS = {"name": 1.0, "path": 1.1, "kind": 1.2}
#: A pair's postings are dealt to so many buckets.
SALTS = 16


def allowed(length: Column) -> Column:
    """Edits that a phrase may be away."""
    return F.greatest(F.least(F.floor(length * V.SEARCH_THRESHOLD), F.floor((length - 2) / 2)), F.lit(0)).cast("int")


def grams(text: Column) -> Column:
    """The pairs of neighbouring letters, in order and with repeats."""
    return F.when(F.length(text) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, 2)))


@dataclass
class TextIndex:
    """texts: (text_id, text), distinct and in lower case; places: (text_id, field, key, type, id); postings: (gram, salt, text_id)."""

    texts: DataFrame
    places: DataFrame
    postings: DataFrame


def build(rows: DataFrame, buckets: int | None = None) -> TextIndex:
    """The index of rows (type, id, name, path, kind, ...); nulls and texts of one letter are in no pair. Rows that repeat are found each.

    buckets: of the postings, the session's shuffle partitions if not given.
    """
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    field = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.lower(c).alias("text")) for i, c in enumerate(FIELDS)]))
    cells = cut(rows.withColumn("key", F.monotonically_increasing_id()).select("key", "type", "id", field.alias("f")).select("key", "type", "id", "f.*").where("length(text) > 1"), "cells")
    texts = cut(cells.select("text").distinct().select(F.monotonically_increasing_id().alias("text_id"), "text"), "texts")
    places = cut(cells.join(texts, "text").select("text_id", "field", "key", "type", "id"), "places")
    path = fresh_path(spark, "postings")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    each = texts.select("text_id", F.explode(F.array_distinct(grams(F.col("text")))).alias("gram")).withColumn("salt", F.pmod(F.xxhash64("text_id"), F.lit(SALTS)).cast("int"))
    each.repartition(buckets, "gram", "salt").write.bucketBy(buckets, "gram", "salt").option("path", path).format("parquet").saveAsTable(name)
    at_exit(lambda: spark.sql(f"drop table if exists {name}"))
    return TextIndex(texts, places, spark.table(name))


def candidates(index: TextIndex, phrases: DataFrame) -> DataFrame:
    """(phrase, text_id) that share enough pairs; phrases: distinct lower-case ``phrase``."""
    own = phrases.where(F.length("phrase") >= V.SEARCH_MIN).select("phrase", (F.length("phrase") - 1 - 2 * allowed(F.length("phrase"))).alias("need"), F.explode(grams(F.col("phrase"))).alias("gram"))
    own = own.groupBy("phrase", "need", "gram").agg(F.count(F.lit(1)).alias("times")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = own.join(index.postings, ["gram", "salt"]).groupBy("phrase", "text_id").agg(F.sum("times").alias("met"), F.first("need").alias("need"))
    return met.where("met >= need").select("phrase", "text_id")


def part_distance(text: str, phrase: str) -> int:
    """The least edits between the phrase and any part of the text."""
    m = len(phrase)
    ones, last = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(phrase):
        at[c] = at.get(c, 0) | 1 << i
    up, down, now = ones, 0, m
    best = m
    for c in text:
        same = at.get(c, 0)
        d = ((((same & up) + up) ^ up) | same | down) & ones
        plus, minus = (down | ~(d | up)) & ones, up & d
        now += bool(plus & last) - bool(minus & last)
        best = min(best, now)
        plus, minus = plus << 1 & ones, minus << 1 & ones
        up, down = (minus | ~(d | plus)) & ones, plus & d
    return best


@F.arrow_udf(IntegerType())
def part_distances(text: pa.Array, phrase: pa.Array) -> pa.Array:
    return pa.array([part_distance(t, p) for t, p in zip(text.to_pylist(), phrase.to_pylist(), strict=True)], pa.int32())


def first_places(places: DataFrame, limit: int) -> DataFrame:
    """Of each text in each field the places that come first by type, id and key, as many as a phrase may have hits.

    No hit is lost: places of one text in one field are equally near to a phrase, so that one behind ``limit`` others is no hit by this text. Its row
    may be one by another text, with whose places it then stands.
    """
    order = Window.partitionBy("text_id", "field").orderBy("type", "id", "key")
    return places.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("place")


def search(index: TextIndex, phrases: DataFrame, limit: int = V.SEARCH_LIMIT) -> DataFrame:
    """(phrase, rank, type, id, score) of each phrase's best rows; phrases has a column ``phrase``.

    Phrases are taken without surrounding space and in lower case, each once; those of one letter find nothing. A field's distance is
    its edits over the phrase's letters, and up to 0.1 more for what else it holds; a row has its nearest field's, weighed.
    """
    asked = phrases.select(F.lower(T.stripped(F.col("phrase"))).alias("phrase")).where("phrase is not null").distinct()
    near = candidates(index, asked).join(index.texts, "text_id").withColumn("edits", part_distances("text", "phrase"))
    m = F.length("phrase")
    far = F.col("edits") / m + 0.1 * (1 - F.least(m / F.length("text"), F.lit(1.0)))
    near = near.where(F.col("edits") <= allowed(m)).select("phrase", "text_id", far.alias("far"))
    weight = F.element_at(F.array(*[F.lit(w) for w in FIELDS.values()]), F.col("field") + 1)
    found = near.join(first_places(index.places, limit), "text_id").groupBy("phrase", "key", "type", "id").agg(F.round(F.min(F.col("far") * weight + weight - 1), 6).alias("score"))
    order = Window.partitionBy("phrase").orderBy("score", "type", "id", "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("phrase", "rank", "type", "id", "score")
