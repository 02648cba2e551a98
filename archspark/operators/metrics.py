"""Counts and sums: per component, per repository, and over all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _languages(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the lines of each language and the language with most; of equal ones that met first."""
    per = rows.groupBy(*keys, "language").agg(F.sum("lines").alias("lines"), F.min("path").alias("first"))
    pair = F.struct("language", "lines")
    best = F.min_by("language", F.struct(-F.col("lines"), F.col("first")))
    return per.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("languages"), best.alias("main_language"))  # an entry for each known language


def component_metrics(files: DataFrame) -> DataFrame:
    """(repo, owner, files, lines, size_bytes, symbols, languages, main_language) of files' components."""
    sums = files.groupBy("repo", "owner").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.sum("size_bytes").alias("size_bytes"), F.sum("n_symbols").alias("symbols"))
    return sums.join(_languages(files, ["repo", "owner"]), ["repo", "owner"])


def with_metrics(comps: DataFrame, files: DataFrame) -> DataFrame:
    """comps with metrics, and with the main language where a marker gave none."""
    found = component_metrics(files).withColumnRenamed("owner", "path")
    rows = comps.join(found, ["repo", "path"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    languages = F.coalesce("languages", F.create_map().cast("map<string,bigint>"))
    metrics = F.struct(*[zero(c) for c in ("files", "lines", "size_bytes", "symbols")], languages.alias("languages"))
    return rows.select(*[c for c in comps.columns if c != "language"], F.coalesce("language", "main_language").alias("language"), metrics.alias("metrics"))


def repository_stats(files: DataFrame, comps: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each repository; screens are not counted as components."""
    sums = files.groupBy("repo").agg(F.count(F.lit(1)).alias("total_files"), F.sum("lines").alias("total_lines"), F.sum("size_bytes").alias("total_size_bytes"), F.sum("n_symbols").alias("total_symbols"))
    out = comps.groupBy("repo").agg(F.count(F.lit(1)).alias("total_components")).join(sums, "repo", "left").join(_languages(files, ["repo"]), "repo", "left")
    out = out.join(edges.groupBy("repo").agg(F.count(F.lit(1)).alias("total_relationships")), "repo", "left")
    numbers = ["total_files", "total_lines", "total_size_bytes", "total_symbols", "total_components", "total_relationships"]
    return out.select("repo", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("languages", F.create_map().cast("map<string,bigint>")).alias("languages"), "main_language")


def merged_stats(stats: DataFrame, cross_edges: int = 0) -> DataFrame:
    """One row over all repositories; each repository counts as a component, each edge between them as an edge."""
    numbers = ["total_files", "total_lines", "total_size_bytes", "total_symbols", "total_components", "total_relationships"]
    sums = stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers], F.count(F.lit(1)).alias("repos"))
    sums = sums.withColumn("total_components", F.col("total_components") + F.col("repos")).withColumn("total_relationships", F.col("total_relationships") + cross_edges)
    per = stats.select(F.explode("languages").alias("language", "lines")).groupBy("language").agg(F.sum("lines").alias("lines"))
    languages = per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "lines")))).alias("languages"))  # an entry for each known language
    return sums.select(*numbers).join(languages)


def language_breakdown(stats: DataFrame) -> DataFrame:
    """(repo, language, lines), most lines first."""
    return stats.select("repo", F.explode("languages").alias("language", "lines")).orderBy("repo", F.col("lines").desc(), "language")
