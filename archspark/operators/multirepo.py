"""Several repositories as one architecture."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import values as V


def _prefixed(c: str) -> Column:
    return F.concat(F.col("repo"), F.lit("/"), F.col(c))


def _each(c: str) -> Column:
    return F.transform(c, lambda x: F.concat(F.col("repo"), F.lit("/"), x))


def with_prefixes(found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables whose ids and paths begin with their repository's name."""
    comps = found["components"].withColumns({"id": _prefixed("id"), "path": _prefixed("path"), "files": _each("files"), "parent_id": F.coalesce(_prefixed("parent_id"), F.concat(F.lit("repo:"), F.col("repo")))})
    edges = found["relationships"].withColumns({"source": _prefixed("source"), "target": _prefixed("target")})
    symbols = found["symbols"].withColumns({"id": _prefixed("id"), "file": _prefixed("file")})
    files = found["files"].withColumns({"path": _prefixed("path"), "symbols": _each("symbols")})
    return {**found, "components": comps, "relationships": edges, "symbols": symbols, "files": files}


def repository_nodes(comps: DataFrame, stats: DataFrame, info: DataFrame) -> DataFrame:
    """A component for each repository, above its own, with its sums."""
    shape = {f.name: f.dataType for f in comps.schema.fields}
    rows = stats.join(info, "repo", "left")
    said = F.nullif(F.col("description"), F.lit(""))
    empty = {f.name: F.array().cast(f.dataType) if f.dataType.typeName() == "array" else F.lit(None).cast(f.dataType) for f in shape["docs"].fields}
    docs = F.struct(*[(said if k == "purpose" else v).alias(k) for k, v in empty.items()])
    sums = F.struct(F.col("total_files").alias("files"), F.col("total_lines").alias("lines"), F.col("total_size_bytes").alias("size_bytes"), F.col("total_symbols").alias("symbols"), "languages")
    none = {"parent_id", "framework", "port"}
    values = {
        "repo": F.col("repo"), "id": F.concat(F.lit("repo:"), F.col("repo")), "path": F.concat(F.lit("@"), F.col("repo")), "name": F.col("repo"), "type": F.lit("repository"), "language": F.col("main_language"), "description": said, "metrics": sums, "docs": docs,
    }
    out = []
    for c, kind in shape.items():
        value = values.get(c, F.lit(None) if c in none else F.array() if kind.typeName() == "array" else F.lit(None))
        out.append(value.cast(kind).alias(c))
    return rows.select(*out)


RULE = "source_repo string, target_repo string, type string, label string, port long, bidirectional boolean"
REPOSITORY = "name string, path string, url string, ref string"


def read_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(solution, repositories, rules) of a configuration file, wherever Spark reads it.

    solution: (solution, description), one row; repositories: REPOSITORY and rules: RULE, both with ``i``, their place.
    """
    shape = f"solution string, description string, repositories array<struct<{REPOSITORY.replace(' string', ':string')}>>, cross_repo_relationships array<struct<{RULE.replace(' string', ':string').replace(' long', ':long').replace(' boolean', ':boolean')}>>"
    config = spark.read.schema(shape).json(path, multiLine=True)
    each = lambda c: config.select(F.posexplode(c).alias("i", "x")).select("i", "x.*")
    return config.select(F.coalesce("solution", F.lit("Solution")).alias("solution"), F.coalesce("description", F.lit("")).alias("description")), each("repositories"), each("cross_repo_relationships")


def cross_edges(spark: SparkSession, rules: list[dict] | DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between repositories that a configuration states; rules: its dictionaries, or a table of RULE with ``i``."""
    if isinstance(rules, list):
        rows = [(r.get("source_repo", ""), r.get("target_repo", ""), r.get("type"), r.get("label"), r.get("port"), bool(r.get("bidirectional", False)), i) for i, r in enumerate(rules)]
        rules = spark.createDataFrame(rows, f"{RULE}, i long")
    node = lambda c: F.concat(F.lit("repo:"), F.coalesce(c, F.lit("")))
    place = F.struct(F.lpad(F.col("i").cast("string"), 10, "0").alias("k0"), *[F.lit("").alias(k) for k in ("k1", "k2", "k3")])
    both = F.coalesce("bidirectional", F.lit(False)).alias("bidirectional")
    return rules.select(
        F.lit(None).cast("string").alias("repo"), node("source_repo").alias("source"), node("target_repo").alias("target"), F.coalesce("type", F.lit("http")).alias("type"), "label", F.col("type").alias("protocol"), "port", both, F.lit(99).alias("stage"), place.alias("at"),
    ).select(*edges.columns)


def placed(rules: list[dict], base: str) -> tuple[dict[str, str], list[tuple[str, str, str | None]]]:
    """(name -> directory, [(name, url, ref)]) of the repositories that a configuration names; paths are relative to base."""
    roots, remotes = {}, []
    for rule in rules:
        if rule.get("path"):
            path = os.path.normpath(os.path.join(base, rule["path"]))
            if not os.path.isdir(path):
                raise ValueError(f"{rule['name']}: {path} is not a directory")
            roots[rule["name"]] = path
        elif rule.get("url"):
            remotes.append((rule["name"], rule["url"], rule.get("ref")))
        else:
            raise ValueError(f"{rule.get('name', '?')} has neither path nor url")
    return roots, remotes


def analyze_all(spark: SparkSession, config_path: str, max_file_size: int = V.MAX_FILE_SIZE, max_symbols: int = V.MAX_SYMBOLS):
    """The merged architecture of the repositories that a configuration file names."""
    from ..plans.analyze import Architecture, tables
    from .metrics import merged_stats

    with open(config_path, encoding="utf-8") as f:
        config = json.load(f)
    rules = config.get("repositories") or []
    if not rules:
        raise ValueError("no repositories in the configuration")
    roots, remotes = placed(rules, os.path.dirname(os.path.abspath(config_path)))
    found = tables(spark, roots, max_file_size, max_symbols, remotes)
    crossing = config.get("cross_repo_relationships") or []
    merged = with_prefixes(found)
    nodes = repository_nodes(found["components"], found["stats"], found["info"])
    merged["components"] = merged["components"].unionByName(nodes)
    merged["relationships"] = merged["relationships"].unionByName(cross_edges(spark, crossing, merged["relationships"]))
    merged["stats"] = merged_stats(found["stats"], len(crossing))
    return Architecture(config.get("solution", "Solution"), config.get("description", ""), datetime.now(UTC).isoformat(), **merged)
