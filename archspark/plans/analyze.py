"""From source trees to an architecture: files, symbols, components, relationships, stats.

Every repository given is analysed by the same jobs; the tables carry ``repo``. Two
tables are written to the shared folder on the way: the tree (so that sources are read once)
and the parsed files; everything else is one plan.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import values as V
from ..functions import text as T
from ..operators import components as C
from ..operators import docs, metrics, relationships, roles, symbols, uiflow
from ..sources.repositories import read_repositories
from ..sources.storage import cut
from ..sources.tree import read_tree, with_text

VERSION = "1.0.0"


@dataclass
class Architecture:
    """The tables of an analysis. ``merged`` ones have ids that begin with their repository's name."""

    name: str
    description: str | None
    generated_at: str
    components: DataFrame
    relationships: DataFrame
    symbols: DataFrame
    files: DataFrame
    stats: DataFrame
    info: DataFrame
    root_path: str = ""
    repository: str | None = None


def file_facts(files: DataFrame) -> DataFrame:
    """files with imports, framework, ports and endpoints, by column expressions alone."""
    lang, text = F.col("language"), F.col("content")
    parsed = lang.isin(V.PARSED_LANGUAGES)
    return (
        files.withColumn("imports", T.imports(lang, text)).withColumn("framework", T.framework(lang, text))
        .withColumn("ports", F.when(parsed, T.ports(text)).otherwise(F.array().cast("array<int>")))
        .withColumn("endpoints", T.endpoints(lang, text))
    )


def tables(spark: SparkSession, roots: dict[str, str], max_file_size: int = V.MAX_FILE_SIZE, max_symbols: int = V.MAX_SYMBOLS, remotes: list[tuple[str, str, str | None]] | None = None) -> dict[str, DataFrame]:
    """components, relationships, symbols, files, stats and info of the repositories roots (name -> directory) and remotes (name, url, ref)."""
    walked = read_tree(spark, roots, max_file_size) if roots or not remotes else None
    fetched = read_repositories(spark, remotes, max_file_size) if remotes else None
    entries = cut(walked if fetched is None else fetched if walked is None else walked.unionByName(fetched), "tree")
    if remotes and (failed := entries.where("path = '' and error is not null").select("error").limit(10).collect()):
        raise ValueError("; ".join(r["error"] for r in failed))
    texts = with_text(entries)
    foreign = C.vendored(entries)
    names = {r: os.path.basename(os.path.abspath(p)) for r, p in roots.items()} | {r: r for r, *_ in remotes or []}
    comps = cut(C.parents(C.components(entries, texts, foreign, names)), "discovered")
    files = C.owners(file_facts(C.source_files(texts, foreign, max_file_size)), comps)
    parsed = symbols.parsed(files)
    files = files.join(parsed, ["repo", "path"], "left").withColumn("symbols", F.coalesce("symbols", F.array().cast(f"array<{symbols.SYMBOL}>"))).withColumn("n_symbols", F.size("symbols").cast("long"))
    files = cut(files, "files")
    comps = roles.with_scan_facts(comps, files)
    comps = cut(roles.with_ports(roles.named(roles.demoted(roles.promoted(comps, files, texts)), texts), files), "components")
    screens, ui_edges = uiflow.ui_flows(comps, files)
    edges = cut(relationships.relationships(files, comps).select(*relationships.EDGE), "edges")
    edges = relationships.with_screens(edges, ui_edges)
    measured = docs.with_docs(metrics.with_metrics(comps, files), files, texts)
    measured = measured.join(relationships.external_services(files, comps).withColumnRenamed("source", "id"), ["repo", "id"], "left")
    owned = files.groupBy("repo", F.col("owner").alias("path")).agg(F.array_sort(F.collect_list("path")).alias("files"))  # a component's own files
    measured = measured.join(owned, ["repo", "path"], "left")
    parent = comps.select("repo", F.col("path").alias("parent_path"), F.col("id").alias("parent_id"))
    measured = measured.join(parent, ["repo", "parent_path"], "left")
    strings = F.array().cast("array<string>")
    services = F.coalesce("external_services", F.array().cast("array<struct<name:string,category:string>>"))
    out = measured.select(
        "repo", "id", "parent_id", "path", "name", "type", "language", "framework", "description", "port", F.coalesce("files", strings).alias("files"), strings.alias("entry_points"), "config_files", "metrics", "docs", services.alias("external_services"),
    )
    shape = {f.name: f.dataType for f in out.schema.fields}
    shown = screens.select(
        "repo", "id", F.col("parent").alias("parent_id"), "path", "name", "type", F.lit("swift").alias("language"), F.lit("SwiftUI").alias("framework"), "description", F.lit(None).cast("long").alias("port"), strings.alias("files"),
        strings.alias("entry_points"), *[F.lit(None).cast(shape[c]).alias(c) for c in ("config_files", "metrics", "docs")], F.array().cast(shape["external_services"]).alias("external_services"),
    )
    listed = files.select("repo", "path", "language", "lines", "size_bytes", F.transform("symbols", lambda s: s["id"]).alias("symbols"), "imports", strings.alias("exports"), "module_doc")
    return {
        "components": cut(out.unionByName(shown), "components"),
        "relationships": cut(edges, "relationships"),
        "symbols": symbols.top_symbols(symbols.symbol_table(files.select("repo", "path", "symbols")), max_symbols),
        "files": listed,
        "stats": cut(metrics.repository_stats(files, comps, edges), "stats"),
        "info": docs.project_info(texts),
    }


def analyze(spark: SparkSession, path: str, max_file_size: int = V.MAX_FILE_SIZE, max_symbols: int = V.MAX_SYMBOLS) -> Architecture:
    """The architecture of one source tree."""
    root = os.path.abspath(path)
    name = os.path.basename(root)
    found = tables(spark, {name: root}, max_file_size, max_symbols)
    info = found["info"].first()
    return Architecture(name, info["description"] if info else "", datetime.now(UTC).isoformat(), root_path=root, repository=info["repository"] if info else None, **found)
