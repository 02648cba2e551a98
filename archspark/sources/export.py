"""Architectures as one JSON document, as Parquet tables, as a review text, as a summary."""

from __future__ import annotations

import json
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import ranks
from .storage import cut, fresh_path

TABLES = ["components", "relationships", "symbols", "files", "stats", "info"]


def write_tables(arch, path: str) -> None:
    """The tables as Parquet, one folder each: the form for large architectures."""
    for name in TABLES:
        getattr(arch, name).write.mode("overwrite").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


def _plain(x):
    if hasattr(x, "asDict"):
        return {k: _plain(v) for k, v in x.asDict().items()}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    return {k: _plain(v) for k, v in x.items()} if isinstance(x, dict) else x


def tree(comps: DataFrame) -> list[dict]:
    """Components with their children inside; screens first, then by path. Component tables are small against files."""
    rows = [_plain(r) for r in comps.orderBy("path").collect()]
    below: dict[str | None, list[dict]] = {}
    for r in rows:
        below.setdefault(r.pop("parent_id"), []).append(r)
    for r in rows:
        own = below.get(r["id"], [])
        r["children"] = [c for c in own if "/__ui__/" in c["id"]] + [c for c in own if "/__ui__/" not in c["id"]]
        r["config_files"], r["metrics"], r["docs"] = [{k: v for k, v in c.items() if v is not None} for c in r["config_files"] or []], r["metrics"] or {}, r["docs"] or {}
        r.pop("repo")
    return below.get(None, [])


_HEAD = ["name", "description", "repository", "generated_at", "analyzer_version", "root_path"]
_EDGE = ["source", "target", "type", "label", "protocol", "port", "bidirectional"]


def _head(arch) -> dict:
    return {k: "1.0.0" if k == "analyzer_version" else getattr(arch, k) for k in _HEAD}


def _stats(arch) -> dict:
    stats = _plain(arch.stats.first())
    return {k: v for k, v in stats.items() if k not in ("repo", "main_language")}


def document(arch) -> dict:
    """Everything as one value. Brings all tables to the driver; ``write_document`` does not."""
    symbols = [{**_plain(r), "parent": None, "dependencies": [], "annotations": []} for r in arch.symbols.orderBy("rank").drop("repo", "rank", "ordinal").collect()]
    return {
        **_head(arch), "components": tree(arch.components), "relationships": [_plain(r) for r in arch.relationships.orderBy("stage", "at").select(*_EDGE).collect()], "symbols": symbols,
        "files": [_plain(r) for r in arch.files.orderBy("path").drop("repo").collect()], "stats": _stats(arch),
        "repositories": [{"name": r["repo"], "repository": r["repository"]} for r in arch.info.orderBy("repo").collect()] if "repo" not in arch.stats.columns else [],
    }


# --- the document in parts ----------------------------------------------------------------

#: Lists of the document, in its order.
LISTS = ["components", "relationships", "symbols", "files", "repositories"]
#: Lines of a text file: what reads one file takes no more of them at once.
FILE_LINES = 100_000


def _pairs(columns: list[str], indented: bool) -> Column:
    """Columns as the inside of a JSON object, nulls too."""
    return F.regexp_replace(F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "pretty": str(indented).lower()}), "^\\{|\\}$", "")


def _listed(rows: DataFrame, order: list[str], pairs: Column) -> DataFrame:
    """(key, text): an object for each row; all but the first begin with a comma."""
    placed = ranks.ranked(rows.withColumn("__all", F.lit(0)), "__all", order, "__nth")
    return placed.select(F.col("__nth").alias("key"), F.concat(F.when(F.col("__nth") > 1, ",").otherwise(""), F.lit("{"), pairs, F.lit("}")).alias("text"))


def _tree_lines(comps: DataFrame, indented: bool) -> DataFrame:
    """(key, text): each component's line begins an object and its list of children, a later line ends both. Order as in ``tree``.

    A key is the places of a component and of those above it among their siblings; its level is found from that of its parent.
    """
    screen = F.when(F.col("parent_id").isNull() | F.col("id").contains("/__ui__/"), 0).otherwise(1)
    text = F.concat_ws(",", _pairs([c for c in comps.columns if c not in ("repo", "parent_id", "config_files", "metrics", "docs")], indented), *[F.concat(F.lit(f'"{c}":'), F.coalesce(F.to_json(c, options), F.lit(empty))) for c, options, empty in (("config_files", {}, "[]"), ("metrics", {"ignoreNullFields": "false"}, "{}"), ("docs", {"ignoreNullFields": "false"}, "{}"))])
    rows = cut(ranks.ranked(comps.select("id", "parent_id", "path", screen.alias("screen"), text.alias("text")), "parent_id", ["screen", "path"], "nth").drop("screen", "path"), "siblings")
    place, begun = F.lpad(F.col("nth").cast("string"), 10, "0"), F.concat(F.when(F.col("nth") > 1, ",").otherwise(""), F.lit("{"), "text", F.lit(',"children":['))
    level = cut(rows.where("parent_id is null").select("id", place.alias("key"), begun.alias("text"), F.array("id").alias("trail")), "level")
    out, rest = level, rows.where("parent_id is not null")
    while True:
        above = level.select(F.col("id").alias("parent_id"), F.col("key").alias("above"), "trail")
        found, seen = rest.join(above, "parent_id").select("id", F.concat("above", place).alias("key"), begun.alias("text"), F.concat("trail", F.array("id")).alias("trail")), Observation()
        level = cut(found.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.array_position("trail", F.col("id")) < F.size("trail")).alias("again")), "level")
        if not seen.get["n"]:
            break
        if seen.get["again"]:
            raise ValueError("the components' parents form a cycle")
        out = out.unionByName(level)
    ends = out.select(F.concat("key", F.lit("~")).alias("key"), F.lit("]}").alias("text"))  # after all digits: below all that is in it
    return out.select("key", "text").unionByName(ends)


def write_document(arch, folder: str, indented: bool = False) -> None:
    """The JSON document of an architecture, written by tasks. Texts below folder joined in order of names are the document (``save_json``).

    Folders hold what is before a list, a list (a line for each element, of components two, if not indented), and so on. The driver gets the sums of ``stats`` alone.
    """
    spark = arch.components.sparkSession
    none = spark.createDataFrame([], "repo string, repository string")
    symbols = [c for c in arch.symbols.columns if c not in ("repo", "rank", "ordinal")]
    lists = {
        "components": _tree_lines(arch.components, indented),
        "relationships": _listed(arch.relationships, ["stage", "at"], _pairs(_EDGE, indented)),
        "symbols": _listed(arch.symbols, ["rank"], F.concat(_pairs(symbols, indented), F.lit(',"parent":null,"dependencies":[],"annotations":[]'))),
        "files": _listed(arch.files, ["path"], _pairs([c for c in arch.files.columns if c != "repo"], indented)),
        "repositories": _listed((arch.info if "repo" not in arch.stats.columns else none).select("repo", F.col("repo").alias("name"), "repository"), ["repo"], _pairs(["name", "repository"], indented)),
    }
    text = lambda value: json.dumps(value, default=str)
    plain = lambda value: spark.range(0, 1, 1, 1).select(F.lit(value).alias("text"))
    before = f"{text(_head(arch))[:-1]}, "
    for i, name in enumerate(LISTS):
        if name == "repositories":
            before += f'"stats": {text(_stats(arch))}, '
        plain(f'{before}"{name}": [').write.text(f"{folder}/{2 * i:02d}_text")
        lists[name].orderBy("key").select("text").write.option("maxRecordsPerFile", FILE_LINES).text(f"{folder}/{2 * i + 1:02d}_{name}")
        before = "], "
    plain("]}").write.text(f"{folder}/{2 * len(LISTS):02d}_text")


def document_list(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The lines (text) of a list of a document in parts."""
    return spark.read.text(f"{folder}/{2 * LISTS.index(name) + 1:02d}_{name}").withColumnRenamed("value", "text")


_WALK = "file string, own string, parent string, id string, up long, inside long, left array<string>"


def _walk(lines: pa.Table) -> pa.Table:
    """Components of one text file of the tree's lines, and a row without id: what the file ends of earlier files' and leaves open."""
    lines = lines.sort_by([("block", "ascending"), ("at", "ascending")])
    name, rows, opened, up = lines.column("file")[0].as_py(), [], [], 0
    for i, text in enumerate(lines.column("text")):
        if (line := text.as_py()) == "]}":
            up += not opened
            del opened[-1:]
        else:
            own = f"{name}:{i}"
            rows.append((name, own, opened[-1] if opened else None, json.loads(line.removeprefix(",") + "]}")["id"], up, len(opened), None))
            opened.append(own)
    rows.append((name, None, None, None, up, 0, opened))
    types = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.list_(pa.string())]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["file", "own", "parent", "id", "up", "inside", "left"])


def document_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(id, depth, n) of the components of a document in parts, as its brackets nest them; n: their children.

    Tasks walk a text file each. The driver gets a row for each file, with what is open at its end, and tells each file what is open where it begins.
    """
    lines = document_list(spark, folder, "components").select("text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    walked = cut(lines.groupBy("file").applyInArrow(_walk, _WALK), "walked")
    starts, opened = [], []
    for r in walked.where("id is null").orderBy("file").select("file", "up", "left").collect():
        if r["up"] > len(opened):
            raise ValueError(f"{folder}: {r['file']} ends more components than are open")
        starts.append((r["file"], opened))
        opened = opened[: len(opened) - r["up"]] + r["left"]
    if opened:
        raise ValueError(f"{folder}: {len(opened)} components are not ended")
    starts = spark.createDataFrame(starts, "file string, opened array<string>")
    base = F.size("opened") - F.col("up")
    nodes = walked.where("id is not null").join(F.broadcast(starts), "file").select("own", "id", (base + F.col("inside")).cast("long").alias("depth"), F.coalesce("parent", F.when(base > 0, F.get("opened", (base - 1).cast("int")))).alias("parent"))
    below = nodes.where("parent is not null").groupBy(F.col("parent").alias("own")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(below, "own", "left").select("id", "depth", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def save_json(arch, path: str, compact: bool = False) -> dict:
    """The JSON document as one file on the driver: parts are made by tasks and copied one after the other. Its stats."""
    spark = arch.components.sparkSession
    folder = fresh_path(spark, "document")
    write_document(arch, folder, not compact)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(conf)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    out = jvm.java.io.FileOutputStream(os.path.abspath(path))
    try:
        for d in sorted(fs.listStatus(at), key=lambda x: x.getPath().getName()):
            for f in sorted((x.getPath() for x in fs.listStatus(d.getPath())), key=lambda x: x.getName()):
                if f.getName().startswith("part-"):
                    source = fs.open(f)
                    try:
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
                    finally:
                        source.close()
    finally:
        out.close()
    return {"stats": _stats(arch)}


def write_json(arch, path: str, compact: bool = False) -> dict:
    made = document(arch)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(made, f, indent=None if compact else 2, default=str)
    return made


def summary(made: dict) -> str:
    s = made["stats"]
    languages = ", ".join(f"{k} ({v:,} lines)" for k, v in sorted(s["languages"].items(), key=lambda x: -x[1]))
    lines = [f"  Components: {s['total_components']}", f"  Files: {s['total_files']}", f"  Lines: {s['total_lines']:,}", f"  Symbols: {s['total_symbols']}", f"  Relationships: {s['total_relationships']}", f"  Languages: {languages}"]
    return "\n".join(["Analysis complete:", *lines])


# --- reviews ------------------------------------------------------------------------------


def _shown(name: str, value) -> list[str]:
    return [f"- {name}: {value}"] if value else []


def _component_lines(c: dict, names: dict[str, str], edges: list[dict]) -> list[str]:
    docs, sums = c.get("docs") or {}, c.get("metrics") or {}
    said = [f"{k}: {c[k.lower()]}" for k in ("Framework", "Language") if c.get(k.lower())]
    size = [f"{sums[k]} {k}" for k in ("files", "lines") if sums.get(k)]
    out = ["**Component Context:**", f"- Path: {c['path']}", *_shown("Purpose", docs.get("purpose")), *([f"- {' | '.join(said)}"] if said else []), *_shown("Size", ", ".join(size))]
    out += _shown("Patterns", ", ".join(docs.get("patterns") or [])) + _shown("Tech Stack", ", ".join(docs.get("tech_stack") or []))
    if routes := docs.get("api_endpoints"):
        out += ["- API Endpoints:", *[f"  - {e['method']} {e['path']}" for e in routes[:10]], *([f"  - ... and {len(routes) - 10} more"] if len(routes) > 10 else [])]
    out += _shown("Environment Variables", ", ".join(docs.get("env_vars") or [])) + _shown("Port", c.get("port"))
    own = [e for e in edges if c["id"] in (e["source"], e["target"])]
    if own:
        out += ["", "**Relationships:**"]
        for e in own[:10]:
            out_ = e["source"] == c["id"]
            other = e["target"] if out_ else e["source"]
            out.append(f"- {'->' if out_ else '<-'} {names.get(other, other)} ({e['type']}{': ' + e['label'] if e['label'] else ''})")
        out += [f"- ... and {len(own) - 10} more relationships"] if len(own) > 10 else []
    return out


def review(arch, annotations: DataFrame) -> str:
    """Annotations with what they are about, as Markdown. Only annotated rows come to the driver."""
    notes = [_plain(r) for r in annotations.orderBy("createdAt", "id").collect()]  # written by hand
    if not notes:
        return ""
    ids, targets = [n["componentId"] for n in notes], [n["targetId"] for n in notes]
    comps = {r["id"]: _plain(r) for r in arch.components.where(F.col("id").isin(ids)).collect()}
    edges = [_plain(r) for r in arch.relationships.where(F.col("source").isin(ids) | F.col("target").isin(ids)).orderBy("stage", "at").select("source", "target", "type", "label").collect()]
    ends = sorted({e[k] for e in edges for k in ("source", "target")})
    names = {r["id"]: r["name"] for r in arch.components.where(F.col("id").isin(ends)).select("id", "name").collect()}
    files = {r["path"]: _plain(r) for r in arch.files.where(F.col("path").isin(targets)).collect()}
    symbols = {r["id"]: _plain(r) for r in arch.symbols.where(F.col("id").isin(targets + [s for f in files.values() for s in f["symbols"]])).collect()}
    out = [f"# Architecture Review: {arch.name}", "", "Review comments on the architecture of this project: on components, files and symbols.", "Please turn them into concrete changes.", "", "---"]
    count = 0
    for kind, title in (("component", "Component"), ("file", "File"), ("symbol", "Symbol")):
        group = [n for n in notes if (n["targetType"] or "component") == kind and (kind != "component" or n["componentId"] in comps)]
        if any((n["targetType"] or "component") == kind for n in notes):
            out += ["", f"# {title}-Level Feedback"]
        for n in group:
            count, c = count + 1, comps.get(n["componentId"])
            head = f"{c['name']} ({c['type']})" if c else ""
            out += ["", f"## {count}. {head}" if kind == "component" else f"## {count}. {title}: {n['targetName']}"]
            out += [f"Component: {head}"] if kind != "component" and c else []
            out += ["", "**Feedback:**", *[f"> {line}" for line in n["text"].split("\n")]]
            if kind == "component":
                out += ["", *_component_lines(c, names, edges)]
            elif kind == "file" and (f := files.get(n["targetId"])):
                own = [symbols[s]["name"] for s in f["symbols"] if s in symbols]
                more = f" ... +{len(own) - 15} more" if len(own) > 15 else ""
                out += ["", "**File Context:**", f"- Path: {f['path']}", f"- Language: {f['language']}", f"- Lines: {f['lines']}", *_shown("Symbols", ", ".join(own[:15]) + more)]
            elif kind == "symbol" and (s := symbols.get(n["targetId"])):
                doc = s["docstring"] or ""
                out += ["", "**Symbol Context:**", f"- Kind: {s['kind']}", f"- File: {s['file']}:{s['line']}", f"- Visibility: {s['visibility']}", *_shown("Docstring", doc[:200] + ("..." if len(doc) > 200 else ""))]
                out += ["", "```", s["code_preview"], "```"] if s["code_preview"] else []
            out += ["", "---"]
    per = {k: sum((n["targetType"] or "component") == k for n in notes) for k in ("component", "file", "symbol")}
    out += ["", "**Review Summary:**", f"- Total annotations: {len(notes)}", *[f"  - {k.title()}s: {v}" for k, v in per.items() if v], f"- Components reviewed: {len(set(ids))}", f"- Architecture generated: {arch.generated_at}"]
    return "\n".join(out)
