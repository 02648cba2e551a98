"""Components: directories with marker files, vendored projects, dense directories.

All tables have a column ``repo``; one job covers any number of repositories. Walk
order, which decides "first" and "last", is the order of paths; components come in the
order root, marked, modules (column ``ord``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions import text as T
from ..sources import configs
from ..sources.storage import cut
from .enclosing import enclosing

CONFIG = "struct<type:string,path:string,services:array<string>,ports:array<struct<service:string,host:int,container:int>>,functions:array<struct<name:string,runtime:string,handler:string,code_uri:string>>,has_api_gateway:boolean,provider:string>"


def vendored(entries: DataFrame) -> DataFrame:
    """(repo, path) of foreign projects that were copied into a tree; the outermost of nested ones."""
    flags = entries.groupBy("repo", "dir").agg(
        F.max(F.col("name").isin(sorted(V.BUILD_FILES))).alias("built"), F.max(F.col("name").isin(sorted(V.LICENSE_FILES))).alias("licensed"), F.count_if("is_dir").alias("dirs")
    )
    found = flags.where((F.col("dir") != "") & F.col("built") & F.col("licensed") & (F.col("dirs") >= V.VENDORED_DIRS)).select("repo", F.col("dir").alias("path"))
    return found.join(nested_in(found, found), ["repo", "path"], "left_anti")


def nested_in(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """Distinct rows (repo, path) of which a directory above is among tops (repo, path)."""
    return nearest(rows.select("repo", "path").distinct(), tops, "__top").where("__top is not null").select("repo", "path")


def source_files(entries: DataFrame, foreign: DataFrame, max_file_size: int = V.MAX_FILE_SIZE) -> DataFrame:
    """(repo, path, dir, name, language, content, lines, size_bytes) of the files that are analysed.

    content is text (``sources.tree.with_text``). Files directly in a vendored project count, files below do not.
    """
    lang = T.language(F.col("name"))
    kept = entries.where(~F.col("is_dir") & lang.isNotNull() & ~F.col("name").isin(sorted(V.SKIP_DIRS)) & ~T.suffix(F.col("name")).isin(sorted(V.SKIP_EXTENSIONS)))
    kept = kept.where((F.col("size") > 0) & (F.col("size") <= max_file_size) & F.col("content").isNotNull() & (F.col("dir") != ".git"))
    dirs = kept.select("repo", F.col("dir").alias("path")).distinct()
    below = nested_in(dirs, foreign).withColumnRenamed("path", "dir")
    text = F.col("content")
    return kept.join(below, ["repo", "dir"], "left_anti").select(
        "repo", "path", "dir", "name", lang.alias("language"), "content", (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"), F.col("size").alias("size_bytes")
    )


def _markers(entries: DataFrame) -> DataFrame:
    rows = ", ".join(f"({i}, '{n}', {f"'{lang}'" if lang else 'null'}, '{kind}')" for i, (n, lang, kind) in enumerate(V.MARKERS))
    table = entries.sparkSession.sql(f"select * from values {rows} as t(prio, name, marker_language, marker_type)")
    return F.broadcast(table)  # a fixed table


def ruby_names(entries: DataFrame) -> DataFrame:
    """(repo, dir, ruby_name): the application that a directory's Ruby files name."""
    pick = lambda rule: F.max(F.when(rule, F.col("content")))
    inside = F.col("path").rlike("(^|/)config/application\\.rb$")
    own = entries.where(~F.col("is_dir") & (inside | F.col("name").isin("config.ru", "Rakefile")))
    base = own.select("repo", F.when(inside, T.dirname(F.col("dir"))).otherwise(F.col("dir")).alias("dir"), "name", "path", "content")
    per = base.groupBy("repo", "dir").agg(pick(inside).alias("a"), pick(F.col("name") == "config.ru").alias("b"), pick(F.col("name") == "Rakefile").alias("c"))
    return per.select("repo", "dir", configs.ruby_app_name(F.col("a"), F.col("b"), F.col("c")).alias("ruby_name"))


def _described(found: DataFrame, kinds: set[str]) -> DataFrame:
    """Name, type, description, port and config record from the marker file's content. kinds: names of the marker files there are; others are not parsed."""
    c, m = F.col("content"), F.col("name")
    rows, names, told, record = found, [], [], {"services": None, "ports": None, "functions": None, "has_api_gateway": None, "provider": None}
    served = F.lit(False)

    def parsed(out: str, files: list[str], value) -> bool:
        nonlocal rows
        if some := bool(kinds & set(files)):
            rows = rows.withColumn(out, F.when(m.isin(files), value(c)))
        return some

    by_prefix = lambda prefix: sorted(k for k in kinds if k.startswith(prefix))
    if parsed("pkg", ["package.json"], configs.package_json):
        names.append(F.when(F.col("pkg.ok"), F.col("pkg.name")))
        told.append(F.when(m == "package.json", F.coalesce(F.when(F.col("pkg.ok"), F.col("pkg.description")), F.lit(""))))
    for out, file, value in (("cargo", "Cargo.toml", configs.cargo_toml), ("project", "pyproject.toml", configs.pyproject_toml)):
        if parsed(out, [file], value):
            names.append(F.col(f"{out}.name"))
    if "Info.plist" in kinds:
        names.append(F.nullif(F.col("plist_name"), F.lit("")))
    if "Gemfile" in kinds:
        names.append(F.when(m == "Gemfile", F.nullif(F.col("ruby_name"), F.lit(""))))
    if parsed("compose", by_prefix("docker-compose."), configs.docker_compose):
        told.append(F.when(F.size(F.col("compose.services")) > 0, F.concat(F.lit("Services: "), F.array_join("compose.services", ", "))))
        record |= {"services": F.col("compose.services"), "ports": F.col("compose.ports")}
    for out, prefix, value, title in (("sam", "template.", configs.sam_template, "AWS SAM: "), ("less", "serverless.", configs.serverless_yml, "Serverless: ")):
        if parsed(out, by_prefix(prefix), value):
            functions = F.transform(F.col(out)["functions"], lambda f: f["name"])
            some = F.coalesce(F.size(F.col(out)["functions"]) > 0, F.lit(False))
            served = served | some
            told.append(F.when(some, F.concat(F.lit(title), F.array_join(functions, ", "))))
            record["functions"] = F.col(f"{out}.functions") if record["functions"] is None else F.coalesce(record["functions"], F.col(f"{out}.functions"))
            if out == "sam":
                names.append(F.when(some & (F.size(functions) == 1), F.get(functions, F.lit(0))))
                record["has_api_gateway"] = F.col("sam.has_api_gateway")
            else:
                record["provider"] = F.col("less.provider")
    label = F.when(m.startswith("docker-compose."), "docker-compose").when(m.startswith("template."), "sam").when(m.startswith("serverless."), "serverless").otherwise(m)
    recorded = m.isin("package.json", "Cargo.toml", "pyproject.toml", "Info.plist", "Gemfile") | m.startswith("docker-compose.") | m.startswith("template.") | m.startswith("serverless.")
    shape = {f.split(":")[0]: f.split(":", 1)[1] for f in _fields(CONFIG)}
    config = F.struct(
        label.alias("type"), F.when(F.col("dir") == "", m).otherwise(F.concat_ws("/", "dir", "name")).alias("path"),
        *[(F.lit(None) if v is None else v).cast(shape[k]).alias(k) for k, v in record.items()],
    )
    port = F.lit(None) if record["ports"] is None else F.get(record["ports"], F.lit(0))["host"]
    return rows.select(
        "repo", F.col("dir").alias("path"), F.lit(1).alias("kind"), F.coalesce(*names, F.col("folder")).alias("name"), F.when(served, "api-server").otherwise(F.col("marker_type")).alias("type"), F.col("marker_language").alias("language"),
        F.coalesce(*told, F.lit(None).cast("string")).alias("description"), port.cast("long").alias("port"), F.when(recorded, F.array(config)).otherwise(F.array()).cast(f"array<{CONFIG}>").alias("config_files"),
    )


def _fields(struct: str) -> list[str]:
    """The fields of a struct's type, as text."""
    out, depth, at = [], 0, len("struct<")
    for k, c in enumerate(struct[:-1]):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 1:
            out.append(struct[at:k])
            at = k + 1
    return [*out, struct[at:-1]]


def components(entries: DataFrame, texts: DataFrame, foreign: DataFrame, roots: dict[str, str]) -> DataFrame:
    """The components of each repository as they are discovered.

    entries: the tree with contents in bytes; texts: the same with contents as text;
    roots: repository -> name of its root directory.
    """
    below = nested_in(texts.select("repo", F.col("dir").alias("path")).distinct(), foreign).withColumnRenamed("path", "dir")
    own = texts.join(below, ["repo", "dir"], "left_anti").where(~F.col("is_dir") & (F.col("dir") != ".git"))
    outside = own.join(foreign.withColumnRenamed("path", "dir"), ["repo", "dir"], "left_anti")
    root_name = F.element_at(F.create_map(*[F.lit(x) for p in roots.items() for x in p]), F.col("repo"))
    folder = F.when(F.col("dir") == "", root_name).otherwise(T.basename(F.col("dir")))
    markers = outside.join(_markers(entries), "name")
    kinds = {r["name"] for r in texts.join(_markers(entries), "name").select("name").distinct().collect()}  # at most as many as there are marker names
    marked = markers.groupBy("repo", "dir").agg(F.min_by(F.struct("name", "path", "content", "marker_language", "marker_type"), "prio").alias("m"))
    marked = marked.select("repo", "dir", "m.*", folder.alias("folder"))
    if "Info.plist" in kinds:
        marked = marked.join(configs.info_plists(entries).select("repo", "path", "plist_name"), ["repo", "path"], "left")
    if "Gemfile" in kinds:
        marked = marked.join(ruby_names(texts), ["repo", "dir"], "left")
    none = lambda t: F.lit(None).cast(t)
    blank = [none("string").alias("language"), none("string").alias("description"), none("long").alias("port"), F.array().cast(f"array<{CONFIG}>").alias("config_files")]
    library = foreign.select("repo", "path", F.lit(1).alias("kind"), T.basename(F.col("path")).alias("name"), F.lit("library").alias("type"), *blank)
    found = cut(_described(marked, kinds).unionByName(library), "marked")  # three parts of the plan read it
    dense = own.where(T.language(F.col("name")).isNotNull() & (F.col("dir") != "")).groupBy("repo", F.col("dir").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    depth = F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))
    dense = dense.where((F.col("n") >= V.MODULE_FILES) & (depth <= V.MODULE_DEPTH)).join(found, ["repo", "path"], "left_anti")
    modules = dense.select("repo", "path", F.lit(2).alias("kind"), T.basename(F.col("path")).alias("name"), F.lit("module").alias("type"), *blank)
    spark = entries.sparkSession
    bare = spark.createDataFrame([(r, n) for r, n in roots.items()], "repo string, root_name string")
    bare = bare.select("repo", F.lit("").alias("path"), F.lit(0).alias("kind"), F.col("root_name").alias("name"), F.lit("project").alias("type"), *blank)
    bare = bare.join(found.where("path = ''").select("repo"), "repo", "left_anti")
    rooted = found.withColumn("kind", F.when(F.col("path") == "", 0).otherwise(F.col("kind")))
    out = bare.unionByName(rooted).unionByName(modules)
    return out.withColumn("id", T.component_id(F.col("path"))).withColumn("ord", F.struct("kind", "path")).drop("kind")


def nearest(rows: DataFrame, comps: DataFrame, out: str) -> DataFrame:
    """rows (repo, path, ...) with the deepest component directory above each path; null above the root.

    Only distinct directories are swept; rows get their directory's answer, by a broadcast while these are few.
    """
    keyed = rows.withColumn("__place", F.when(F.col("path") != "", T.dirname(F.col("path"))))
    found = enclosing(keyed.select("repo", F.col("__place").alias("place")), comps).select("repo", F.col("place").alias("__place"), F.col("top").alias(out))
    return keyed.join(found, ["repo", "__place"], "left").drop("__place").select(*rows.columns, out)


def parents(comps: DataFrame) -> DataFrame:
    """comps with parent_path, the nearest component above."""
    return nearest(comps, comps, "parent_path")


def owners(files: DataFrame, comps: DataFrame) -> DataFrame:
    """files with owner, the path of the component that each belongs to."""
    return nearest(files, comps, "owner")


def resolve_imports(found: DataFrame, comps: DataFrame) -> DataFrame:
    """found (repo, file, import, ...) with target: the path of the component that an import means, or null.

    A relative import is folded onto its file's directory and belongs to whom a file there
    would. Any other means the first component whose name (without ``-`` and ``_``) or
    directory name is the import's.
    """
    keys = found.select("repo", "file", "import").distinct()
    relative = keys.where(F.col("import").startswith(".")).withColumn("path", T.folded(T.dirname(F.col("file")), F.col("import")))
    places = nearest(relative.select("repo", "path").distinct(), comps, "target")
    places = places.withColumn("target", F.coalesce("target", F.lit("")))
    by_path = relative.join(places, ["repo", "path"]).select("repo", "file", "import", "target")
    words = keys.where(~F.col("import").startswith(".")).select("repo", "import").distinct()
    named = comps.select("repo", F.col("path").alias("target"), "ord", T.plain_name(F.col("name")).alias("key"))
    placed = comps.where("path <> ''").select("repo", F.col("path").alias("target"), "ord", F.lower(T.basename(F.col("path"))).alias("key"))
    hits = words.withColumn("key", T.plain_name(F.col("import"))).join(named, ["repo", "key"]).unionByName(words.withColumn("key", F.lower("import")).join(placed, ["repo", "key"]))
    first = hits.groupBy("repo", "import").agg(F.min_by("target", "ord").alias("target"))
    by_name = keys.where(~F.col("import").startswith(".")).join(first, ["repo", "import"]).select("repo", "file", "import", "target")
    return found.join(by_path.unionByName(by_name), ["repo", "file", "import"], "left")
