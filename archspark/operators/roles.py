"""Architectural roles, names and ports of components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions import text as T
from ..sources import configs

_NONE = "array<string>"


def frameworks(files: DataFrame) -> DataFrame:
    """(repo, owner, framework): of the most specific frameworks of a component's files the first."""
    known = files.where("framework is not null").select("repo", "owner", "path", "framework", T.framework_rank(F.col("framework")).alias("rank"))
    return known.groupBy("repo", "owner").agg(F.min_by("framework", F.struct(-F.col("rank"), F.col("path"))).alias("framework"))


def first_ports(files: DataFrame) -> DataFrame:
    """(repo, owner, first_port): the lowest port of the first file that listens on any."""
    listening = files.where(F.col("language").isin(V.CODE_LANGUAGES) & F.col("language").isin(V.PARSED_LANGUAGES) & (F.size("ports") > 0))
    return listening.groupBy("repo", "owner").agg(F.min_by(F.get("ports", F.lit(0)), "path").cast("long").alias("first_port"))


def with_scan_facts(comps: DataFrame, files: DataFrame) -> DataFrame:
    """comps with framework, and for server types the port of the first listening file."""
    facts = frameworks(files).join(first_ports(files), ["repo", "owner"], "full").withColumnRenamed("owner", "path")
    out = comps.join(facts, ["repo", "path"], "left")
    server = F.col("type").isin(V.SERVER_TYPES)
    return out.withColumn("port", F.coalesce("port", F.when(server, F.col("first_port")))).drop("first_port")


def _shares(files: DataFrame) -> DataFrame:
    code = sorted(set(V.LANGUAGES) - set(V.CONTENT_EXTENSIONS))
    ext = T.suffix(F.col("name"))
    return files.groupBy("repo", F.col("owner").alias("path")).agg(F.count(F.lit(1)).alias("n_files"), F.count_if(ext.isin(code)).alias("n_code"), F.count_if(ext.isin(V.CONTENT_EXTENSIONS)).alias("n_content"))


def is_content() -> Column:
    """Only content: a content directory with little code, or files of which over four fifths are content."""
    n, code, content = (F.coalesce(c, F.lit(0)) for c in ("n_files", "n_code", "n_content"))
    named = F.lower(T.basename(F.col("path"))).isin(V.CONTENT_DIRS) & ((n == 0) | (code / F.greatest(n, F.lit(1)) < 0.2))
    return (F.col("path") != "") & (named | ((n > 0) & (content / F.greatest(n, F.lit(1)) > 0.8)))


def _dir_facts(texts: DataFrame) -> DataFrame:
    """What stands directly in a directory, for all directories."""
    own = texts.where("dir <> '.git'")
    name = F.col("name")
    text = lambda n: F.max(F.when((name == n) & ~F.col("is_dir"), F.col("content")))
    there = lambda *n: F.max(name.isin(*n))
    per = own.groupBy("repo", F.col("dir").alias("path")).agg(
        there("Info.plist").alias("plist"), there("Package.swift").alias("swift_package"), F.max(F.col("is_dir") & name.endswith(".xcodeproj")).alias("xcodeproj"), there("AndroidManifest.xml").alias("manifest_here"),
        there("build.gradle", "build.gradle.kts").alias("gradle"), text("package.json").alias("package_text"), text("Cargo.toml").alias("cargo_text"), text("pubspec.yaml").alias("pubspec_text"), text("Gemfile").alias("gemfile_text"),
        text("pyproject.toml").alias("pyproject_text"),
    )
    deep = own.where((name == "AndroidManifest.xml") & F.col("dir").rlike("(^|/)src/main$"))
    deep = deep.select("repo", F.regexp_replace("dir", "/?src/main$", "").alias("path"), F.lit(True).alias("manifest_below")).distinct()
    return per.join(deep, ["repo", "path"], "full")


def _scripts(files: DataFrame) -> DataFrame:
    """(repo, path, script_path, script_text): the first Python file of a component that serves, by name and import."""
    served = T.any_of(F.col("content"), [f"{w} {m}" for m in V.SERVER_IMPORTS for w in ("import", "from")])
    hits = files.where(F.col("path").endswith(".py") & T.has(F.col("path"), V.SERVER_SCRIPT) & served)
    best = hits.groupBy("repo", "owner").agg(F.min_by(F.struct("path", "content"), "path").alias("s"))
    return best.select("repo", F.col("owner").alias("path"), F.col("s.path").alias("script_path"), F.col("s.content").alias("script_text"))


def script_name(path: Column, content: Column) -> Column:
    """A service's name: the first line of its script's docstring, shortened, else the file's name in words."""
    line = T.stripped(F.substring_index(T.stripped(F.regexp_extract(content, T.java(V.SCRIPT_DOC), 1)), "\n", 1))
    cut_at = lambda end: lambda x: F.when(F.instr(F.lower(x), end) > 6, F.substring(x, F.lit(1), F.instr(F.lower(x), end) - 1)).otherwise(x)
    for end in V.SCRIPT_NAME_ENDS:
        line = T.let(line, cut_at(end))
    whole = lambda x: F.regexp_replace(F.substring(x, 1, 30), "(?<=.) [^ ]*$", "")
    line = T.let(line, lambda x: F.when(F.length(x) > 30, whole(x)).otherwise(x))
    words = F.replace(F.replace(F.replace(T.basename(path), F.lit(".py"), F.lit("")), F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" "))
    return T.let(line, lambda x: F.when(F.length(x) > 3, x).otherwise(T.titled(words)))


def promoted(comps: DataFrame, files: DataFrame, texts: DataFrame) -> DataFrame:
    """comps with types that say what they are for; server scripts also give a port and a name."""
    here = _dir_facts(texts)
    macos = files.where(F.col("path").endswith(".swift")).groupBy("repo", F.col("owner").alias("path")).agg(F.max(T.any_of(F.col("content"), V.MACOS_TOKENS)).alias("macos"))
    shown = files.groupBy("repo", F.col("owner").alias("path")).agg(F.max(T.has(F.col("path"), V.FRONTEND_FILES)).alias("frontend"))
    up = here.select("repo", F.col("path").alias("up"), F.col("xcodeproj").alias("up_xcodeproj"))
    rows = comps.join(here, ["repo", "path"], "left").join(_shares(files), ["repo", "path"], "left").join(macos, ["repo", "path"], "left").join(shown, ["repo", "path"], "left").join(_scripts(files), ["repo", "path"], "left")
    rows = rows.withColumn("up", F.when(F.col("path").contains("/"), T.dirname(F.col("path")))).join(up, ["repo", "up"], "left")

    yes = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))
    deps = lambda c: F.coalesce(c, F.array().cast(_NONE))
    some = lambda have, names: F.arrays_overlap(have, F.array(*[F.lit(x) for x in names]))
    pkg = F.when(F.col("package_text").isNotNull(), configs.package_json(F.col("package_text")))
    rows = rows.withColumn("pkg", deps(F.when(pkg["ok"], pkg["dependencies"]))).withColumn("cargo", deps(F.when(F.col("cargo_text").isNotNull(), configs.cargo_toml(F.col("cargo_text"))["dependencies"])))
    rows = rows.withColumn("gems", deps(configs.gemfile(F.col("gemfile_text")))).withColumn("fw", F.lower(F.coalesce("framework", F.lit("")))).withColumn("folder", F.lower(T.basename(F.col("path"))))

    fw, folder, lang, pkgs, cargo = F.col("fw"), F.col("folder"), F.coalesce("language", F.lit("")), F.col("pkg"), F.col("cargo")
    swift_ui = fw.isin("swiftui", "uikit")
    xcode = yes("xcodeproj") | ((lang == "swift") & ~yes("swift_package") & yes("up_xcodeproj"))
    manifest = yes("manifest_here") | yes("manifest_below")
    port = F.col("port").isNotNull() & (F.col("port") != 0)
    web = fw.isin(V.WEB_FRAMEWORKS) | some(pkgs, V.WEB_DEPS)
    before = [
        (folder.contains("watch") & ((lang == "swift") | fw.isin("swiftui", "watchkit")), "watch-app"),
        ((fw == "appkit") | ((fw == "swiftui") & yes("macos")), "desktop-app"),
        (swift_ui & (yes("plist") | xcode | (F.col("type") == "application")), "ios-client"),
        (manifest | (yes("gradle") & lang.isin("java", "kotlin") & folder.contains("android")), "android-client"),
        (F.array_contains(pkgs, "react-native") | yes(F.col("pubspec_text").contains("flutter:")), "mobile-client"),
        ((fw == "electron") | F.array_contains(pkgs, "electron"), "desktop-app"),
        (fw.isin(V.SERVER_FRAMEWORKS), "api-server"),
        (some(pkgs, V.PURE_SERVER_DEPS) & ~some(pkgs, V.CLIENT_DEPS), "api-server"),
        (some(cargo, V.RUST_SERVER_DEPS) | some(F.col("gems"), V.RUBY_SERVER_DEPS), "api-server"),
    ]
    script = F.col("script_path").isNotNull() & ~folder.isin(V.TEST_DIRS)
    after = [
        (port & lang.isin(V.SERVER_LANGUAGES) & ~some(pkgs, V.CLIENT_DEPS) & ~folder.isin(V.UTILITY_DIRS), "api-server"),
        (folder.isin(V.LOGGING_DIRS) & (port | lang.isin(V.SERVER_LANGUAGES)), "service"),
        (some(pkgs, V.LOGGING_DEPS) & port, "service"),
        (web, "web-client"),
        (folder.isin(V.ADMIN_DIRS) & yes("frontend"), "web-client"),
        ((lang == "python") & fw.isin("click", "typer"), "cli-tool"),
        (F.array_contains(cargo, "clap") & ~some(cargo, V.RUST_SERVER_DEPS), "cli-tool"),
    ]
    rows = rows.withColumn("early", T.first_of(before)).withColumn("content_only", is_content())
    by_script = ~F.col("content_only") & F.col("early").isNull() & script
    rows = rows.withColumn("by_script", by_script).withColumn("role", F.when(by_script, "service").otherwise(F.coalesce("early", T.first_of(after))))
    own_port = T.find(F.col("script_text"), V.SCRIPT_PORT).try_cast("long")
    rows = rows.withColumn("port", F.when(F.col("by_script") & ~port, F.coalesce(own_port, F.col("port"))).otherwise(F.col("port")))
    rows = rows.withColumn("name", F.when(F.col("by_script") & (F.col("name") == folder), script_name(F.col("script_path"), F.col("script_text"))).otherwise(F.col("name")))
    rows = rows.withColumn("type", F.when(F.col("content_only"), "content").otherwise(F.coalesce("role", "type"))).withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    return rows.select(*comps.columns, "n_files", "pyproject_text")


def _inside(comps: DataFrame) -> DataFrame:
    """(repo, path, direct, below): types of the components in and below each directory that stand for something."""
    heroes = comps.where(F.col("type").isin(V.PROMOTED_TYPES) & (F.col("path") != "") & ~F.lower(T.basename(F.col("path"))).isin(V.SUBORDINATE_DIRS))
    above = heroes.select("repo", F.col("path").alias("child"), "type", F.explode(T.ancestors(F.col("path"))).alias("path"))
    return above.groupBy("repo", "path").agg(F.collect_set(F.when(T.dirname(F.col("child")) == F.col("path"), F.col("type"))).alias("direct"), F.collect_set("type").alias("below"))  # at most as many as there are types


def _demote(comps: DataFrame, which: Column) -> DataFrame:
    own = F.array("type")
    other = lambda c: F.size(F.array_except(F.coalesce(c, F.array().cast(_NONE)), own))
    wraps = (other("direct") >= 2) | ((other("below") >= 3) & (F.col("n_files") <= 25))
    rows = comps.join(_inside(comps), ["repo", "path"], "left")
    return rows.withColumn("type", F.when(which & F.col("type").isin(V.PROMOTED_TYPES) & wraps, "package").otherwise(F.col("type"))).drop("direct", "below")


def demoted(comps: DataFrame) -> DataFrame:
    """Components that only wrap several kinds of others become packages.

    They are looked at in component order and see what was decided before. What lies below a
    component comes after it, but for marked components below a module; so marked ones go first, then modules.
    """
    module = F.col("ord.kind") == 2
    return _demote(_demote(comps, ~module), module)


def named(comps: DataFrame, texts: DataFrame) -> DataFrame:
    """Components that are still named like their folder take the name that their files give."""
    from .components import ruby_names

    rows = comps.join(ruby_names(texts).withColumnRenamed("dir", "path"), ["repo", "path"], "left")
    open_ = (F.col("path") != "") & (F.col("name") == T.basename(F.col("path")))
    ruby = (F.coalesce("language", F.lit("")) == "ruby") | F.lower(F.coalesce("framework", F.lit(""))).isin(V.RUBY_NAMED_FRAMEWORKS)
    python = F.when(F.col("language") == "python", configs.pyproject_toml(F.col("pyproject_text"))["name"])
    found = F.coalesce(F.when(ruby, F.nullif(F.col("ruby_name"), F.lit(""))), python)
    return rows.withColumn("name", F.when(open_, F.coalesce(found, F.col("name"))).otherwise(F.col("name"))).drop("ruby_name", "pyproject_text")


def with_ports(comps: DataFrame, files: DataFrame) -> DataFrame:
    """Servers without a port take that of their first listening file, then of their first child's that has one.

    A child counts for the component whose id is the child's parent path.
    """
    server = F.col("type").isin(V.SERVER_TYPES)
    own = first_ports(files).withColumnRenamed("owner", "path")
    rows = comps.join(own, ["repo", "path"], "left")
    children = rows.where("first_port is not null and path <> ''").groupBy("repo", F.col("parent_path").alias("id")).agg(F.min_by("first_port", "ord").alias("child_port"))
    rows = rows.withColumn("port", F.coalesce("port", F.when(server, F.col("first_port")))).join(children, ["repo", "id"], "left")
    return rows.withColumn("port", F.coalesce("port", F.when(server, F.col("child_port")))).drop("first_port", "child_port")
