"""What is written about components: documents, purposes, endpoints, patterns, technology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions import text as T

_STRINGS, _ENDPOINTS = "array<string>", "array<struct<method:string,path:string>>"


def shortened(text: Column) -> Column:
    return F.when(F.length(text) > V.DOC_LIMIT, F.concat(F.substring(text, 1, V.DOC_LIMIT), F.lit(V.DOC_CUT))).otherwise(text)


def documents(texts: DataFrame) -> DataFrame:
    """(repo, path, readme, claude_md, changelog): of a directory's candidates the first that exists."""
    own = texts.where(~F.col("is_dir") & F.col("content").isNotNull())
    picks = []
    for column, names in V.DOC_FILES:
        rank = F.array_position(F.array(*map(F.lit, names)), F.col("name"))
        picks.append(shortened(F.min_by(F.when(rank > 0, F.col("content")), F.when(rank > 0, rank))).alias(column))
    return own.where(F.col("name").isin([n for _, names in V.DOC_FILES for n in names])).groupBy("repo", F.col("dir").alias("path")).agg(*picks)


def summary(content: Column) -> Column:
    """struct(heading, text): the first heading and up to three lines of what follows it."""
    start = F.struct(F.lit("").alias("heading"), F.array().cast(_STRINGS).alias("found"), F.lit(False).alias("over"))

    def step(s: Column, raw: Column) -> Column:
        line = T.stripped(raw)
        none = s["heading"] == ""
        heads = line.startswith("#") & none
        takes = ~s["over"] & ~heads & ~none & (line != "")
        found = F.when(takes, F.concat(s["found"], F.array(line))).otherwise(s["found"])
        over = s["over"] | (F.size(found) >= 3) | (~none & (line == "") & (F.size(s["found"]) > 0))
        return F.struct(F.when(heads & ~s["over"], T.stripped(F.regexp_replace(line, "^#+", ""))).otherwise(s["heading"]).alias("heading"), found.alias("found"), over.alias("over"))

    done = F.aggregate(F.split(content, "\n", -1), start, step)
    return F.struct(done["heading"].alias("heading"), F.array_join(done["found"], " ").alias("text"))


def notes(texts: DataFrame) -> DataFrame:
    """(repo, path, architecture_notes) from the files of ``docs``, or where there is none of ``doc``."""
    folder = T.basename(F.col("dir"))
    rows = texts.where(~F.col("is_dir") & folder.isin("docs", "doc") & F.col("name").rlike(r"\.(md|txt|rst)$") & F.col("content").isNotNull())
    rows = rows.select("repo", T.dirname(F.col("dir")).alias("path"), folder.alias("folder"), "name", summary(F.col("content")).alias("s"))
    both = texts.where(F.col("is_dir") & (F.col("name") == "docs")).select("repo", F.col("dir").alias("path"), F.lit("doc").alias("folder"))
    rows = rows.join(both, ["repo", "path", "folder"], "left_anti").where("s.heading <> ''")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("repo", "path").orderBy("name"))).where(F.col("k") <= V.NOTES)
    line = F.concat(F.lit("**"), F.col("s.heading"), F.lit("** ("), F.col("name"), F.lit("): "), F.col("s.text"))
    lines = rows.groupBy("repo", "path").agg(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("lines"))  # NOTES at most
    return lines.select("repo", "path", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("architecture_notes"))


def purposes(comps: DataFrame, texts: DataFrame) -> DataFrame:
    """(repo, path, purpose): what a component's package file says it is for."""
    from ..sources import configs

    cfg = comps.select("repo", "path", F.posexplode("config_files").alias("k", "c")).select("repo", "path", "k", F.col("c.path").alias("file"))
    own = texts.where(~F.col("is_dir")).select("repo", F.col("path").alias("file"), "name", "content")
    rows = cfg.join(own, ["repo", "file"])
    pkg = configs.package_json(F.col("content"))
    said = F.when(F.col("name") == "package.json", F.nullif(F.when(pkg["ok"], pkg["description"]), F.lit(""))).when(F.col("name").isin("Cargo.toml", "pyproject.toml", "setup.cfg"), T.find(F.col("content"), V.DESCRIBED_BY))
    return rows.withColumn("purpose", said).where("purpose is not null").groupBy("repo", "path").agg(F.max_by("purpose", "k").alias("purpose"))


def _early(files: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("repo", "owner").orderBy("path")
    return files.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit)


def found_in_files(files: DataFrame) -> DataFrame:
    """(repo, path, env_vars, api_endpoints) of each component's first files, in the order in which they come."""
    rows = _early(files, V.DOC_FILES_READ).where(F.col("language").isin(V.PARSED_LANGUAGES))

    def gathered(column: str, value: Column) -> DataFrame:
        each = rows.select("repo", "owner", "k", F.posexplode(value).alias("place", "x")).groupBy("repo", "owner", "x").agg(F.min(F.struct("k", "place")).alias("at"))
        lists = each.groupBy("repo", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("xs"))  # from DOC_FILES_READ files
        return lists.select("repo", "owner", F.transform("xs", lambda y: y["x"]).alias(column))

    env = gathered("env_vars", T.env_vars(F.col("content")))
    api = gathered("api_endpoints", F.col("endpoints"))
    return env.join(api, ["repo", "owner"], "full").withColumnRenamed("owner", "path")


def patterns(comps: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, patterns): what the names of a component's files tell."""
    name = F.lower("name")
    any_ = lambda words: F.max(T.any_of(name, words))
    test = T.any_of(name, ["test", "spec"])
    flags = files.groupBy("repo", F.col("owner").alias("path")).agg(
        any_(["view"]).alias("view"), any_(["model"]).alias("model"), any_(["controller"]).alias("controller"), any_(["viewmodel", "view_model"]).alias("viewmodel"), any_(["presenter"]).alias("presenter"),
        *[any_(words).alias(f"p{i}") for i, (_, words) in enumerate(V.NAME_PATTERNS)], F.count_if(test).alias("tests"), F.count(F.lit(1)).alias("n"),
    )
    rows = flags.join(comps.select("repo", "path", "type"), ["repo", "path"])
    pair = F.col("view") & F.col("model")
    shape = F.when(pair & F.col("viewmodel"), "MVVM").when(pair & F.col("controller"), "MVC").when(pair & F.col("presenter"), "MVP")
    named = [F.when(F.col(f"p{i}") & (F.lit(label != "Service Layer") | (F.col("type") != "service")), label) for i, (label, _) in enumerate(V.NAME_PATTERNS)]
    tested = [F.when(F.col("tests") / F.col("n") > 0.3, "Well-Tested"), F.when(F.col("tests") > 0, F.concat(F.lit("Tests ("), F.col("tests").cast("string"), F.lit(" files)")))]
    return rows.select("repo", "path", F.filter(F.array(shape, *named, *tested), lambda x: x.isNotNull()).alias("patterns"))


def tech_stack(comps: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, tech_stack): framework, language and what configuration files tell, ascending."""
    table = F.create_map(*[F.lit(x) for p in V.TECH_FILES.items() for x in p])
    found = _early(files, V.TECH_FILES_READ).select("repo", F.col("owner").alias("path"), F.element_at(table, F.lower("name")).alias("tech")).where("tech is not null").groupBy("repo", "path").agg(F.collect_set("tech").alias("files_tell"))
    rows = comps.join(found, ["repo", "path"], "left")
    capital = F.concat(F.upper(F.substring("language", 1, 1)), F.lower(F.substring("language", 2, 1000)))
    own = F.filter(F.array("framework", capital), lambda x: x.isNotNull())
    return rows.select("repo", "path", F.array_sort(F.array_distinct(F.concat(own, F.coalesce("files_tell", F.array().cast(_STRINGS))))).alias("tech_stack"))


def with_docs(comps: DataFrame, files: DataFrame, texts: DataFrame) -> DataFrame:
    """comps with ``docs``: all of the above, with empty values where there is nothing."""
    rows = comps
    for part in (documents(texts), notes(texts), purposes(comps, texts), found_in_files(files), patterns(comps, files), tech_stack(comps, files)):
        rows = rows.join(part, ["repo", "path"], "left")
    none, empty = F.lit(None).cast("string"), F.array().cast(_STRINGS)
    strings = lambda c: F.coalesce(F.col(c), empty).alias(c)
    docs = F.struct(
        "readme", "claude_md", "changelog", none.alias("api_docs"), "architecture_notes", "purpose", empty.alias("key_decisions"), strings("patterns"), strings("tech_stack"), strings("env_vars"),
        F.coalesce(F.col("api_endpoints"), F.array().cast(_ENDPOINTS)).alias("api_endpoints"),
    )
    return rows.select(*comps.columns, docs.alias("docs"))


def project_info(texts: DataFrame) -> DataFrame:
    """(repo, description, repository): the README's first line of text, and the address of its origin."""
    readme = documents(texts).where("path = ''").select("repo", F.col("readme"))
    lines = F.transform(F.split("readme", "\n", -1), T.stripped)
    said = F.get(F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("=")), F.lit(0))
    own = readme.select("repo", F.substring(said, 1, V.DESCRIPTION_LIMIT).alias("description"))
    url = T.stripped(T.find(F.col("content"), r"url\s*=\s*(.+)"))
    url = F.regexp_replace(F.regexp_replace(url, r"git@github\.com:", "https://github.com/"), r"\.git$", "")
    git = texts.where("path = '.git/config'").select("repo", url.alias("repository"))
    return texts.select("repo").distinct().join(own, "repo", "left").join(git, "repo", "left").select("repo", F.coalesce("description", F.lit("")).alias("description"), "repository")
