"""The graph between components, by joins.

Each producer returns edges with a ``stage`` and an ``at`` (where in its stage the edge
was found); of edges with the same source, target and type the earliest stays. What the
text of files can match is first extracted from it (ports, addresses, quoted names), so
that joins run on short values and on equality; names in addresses are found by automata (``names``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions import text as T
from .components import resolve_imports
from .names import containing, matches

EDGE = ["repo", "source", "target", "type", "label", "protocol", "port", "bidirectional", "stage", "at"]


def _edges(rows: DataFrame, stage: int, kind: str, label: Column | str | None, at: list, port: Column | None = None) -> DataFrame:
    """rows has repo, source, target (component ids)."""
    http = kind == "http"
    text = label if isinstance(label, Column) else F.lit(label)
    parts = [*[F.col(c) if isinstance(c, str) else c for c in at], *[F.lit("")] * 4][:4]
    return rows.where("source <> target").select(
        "repo", "source", "target", F.lit(kind).alias("type"), text.cast("string").alias("label"), F.lit("HTTP" if http else None).cast("string").alias("protocol"),
        (port if port is not None else F.lit(None)).cast("long").alias("port"), F.lit(http).alias("bidirectional"), F.lit(stage).alias("stage"),
        F.struct(*[F.coalesce(p.cast("string"), F.lit("")).alias(f"k{i}") for i, p in enumerate(parts)]).alias("at"),
    )


def _order(c: Column | str) -> Column:
    """A component's order as text that sorts like it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(c["kind"].cast("string"), F.lit(":"), c["path"])


def _digits(c: str) -> Column:
    return F.lpad(F.col(c).cast("string"), 10, "0")


def _called(comps: DataFrame) -> DataFrame:
    return comps.where(F.col("type").isin(V.CALLED_TYPES)).select("repo", F.col("id").alias("target"), F.col("path").alias("target_path"), F.col("name").alias("target_name"), F.col("port").alias("target_port"), F.col("ord").alias("target_ord"))


def _sources(files: DataFrame, comps: DataFrame) -> DataFrame:
    """files with what their component is; files of content are left out."""
    own = comps.where("type <> 'content'").select("repo", F.col("path").alias("owner"), F.col("id").alias("source"), F.col("type").alias("source_type"))
    return files.join(own, ["repo", "owner"])


def import_edges(files: DataFrame, comps: DataFrame) -> DataFrame:
    found = _sources(files, comps).select("repo", F.col("path").alias("file"), "source", F.posexplode("imports").alias("place", "import"))
    meant = resolve_imports(found, comps).where("target is not null").withColumnRenamed("target", "target_path")
    to = comps.where("type <> 'content'").select("repo", F.col("path").alias("target_path"), F.col("id").alias("target"))
    return _edges(meant.join(to, ["repo", "target_path"]), 1, "import", F.col("import"), ["file", _digits("place")])


def port_edges(files: DataFrame, comps: DataFrame) -> DataFrame:
    """Files that name the port of another component; of components with one port the last has it."""
    owned = comps.where("type <> 'content' and port is not null and port <> 0")
    last = owned.groupBy("repo", "port").agg(F.max_by(F.struct(F.col("id").alias("target"), F.col("ord")), "ord").alias("t"), F.min("ord").alias("first"))
    last = last.select("repo", "port", "t.target", "first")
    found = _sources(files.where(F.col("language").isin(V.CODE_LANGUAGES)), comps).select("repo", F.col("path").alias("file"), "source", F.explode(T.referred_ports(F.col("content"))).alias("port"))
    rows = found.withColumn("port", F.col("port").cast("long")).join(last, ["repo", "port"])
    return _edges(rows, 2, "http", F.concat(F.lit("port "), F.col("port").cast("string")), ["file", _order("first")], F.col("port"))


def service_names(comps: DataFrame) -> DataFrame:
    """(repo, service, target, first): names by which a component may be called.

    A name belongs to the last component that has it, and keeps the place of the first.
    """
    name, folder = F.lower("name"), F.lower(T.basename(F.col("path")))
    swap = lambda c, pairs: F.replace(swap(c, pairs[:-1]), F.lit(pairs[-1][0]), F.lit(pairs[-1][1])) if pairs else c
    placed = F.col("path") != ""
    variants = F.array(
        swap(name, [(" ", "-"), ("_", "-")]), swap(name, [(" ", "_"), ("-", "_")]), swap(name, [(" ", ""), ("-", ""), ("_", "")]),
        F.when(placed, folder), F.when(placed, swap(folder, [("-", "_")])), F.when(placed, swap(folder, [("_", "-")])),
    )
    each = comps.where("type <> 'content'").select("repo", "id", "ord", F.posexplode(variants).alias("place", "service")).where("service is not null and length(service) > 3")
    at = F.struct("ord", "place")
    return each.groupBy("repo", "service").agg(F.max_by("id", at).alias("target"), F.min(at).alias("first"))


def service_edges(files: DataFrame, comps: DataFrame) -> DataFrame:
    """Files that name another component where an address stands."""
    c = F.col("content")
    contexts = F.concat(
        F.transform(T.find_all(c, r"""["']https?://[^"']*["']?""", 0, "i"), lambda x: F.struct(F.lit("url").alias("kind"), x.alias("text"))),
        F.transform(T.find_all(c, r"""["'](?:http://|https://)?[^"'\n]+:\d+["']""", 0, "i"), lambda x: F.struct(F.lit("port").alias("kind"), x.alias("text"))),
        F.transform(T.find_all(c, r"""host\s*[=:]\s*["'][^"']*["']""", 0, "i"), lambda x: F.struct(F.lit("host").alias("kind"), x.alias("text"))),
        F.transform(T.find_all(c, r"(?:API_|SERVER_|SERVICE_)\S*", 0, "i"), lambda x: F.struct(F.lit("constant").alias("kind"), x.alias("text"))),
    )
    found = _sources(files.where(F.col("language").isin(V.CODE_LANGUAGES)), comps).select("repo", F.col("path").alias("file"), "source", F.explode(F.array_distinct(contexts)).alias("x")).select("repo", "file", "source", "x.*")
    places = found.select("repo", "kind", "text").distinct()
    q = T.quoted(F.col("service"))
    like = lambda *parts: F.rlike(F.col("text"), F.concat(F.lit("(?iUd)"), *[q if p is None else F.lit(p) for p in parts]))
    rules = (
        F.when(F.col("kind") == "url", like("[\"']https?://", None, "[:/'\".]") | like("[\"']https?://[^\"']*\\.", None, "\\."))
        .when(F.col("kind") == "port", like("[\"'](?:http://|https://)?", None, ":\\d+[\"']"))
        .when(F.col("kind") == "host", like("host\\s*[=:]\\s*[\"'](?:[^\"']*\\.)?", None, "[\"']"))
        .otherwise(like("(?:API_|SERVER_|SERVICE_)", None))
    )
    named = containing(places.withColumn("low", F.lower("text")), service_names(comps), "low", "service").where(rules).drop("low")
    rows = found.join(named, ["repo", "kind", "text"]).select("repo", "file", "source", "target", "service", "first")
    return _edges(rows, 3, "http", F.concat(F.lit("calls "), F.col("service")), ["file", _order(F.col("first.ord")), F.col("first.place").cast("string")])


def client_edges(files: DataFrame, comps: DataFrame) -> DataFrame:
    """Client files with HTTP calls and the servers that their addresses name, or the only server there is."""
    asking = _sources(files.where(F.col("language").isin(list(V.HTTP_CLIENTS))), comps).where(F.col("source_type").isin(V.CALLING_TYPES) & T.http_client(F.col("language"), F.col("content")))
    asking = asking.select("repo", F.col("path").alias("file"), "source", T.urls(F.col("content")).alias("urls"))
    servers = _called(comps)
    only = servers.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("target", "target_ord")]).where("n = 1").drop("n")
    name, folder = F.lower("target_name"), F.when(F.col("target_path") != "", F.lower(T.basename(F.col("target_path"))))
    signs = F.array(F.replace(name, F.lit(" "), F.lit("-")), F.replace(name, F.lit(" "), F.lit("_")), folder, F.when(F.coalesce("target_port", F.lit(0)) != 0, F.concat(F.lit(":"), F.col("target_port").cast("string"))))
    servers = servers.select("repo", "target", "target_ord", F.explode(F.array_distinct(signs)).alias("sign")).where("length(sign) > 2")
    each = asking.select("repo", "file", "source", F.explode("urls").alias("url"))
    named = containing(each.select("repo", "url").distinct(), servers, "url", "sign").select("repo", "url", "target", "target_ord").distinct()
    rows = each.join(named, ["repo", "url"]).drop("url").distinct().unionByName(asking.drop("urls").join(only, "repo"))
    return _edges(rows, 4, "http", "API call", ["file", _order("target_ord")])


def companion_edges(comps: DataFrame) -> DataFrame:
    """Each watch app and its phone app: in the same directory or with its name inside, else the first.

    The first phone app of each directory, of each name and of each repository are rows of their own, so that no watch app meets all phone apps.
    """
    core = T.stripped(F.replace(F.replace(F.lower("name"), F.lit(" watch"), F.lit("")), F.lit("watch"), F.lit("")))
    folder = T.dirname(F.col("path")).alias("folder")
    watch = comps.where("type = 'watch-app'").select("repo", F.col("id").alias("source"), core.alias("core"), folder, F.col("ord").alias("w_ord"))
    phone = comps.where("type = 'ios-client'").select("repo", F.lower("name").alias("name"), folder, F.struct(F.col("ord"), F.col("id")).alias("own"))
    first = phone.groupBy("repo").agg(F.min("own").alias("first"))  # a row for each repository
    near = phone.groupBy("repo", "folder").agg(F.min("own").alias("near"))
    of_name = phone.groupBy("repo", "name").agg(F.min("own").alias("own"))
    pairs = matches(of_name.select("repo", F.col("name").alias("text")), watch.select("repo", F.col("core").alias("word")))
    named = pairs.join(of_name.withColumnRenamed("name", "text"), ["repo", "text"]).groupBy("repo", F.col("word").alias("core")).agg(F.min("own").alias("named"))
    rows = watch.join(near, ["repo", "folder"], "left").join(named, ["repo", "core"], "left").join(F.broadcast(first), "repo")
    fits = F.least("near", "named", F.when(F.col("core") == "", F.col("first")))  # every name has the empty one inside
    best = rows.select("repo", "source", F.coalesce(fits, "first")["id"].alias("target"), "w_ord")
    return _edges(best, 5, "import", "companion app", [_order("w_ord")])


def fallback_edges(found: DataFrame, comps: DataFrame) -> DataFrame:
    """All clients with all servers of a repository in which no client has an HTTP edge yet."""
    clients = comps.where(F.col("type").isin(V.CALLING_TYPES)).select("repo", F.col("id").alias("source"), F.col("ord").alias("c_ord"))
    known = found.where("type = 'http'").join(clients.select("repo", "source"), ["repo", "source"], "left_semi").select("repo").distinct()
    rows = clients.join(_called(comps), "repo").join(known, "repo", "left_anti")
    return _edges(rows, 7, "http", "API (inferred)", [_order("c_ord"), _order("target_ord")])


#: Watch apps and phone apps of a repository are dealt to so many blocks each; a task pairs one block with another.
PAIR_BLOCKS = 16


def watch_edges(files: DataFrame, comps: DataFrame) -> DataFrame:
    """Swift files that import the watch's connection, on either side: with every app of the other side.

    Each pair is made once, with its first place. There are as many edges as such pairs, but what tasks send each other is ``PAIR_BLOCKS`` rows an app.
    """
    users = files.where((F.col("language") == "swift") & F.arrays_overlap("imports", F.array(*map(F.lit, V.WATCH_IMPORTS)))).groupBy("repo", "owner").agg(F.min("path").alias("file"))
    apps = comps.where(F.col("type").isin("watch-app", "ios-client")).select("repo", F.col("path").alias("owner"), "id", "type", "ord")
    apps = apps.join(users, ["repo", "owner"], "left").groupBy("repo", "id", "type").agg(F.min("file").alias("file"), F.min("ord").alias("ord"))
    own, other = F.pmod(F.xxhash64("id"), F.lit(PAIR_BLOCKS)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PAIR_BLOCKS - 1).cast("long")))
    side = lambda kind, mark, i, j: apps.where(F.col("type") == kind).select(F.col("repo").alias("repo"), i.alias("i"), j.alias("j"), F.col("id").alias(mark), F.col("file").alias(f"{mark}_file"), _order("ord").alias(f"{mark}_ord")).repartition(PAIR_BLOCKS**2, "repo", "i", "j")  # noqa: E731  # few bytes, many pairs: a number of tasks that stays
    rows = side("watch-app", "source", own, other).join(side("ios-client", "target", other, own).hint("shuffle_hash"), ["repo", "i", "j"]).where("source_file is not null or target_file is not null")
    from_watch = F.col("target_file").isNull() | (F.struct("source_file", "target_ord") <= F.struct("target_file", "source_ord"))
    from_watch = F.col("source_file").isNotNull() & from_watch
    return _edges(rows, 9, "import", "WatchConnectivity", [F.when(from_watch, F.col("source_file")).otherwise(F.col("target_file")), F.when(from_watch, F.col("target_ord")).otherwise(F.col("source_ord"))])


def config_edges(files: DataFrame, comps: DataFrame) -> DataFrame:
    """Client configuration files that hold a server's address."""
    named = F.col("name").startswith(".env") | F.col("name").isin(V.NEXT_CONFIGS)
    own = _sources(files.where(named), comps).where(F.col("source_type").isin(V.CALLING_TYPES))
    found = F.concat(*[T.find_all(F.col("content"), p, 1, "i") for p in V.ENV_URLS])
    urls = own.select("repo", "source", F.col("path").alias("file"), F.posexplode(found).alias("place", "url")).where(~F.col("url").startswith("$"))
    port = F.when(F.coalesce("target_port", F.lit(0)) != 0, F.concat(F.lit(":"), F.col("target_port").cast("string")))
    signs = F.array_distinct(F.array(port, F.replace(F.lower("target_name"), F.lit(" "), F.lit("-"))))
    servers = _called(comps).select("repo", "target", "target_ord", F.explode(signs).alias("sign")).where("sign <> ''")
    places = urls.select("repo", "url").distinct().withColumn("low", F.lower("url"))
    named = containing(places, servers, "low", "sign").select("repo", "url", "target", "target_ord").distinct()
    return _edges(urls.join(named, ["repo", "url"]), 10, "http", "env config", ["file", _digits("place"), _order("target_ord")])


def external_services(files: DataFrame, comps: DataFrame) -> DataFrame:
    """(repo, source, external_services): cloud services whose addresses a component's code holds, by name."""
    c = F.col("content")

    def called(domain: str) -> Column:
        d = domain.replace(".", r"\.")
        return c.contains(domain) & T.has(c, rf"""["']https?://{d}|wss?://{d}|host["\s:=]+["']?{d}""")

    kind = "struct<name:string,category:string>"
    hits = F.array(*[F.when(called(d), F.struct(F.lit(n).alias("name"), F.lit(k).alias("category"))) for d, n, k in V.CLOUD_APIS]).cast(f"array<{kind}>")
    found = _sources(files.where(F.col("language").isin(V.CODE_LANGUAGES)), comps).select("repo", "source", F.explode(F.filter(hits, lambda s: s.isNotNull())).alias("s"))
    return found.groupBy("repo", "source").agg(F.array_sort(F.collect_set("s")).alias("external_services"))  # at most as many as there are known services


def first_of_each(edges: DataFrame) -> DataFrame:
    """Of edges with one source, target and type the first by stage and place."""
    first = Window.partitionBy("repo", "source", "target", "type").orderBy("stage", "at")
    return edges.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")


def relationships(files: DataFrame, comps: DataFrame) -> DataFrame:
    """All edges but those of screens; files carry owner, imports and content."""
    early = first_of_each(
        import_edges(files, comps).unionByName(port_edges(files, comps)).unionByName(service_edges(files, comps)).unionByName(client_edges(files, comps)).unionByName(companion_edges(comps))
    )
    return first_of_each(early.unionByName(fallback_edges(early, comps)).unionByName(watch_edges(files, comps)).unionByName(config_edges(files, comps)))


def with_screens(edges: DataFrame, screens: DataFrame) -> DataFrame:
    """All edges (EDGE), those between screens (repo, source, target, type, label, at) behind the others."""
    none = {"protocol": F.lit(None).cast("string"), "port": F.lit(None).cast("long"), "bidirectional": F.lit(False), "stage": F.lit(12)}
    return edges.unionByName(screens.withColumns(none).select(*EDGE))
