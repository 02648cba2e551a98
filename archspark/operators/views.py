"""Queries on an architecture: drill-down, visible parts, neighbours, search, annotations.

Component tables are flat, keyed by ``id`` with ``parent_id``. Loops over the tree have
as many turns as the tree has levels; each level is a table in the shared folder, so that a
turn computes one level and not all above it again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions import text as T
from ..sources.storage import cut


# --- the tree -------------------------------------------------------------------------


def component(comps: DataFrame, id_: str) -> DataFrame:
    return comps.where(F.col("id") == id_)


def _levels(comps: DataFrame) -> Iterator[int]:
    """0, 1, 2, ... for loops over the levels of a tree; more levels than components are a cycle."""
    for level in count():
        if level >= 64 and level > comps.count():
            raise ValueError("the components' parents form a cycle")
        yield level


def lineage(comps: DataFrame) -> DataFrame:
    """(id, trail): ids from a root down to each component, itself last."""
    known = comps.where("parent_id is null").select("id", F.array("id").alias("trail"))
    out, rest = known, comps.where("parent_id is not null").select("id", "parent_id")
    for _ in _levels(comps):
        known = cut(rest.join(known.withColumnRenamed("id", "parent_id"), "parent_id").select("id", F.concat("trail", F.array("id")).alias("trail")), "level")
        if known.isEmpty():
            break
        out = out.unionByName(known)
    return out


def breadcrumbs(comps: DataFrame, id_: str) -> DataFrame:
    """(place, id, name, type) from the root to a component."""
    trail = lineage(comps).where(F.col("id") == id_).select(F.posexplode("trail").alias("place", "id"))
    return trail.join(comps.select("id", "name", "type"), "id").select("place", "id", "name", "type").orderBy("place")


def children(comps: DataFrame, id_: str) -> DataFrame:
    return comps.where(F.col("parent_id") == id_)


def can_drill(comps: DataFrame, id_: str) -> bool:
    """A component with neither files nor children is not entered."""
    return not children(comps, id_).isEmpty() or not comps.where((F.col("id") == id_) & (F.size("files") > 0)).isEmpty()


def drill_up(comps: DataFrame, id_: str) -> str | None:
    """The component above, None at the top."""
    row = comps.where(F.col("id") == id_).select("parent_id").first()
    return row["parent_id"] if row else None


def is_hero(kind: Column) -> Column:
    return kind.isin(V.HERO_TYPES)


def is_client(kind: Column) -> Column:
    return kind.isin(V.CLIENT_TYPES)


def is_server(kind: Column) -> Column:
    return kind.isin(V.CALLED_TYPES)


def top_candidates(comps: DataFrame, unwrap: int = 2) -> DataFrame:
    """Ids of the first clients and servers on each way down. Projects and repositories are passed freely, other wrappers ``unwrap`` times."""
    rows = comps.select("id", "parent_id", "type")
    wave = rows.where("parent_id is null").select("id", "type", F.lit(unwrap).alias("budget"))
    found = None
    for _ in _levels(comps):
        ends = is_client(F.col("type")) | is_server(F.col("type"))
        hit = wave.where(ends).select("id")
        found = hit if found is None else found.unionByName(hit)
        free = F.col("type").isin("project", "repository")
        inner = wave.where(~ends & (free | (F.col("budget") > 0))).select(F.col("id").alias("parent_id"), F.when(free, F.col("budget")).otherwise(F.col("budget") - 1).alias("budget"))
        wave = cut(rows.where("parent_id is not null").join(inner, "parent_id").select("id", "type", "budget"), "level")
        if wave.isEmpty():
            break
    return found


def client_facing(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that have an edge with a client, in either direction, and are no client."""
    clients = comps.where(is_client(F.col("type"))).select("id")
    ends = edges.select(F.col("source").alias("a"), F.col("target").alias("id")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("id")))
    return ends.join(clients.withColumnRenamed("id", "a"), "a", "left_semi").join(clients, "id", "left_anti").select("id").distinct()


def top_level(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """What is shown first: all clients and the servers that clients depend on; all servers where none is left, and without either the project's children."""
    ids = top_candidates(comps)
    rows = cut(comps.join(ids, "id", "left_semi").select(*comps.columns), "top")
    if rows.isEmpty():
        roots = comps.where("parent_id is null")
        full = comps.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
        opened = roots.where("type = 'project'").join(full, "id", "left_semi").select(F.col("id").alias("parent_id"))
        return roots.join(opened.withColumnRenamed("parent_id", "id"), "id", "left_anti").unionByName(comps.join(opened, "parent_id", "left_semi").select(*comps.columns))
    clients, servers = rows.where(is_client(F.col("type"))), rows.where(is_server(F.col("type")))
    facing = cut(servers.join(client_facing(comps, edges), "id", "left_semi").select(*comps.columns), "facing")
    if facing.isEmpty() and not clients.isEmpty():
        facing = servers
    return clients.unionByName(facing)


def drilled(comps: DataFrame, id_: str) -> DataFrame:
    """What is shown inside a component: its children, and in place of wrappers the heroes in them.

    A wrapper's children that are neither heroes nor content stay beside the heroes that come out of it.
    """
    rows = children(comps, id_)
    if rows.isEmpty():
        return component(comps, id_)
    tops = rows.where(~is_hero(F.col("type"))).select(F.col("id").alias("top"), "id")
    wave, heroes = tops, None
    for _ in _levels(comps):
        below = cut(comps.select("id", "parent_id", "type").join(wave.withColumnRenamed("id", "parent_id"), "parent_id").select("top", "id", "type"), "level")
        hit = below.where(is_hero(F.col("type"))).select("top", "id")
        heroes = hit if heroes is None else heroes.unionByName(hit)
        wave = below.where(~is_hero(F.col("type"))).select("top", "id")
        if wave.isEmpty():
            break
    opened = heroes.select("top").distinct()
    plain = rows.join(opened.withColumnRenamed("top", "id"), "id", "left_anti").select("id")
    beside = comps.where(~is_hero(F.col("type")) & (F.col("type") != "content")).join(opened.withColumnRenamed("top", "parent_id"), "parent_id", "left_semi").select("id")
    return comps.join(plain.unionByName(heroes.select("id")).unionByName(beside).distinct(), "id", "left_semi").select(*comps.columns)


def visible(comps: DataFrame, edges: DataFrame, id_: str | None = None) -> DataFrame:
    """The components shown at the top (no id) or inside one. Content never; beside heroes no small leaves but libraries and infrastructure."""
    if id_ is None:
        return top_level(comps, edges).where("type <> 'content'")
    rows = drilled(comps, id_)
    hero = is_hero(F.col("type"))
    full = comps.where("parent_id is not null").select(F.col("parent_id").alias("id"), F.lit(True).alias("__full")).distinct()
    some = rows.agg(F.max(hero).alias("__hero"))
    rows = rows.join(F.broadcast(some)).join(full, "id", "left")  # one row
    small = F.col("__hero") & ~hero & ~F.col("type").isin("library", "infrastructure") & F.col("__full").isNull() & (F.size("files") < 10)
    return rows.where((F.col("type") != "content") & ~small).select(*comps.columns)


def other_components(comps: DataFrame, shown: DataFrame) -> DataFrame:
    """(parent_name, id): components that are not shown at the top, by the component above that was passed. Below one that is listed nothing more is."""
    rows = comps.select("id", "parent_id", "name", "type").join(shown.select("id", F.lit(True).alias("__top")).distinct(), "id", "left")
    wave = rows.where("parent_id is null").select("id", "name", "type", "__top", F.lit("Root").alias("under"))
    found = None
    for _ in _levels(comps):
        top, wrap = F.col("__top").isNotNull(), F.col("type").isin("project", "repository")
        hit = wave.where(~top & ~wrap & (F.col("type") != "content")).select(F.col("under").alias("parent_name"), "id")
        found = hit if found is None else found.unionByName(hit)
        inner = wave.where(top | wrap).select(F.col("id").alias("parent_id"), F.when(top, F.col("name")).otherwise(F.col("under")).alias("under"))
        wave = cut(rows.where("parent_id is not null").join(inner, "parent_id").select("id", "name", "type", "__top", "under"), "level")
        if wave.isEmpty():
            break
    return found


# --- edges ----------------------------------------------------------------------------


def induced(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """Edges with both ends among the components shown."""
    ids = shown.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def neighbours(edges: DataFrame, id_: str) -> DataFrame:
    """Edges of a component with ``direction`` and the ``other`` end; an edge to itself goes out."""
    out = F.col("source") == id_
    return edges.where(out | (F.col("target") == id_)).withColumn("direction", F.when(out, "outgoing").otherwise("incoming")).withColumn("other", F.when(out, F.col("target")).otherwise(F.col("source")))


def connection_counts(edges: DataFrame) -> DataFrame:
    """(id, connections); an edge from a component to itself counts once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("connections"))


def edge_category(kind: Column) -> Column:
    return F.when(kind.isin(V.COMMUNICATION), "communication").otherwise("structural")


def edge_labels(edges: DataFrame) -> DataFrame:
    """edges with category and the text shown on them."""
    kind = edge_category(F.col("type"))
    port = F.when(F.coalesce("port", F.lit(0)) != 0, F.concat(F.lit(":"), F.col("port").cast("string")))
    parts = F.concat_ws(" ", F.nullif(F.col("protocol"), F.lit("")), port)
    own = F.coalesce("label", F.lit(""))
    plain = F.when(own != F.col("type"), own).otherwise("")
    return edges.withColumn("category", kind).withColumn("text", F.when(kind == "communication", F.when(parts != "", parts).otherwise(own)).otherwise(plain))


def edge_style(kind: Column) -> Column:
    """struct(color, animated, dash, width); unknown types look like imports."""
    out = None
    for name, (color, animated, dash, width) in reversed(V.EDGE_STYLES.items()):
        style = F.struct(F.lit(color).alias("color"), F.lit(animated).alias("animated"), F.lit(dash).alias("dash"), F.lit(width).alias("width"))
        out = style if name == "import" and out is None else F.when(kind == name, style).otherwise(out if out is not None else F.lit(None))
    plain = V.EDGE_STYLES["import"]
    return F.coalesce(out, F.struct(F.lit(plain[0]).alias("color"), F.lit(plain[1]).alias("animated"), F.lit(plain[2]).alias("dash"), F.lit(plain[3]).alias("width")))


def type_order(kind: Column) -> Column:
    place = F.array_position(F.array(*map(F.lit, V.TYPE_ORDER)), kind) - 1
    return F.when(place >= 0, place).otherwise(V.LAST_TYPE).cast("int")


# --- files and symbols ------------------------------------------------------------------


def files_of(comps: DataFrame, files: DataFrame, id_: str) -> DataFrame:
    own = component(comps, id_).select(F.explode("files").alias("path")).distinct()
    return files.join(own, "path", "left_semi").select(*files.columns)


def symbols_of(comps: DataFrame, files: DataFrame, symbols: DataFrame, id_: str) -> DataFrame:
    ids = files_of(comps, files, id_).select(F.explode("symbols").alias("id")).distinct()
    return symbols.join(ids, "id", "left_semi").select(*symbols.columns)


def symbols_in_file(files: DataFrame, symbols: DataFrame, path: str) -> DataFrame:
    ids = files.where(F.col("path") == path).select(F.explode("symbols").alias("id")).distinct()
    return symbols.join(ids, "id", "left_semi").select(*symbols.columns)


def matching_files(files: DataFrame, words: str) -> DataFrame:
    return files.where(F.lower("path").contains(words.lower())) if words else files


def matching_symbols(symbols: DataFrame, words: str = "", kind: str = "all") -> DataFrame:
    rows = symbols if kind == "all" else symbols.where(F.col("kind") == kind)
    return rows.where(F.lower("name").contains(words.lower())) if words else rows


def symbol_kinds(symbols: DataFrame) -> DataFrame:
    return symbols.select("kind").distinct().orderBy("kind")


def documented(symbols: DataFrame, limit: int = 8) -> DataFrame:
    """The first symbols with documentation, by file and line."""
    return symbols.where("docstring is not null and docstring <> ''").orderBy("file", "line").limit(limit)


def by_directory(files: DataFrame) -> DataFrame:
    """(dir, n, paths) ascending; files at the top are in ``.``."""
    place = T.dirname(F.col("path"))
    return files.groupBy(F.when(place == "", ".").otherwise(place).alias("dir")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("path")).alias("paths")).orderBy("dir")


def doc_sections(comps: DataFrame, id_: str) -> DataFrame:
    """(key, label, content) of a component's documents, in fixed order."""
    each = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(label).alias("label"), F.col(f"docs.{k}").alias("content")) for k, label in V.DOC_SECTIONS])
    return component(comps, id_).select(F.posexplode(F.filter(each, lambda s: F.coalesce(s["content"], F.lit("")) != "")).alias("place", "s")).orderBy("place").select("s.*")


# --- search -----------------------------------------------------------------------------


def search_index(comps: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(type, id, name, path, kind, language) of everything that can be found."""
    none = F.lit(None).cast("string")
    a = comps.select(F.lit("component").alias("type"), "id", "name", "path", F.col("type").alias("kind"), "language")
    b = files.select(F.lit("file").alias("type"), F.col("path").alias("id"), T.basename(F.col("path")).alias("name"), "path", F.col("language").alias("kind"), "language")
    c = symbols.select(F.lit("symbol").alias("type"), "id", "name", F.col("file").alias("path"), "kind", none.alias("language"))
    return a.unionByName(b).unionByName(c)


def fuzzy_distance(text: Column, words: str) -> Column:
    """0 for equal, up to 0.2 for a part (by its place and share), else the edit distance over the longer length."""
    low, query = F.lower(F.coalesce(text, F.lit(""))), words.lower()
    at, n = F.instr(low, query), F.length(low)
    part = 0.1 * (at - 1) / F.greatest(n, F.lit(1)) + 0.1 * (1 - len(query) / F.greatest(n, F.lit(1)))
    return F.when(low == query, 0.0).when(at > 0, part).otherwise(F.levenshtein(low, F.lit(query)) / F.greatest(n, F.lit(len(query))))


def search(index: DataFrame, words: str, limit: int = V.SEARCH_LIMIT) -> DataFrame:
    """The best hits by name, path and kind. The measure is this package's own (``fuzzy_distance``).

    A hit is a row of which some field is within the threshold; the score is the least
    distance, raised for path and kind, which weigh less.
    """
    words = words.strip()
    if len(words) < V.SEARCH_MIN:
        return index.withColumn("score", F.lit(0.0)).limit(0)
    fields = [(fuzzy_distance(F.col(c), words), weight) for c, weight in (("name", 1.0), ("path", 1.1), ("kind", 1.2))]
    least = F.least(*[F.when(d <= V.SEARCH_THRESHOLD, d * w + (w - 1)) for d, w in fields])
    return index.withColumn("score", F.round(least, 6)).where("score is not null").orderBy("score", "type", "id").limit(limit)


def hit(comps: DataFrame, files: DataFrame, symbols: DataFrame, kind: str, id_: str) -> DataFrame:
    """The record behind a search result."""
    return {"component": component(comps, id_), "file": files.where(F.col("path") == id_), "symbol": symbols.where(F.col("id") == id_)}[kind]


# --- annotations --------------------------------------------------------------------------

ANNOTATION = "id string, componentId string, targetType string, targetId string, targetName string, text string, createdAt timestamp"


def target_key() -> Column:
    """What an annotation is about: a component's own by component, others by target."""
    return F.when(F.col("targetType") == "component", F.col("componentId")).otherwise(F.coalesce("targetId", "componentId"))


def current_annotations(log: DataFrame) -> DataFrame:
    """What holds after a log of additions (ANNOTATION rows with ``seq``): one for each target, a component's own by component; blank texts are none."""
    rows = log.withColumn("text", T.stripped(F.col("text"))).where("text <> ''").withColumn("targetId", F.coalesce("targetId", "componentId"))
    last = Window.partitionBy("targetType", target_key()).orderBy(F.col("seq").desc())
    return rows.withColumn("__k", F.row_number().over(last)).where("__k = 1").drop("__k")


def updated(annotations: DataFrame, id_: str, text: str) -> DataFrame:
    return annotations.withColumn("text", F.when(F.col("id") == id_, F.lit(text)).otherwise(F.col("text")))


def deleted(annotations: DataFrame, id_: str | None = None) -> DataFrame:
    """Without one, or with no id without any."""
    return annotations.limit(0) if id_ is None else annotations.where(F.col("id") != id_)


def annotations_for(annotations: DataFrame, component_id: str | None = None, target_type: str | None = None, target_id: str | None = None) -> DataFrame:
    rows = annotations
    for c, x in (("componentId", component_id), ("targetType", target_type), ("targetId", target_id)):
        rows = rows if x is None else rows.where(F.col(c) == x)
    return rows


def annotation_counts(annotations: DataFrame) -> DataFrame:
    """(targetType, annotations, components)."""
    return annotations.groupBy("targetType").agg(F.count(F.lit(1)).alias("annotations"), F.countDistinct("componentId").alias("components"))


# --- formats --------------------------------------------------------------------------------


def format_bytes(n: Column, units: tuple[str, ...] = ("B", "KB", "MB", "GB")) -> Column:
    """n in the largest unit of which it has one; all that is larger stays in the last unit."""
    power = sum(((n >= 1024**k).cast("int") for k in range(1, len(units))), F.lit(0))
    value = F.round(n / F.pow(F.lit(1024.0), power), 1)
    shown = F.regexp_replace(F.format_string("%.1f", value), r"\.0$", "")
    return F.when(n == 0, "0 B").otherwise(F.concat(shown, F.lit(" "), F.element_at(F.array(*map(F.lit, units)), power + 1)))


def format_count(n: Column) -> Column:
    return F.format_number(n, 0)


def format_age(then: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    unit = lambda k, mark: F.concat(F.floor(s / k).cast("string"), F.lit(mark))
    return F.when(s < 60, "just now").when(s < 3600, unit(60, "m ago")).when(s < 86_400, unit(3600, "h ago")).when(s < 604_800, unit(86_400, "d ago")).otherwise(F.date_format(then, "M/d/yyyy"))


def tech_reference(names: DataFrame, table: DataFrame) -> DataFrame:
    """names (name) with the reference (description, url) of table (name, description, url): by the name, in lower case, or without ``.js`` and scope."""
    low = F.lower("name")
    keys = F.array(F.col("name"), low, F.regexp_replace(F.regexp_replace(low, r"\.js$", ""), r"(?U)^@\w+/", ""))
    each = names.select("name", F.posexplode(keys).alias("k", "key"))
    found = each.join(table.withColumnRenamed("name", "key"), "key").groupBy("name").agg(F.min_by(F.struct("description", "url"), "k").alias("r"))
    return names.join(found, "name", "left").select("name", "r.description", "r.url")
