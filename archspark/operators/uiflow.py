"""Screens of SwiftUI apps: tabs, screens, and how one leads to another.

An Arrow function takes the views out of files (bodies need balanced braces). The rest
is joins by app and view; the walk from tabs to screens is one join a step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions import text as T
from ..functions.blocks import brace_body
from ..sources.storage import cut

VIEWS = "repo string, path string, view string, place int, main boolean, tab_view boolean, tabs array<struct<label:string,view:string>>, targets array<struct<target:string,how:string>>"
_TABS = pa.list_(pa.struct([("label", pa.string()), ("view", pa.string())]))
_TARGETS = pa.list_(pa.struct([("target", pa.string()), ("how", pa.string())]))


def tabs_of(content: str) -> list[tuple[str, str]]:
    """(label, view) of the first TabView's tabs, left to right: an item's view is the last one made since the item before, its label the first after it."""
    start = re.search(r"\bTabView\b", content)
    body = brace_body(content, start.start()) if start else ""
    items = [m.span() for m in re.finditer(r"\.tabItem", body)]
    made = [(m.start(), m[1]) for m in re.finditer(V.TAB_VIEW, body)]
    out = []
    for k, (at, end) in enumerate(items):
        since, until = items[k - 1][1] if k else 0, items[k + 1][0] if k + 1 < len(items) else len(body)
        label = re.search(V.TAB_LABEL, body[end:until], re.DOTALL)
        if own := [view for place, view in made if since <= place < at]:
            out.append((label[1] if label else f"Tab {k + 1}", own[-1]))
    return out


def targets_of(body: str, own: str) -> list[tuple[str, str]]:
    """(view, how) that a view's body leads to: pushes, sheets and covers, and what it may embed."""
    pushes = dict.fromkeys(x for p in V.PUSHES for x in re.findall(p, body, re.DOTALL))
    modals: dict[str, str] = {}
    for pattern, how in V.SHEETS:
        for x in re.findall(pattern, body, re.DOTALL):
            modals.setdefault(x, how)
    embeds = dict.fromkeys(x for x in re.findall(V.EMBEDDED, body) if x != own)
    return [(x, "push") for x in pushes] + list(modals.items()) + [(x, "embeds") for x in embeds]


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[tuple] = []
        for repo, path, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
            main, tab_view = bool(re.search(r"@main\b", content)), bool(re.search(r"\bTabView\b", content))
            tabs = tabs_of(content) if tab_view else []
            first: dict[str, int] = {}
            for m in re.finditer(V.VIEW, content):
                first.setdefault(m[1], m.start())
            for place, (view, start) in enumerate(first.items()):
                rows.append((repo, path, view, place, main, tab_view, tabs, targets_of(brace_body(content, start), view)))
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), _TABS, _TARGETS]
        data = [[r[k] for r in rows] for k in range(8)]
        data[6] = [[{"label": a, "view": v} for a, v in x] for x in data[6]]
        data[7] = [[{"target": a, "how": v} for a, v in x] for x in data[7]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, kinds, strict=True)], names=["repo", "path", "view", "place", "main", "tab_view", "tabs", "targets"])


def views(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").endswith(".swift")).select("repo", "path", "content").mapInArrow(_views, VIEWS)


APP = ["repo", "app"]


def bare_name(view: Column) -> Column:
    """The name without the first of the usual endings that is not all of it."""
    return F.coalesce(*[F.when(view.endswith(s) & (F.length(view) > len(s)), F.substring(view, F.lit(1), F.length(view) - len(s))) for s in V.NAME_SUFFIXES], view)


def ends_in(text: Column, endings: tuple[str, ...]) -> Column:
    return text.rlike(f"(?:{'|'.join(map(re.escape, endings))})\\z")  # text may be a long expression: it stands here once


def is_helper(view: Column) -> Column:
    return ends_in(bare_name(view), V.HELPER_SUFFIXES) | T.any_of(view, V.HELPER_PARTS)


def in_ui_dir(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, V.UI_DIRS)))


def human_name(view: Column) -> Column:
    return F.regexp_replace(bare_name(view), "(?<=[a-z])(?=[A-Z])", " ")


def _folders(path: Column) -> Column:
    return F.split(F.regexp_replace(path, "/?[^/]*$", ""), "/")


def _shared(a: Column, b: Column) -> Column:
    """How many items two arrays have in common from their start."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same))


def latest(found: DataFrame) -> DataFrame:
    """A row for each view of an app: where it was met first, and all else as its last file has it."""
    at = F.struct("path", "place")
    last = F.max_by(F.struct("path", "main", "tab_view", "tabs", "targets"), at)
    return found.groupBy(*APP, "view").agg(F.min(at).alias("first"), last.alias("r")).select(*APP, "view", "first", "r.*")


#: Steps of one turn of the walk.
HOPS = 4


def nearest_tabs(leads: DataFrame, roots: DataFrame) -> DataFrame:
    """(repo, app, view, k): the tab from which a view takes the fewest steps, of several the first one.

    roots: (repo, app, view, k). A turn goes ``HOPS`` steps on from the views that the turn before met last, each step one join and
    one minimum by (steps, k), and leaves out what was met already, so cycles end. Views that a turn meets by fewer steps have no
    others to lead to that it has not met, so only the last ones go on.
    """
    steps = leads.select(*APP, "view", "target").distinct()
    wave = met = roots
    while True:
        near = wave.select(*APP, "view", F.struct(F.lit(0).alias("n"), "k").alias("at"))
        for n in range(HOPS):
            on = near.join(steps, [*APP, "view"], "left").withColumn("last", F.col("at.n") == n)
            both = F.array(F.struct("view", "at"), F.when(F.col("last") & F.col("target").isNotNull(), F.struct(F.col("target").alias("view"), F.struct((F.col("at.n") + 1).alias("n"), F.col("at.k").alias("k")).alias("at"))))
            near = on.select(*APP, F.explode(both).alias("x")).where("x is not null").groupBy(*APP, F.col("x.view").alias("view")).agg(F.min("x.at").alias("at"))
        new = cut(near.join(met, [*APP, "view"], "left_anti").select(*APP, "view", F.col("at.k").alias("k"), F.col("at.n").alias("n")), "wave")
        met, wave = met.unionByName(new.drop("n")), new.where(F.col("n") == HOPS).drop("n")
        if wave.isEmpty():
            return met


def flow(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(screens, edges) of apps. found: (repo, app) and the views of its files; of equal names the last counts.

    The tabs are those of the first view that is the app's entry and holds a TabView, else of the first that holds one.
    Screens are the tabs' views and those that are led to, or that stand in a folder of screens under a screen's name, but
    no helpers. A screen belongs to the tab that is nearest, else to the one that shares most folders, two at least, else
    to the app.
    """
    base = F.concat("app", F.lit("/__ui__"))
    bar = F.concat(base, F.lit("/tab-bar"))
    number = lambda c: F.lpad(F.col(c).cast("string"), 10, "0")
    known = cut(latest(found), "views")
    entries = known.where("tab_view").groupBy(*APP).agg(F.min_by(F.struct("path", "tabs"), F.struct(~F.col("main"), F.col("first"))).alias("e")).select(*APP, "e.*").where("size(tabs) > 0")
    slug = F.concat(base, F.lit("/tab-"), F.replace(F.lower("label"), F.lit(" "), F.lit("-")))
    tabs = cut(entries.select(*APP, F.posexplode("tabs").alias("k", "t")).select(*APP, "k", "t.*").withColumn("id", slug), "tabs")
    roots = tabs.groupBy(*APP, "view").agg(F.min("k").alias("k"), F.max_by("id", "k").alias("tab_id"))
    each = known.select(*APP, "view", "first", F.posexplode("targets").alias("nth", "t")).select(*APP, "view", "first", "nth", "t.*")
    made = known.select(*APP, F.col("view").alias("target"), F.lit(True).alias("made"))
    leads = cut(each.join(made, [*APP, "target"], "left").where("how <> 'embeds' or made").drop("made"), "leads")
    wanted = leads.where("how <> 'embeds'").select(*APP, F.col("target").alias("view"), F.lit(True).alias("wanted")).distinct()
    view, path = F.col("view"), F.col("path")
    listed = F.coalesce("wanted", in_ui_dir(path) & ends_in(view, V.SCREEN_SUFFIXES))
    screens = known.join(wanted, [*APP, "view"], "left").where(~is_helper(view) & listed).select(*APP, "view", "path")
    screens = screens.join(roots, [*APP, "view"], "left_anti").withColumn("id", F.concat(base, F.lit("/"), F.lower("view")))
    screens = screens.join(nearest_tabs(leads, roots.drop("tab_id")), [*APP, "view"], "left")

    placed = tabs.select(*APP, "k", "view").join(roots.drop("k"), [*APP, "view"]).join(known.select(*APP, "view", "path"), [*APP, "view"], "left")
    placed = placed.groupBy(*APP).agg(F.collect_list(F.struct("k", "tab_id", _folders(path).alias("folders"))).alias("all"))  # the items of one TabView
    near = F.transform(F.filter("all", lambda t: t["folders"].isNotNull()), lambda t: F.struct(_shared(t["folders"], _folders(path)).alias("n"), (-t["k"]).alias("k"), t["tab_id"].alias("id")))
    best = F.array_max(near)
    own = F.get(F.filter("all", lambda t: t["k"] == F.col("k")), F.lit(0))["tab_id"]
    screens = screens.join(placed, APP, "left").withColumn("parent", F.coalesce(own, F.when(best["n"] >= 2, best["id"]), F.col("app"))).drop("all", "k")
    screens = cut(screens, "screens")

    column = lambda c, name: (F.lit(c) if c is None or isinstance(c, str) else c).cast("string").alias(name)
    node = lambda rows, *values: rows.select(*APP, *[column(v, n) for v, n in zip(values, ["id", "name", "type", "path", "parent", "description"], strict=True)])
    files = known.select(*APP, "view", "path")
    nodes = node(entries, bar, "Tab Bar", "tab-container", path, F.col("app"), F.concat(F.size("tabs"), F.lit(" tabs")))
    said = F.when(path.isNotNull(), F.concat(F.lit("Entry: "), human_name(view)))
    nodes = nodes.unionByName(node(tabs.join(files, [*APP, "view"], "left"), F.col("id"), F.col("label"), "tab", F.coalesce("path", F.lit("")), bar, said))
    nodes = nodes.unionByName(node(screens, F.col("id"), human_name(view), "screen", path, F.col("parent"), None))

    at = lambda *keys: F.struct(*[k.alias(f"k{j}") for j, k in enumerate([F.col("app"), *keys])]).alias("at")
    edge = lambda rows, place, *values: rows.select(*APP, place, *[column(v, n) for v, n in zip(values, ["source", "target", "type", "label"], strict=True)])
    edges = edge(tabs, at(F.lit("0"), number("k"), F.lit("")), bar, F.col("id"), "tab", F.col("label"))
    ids = screens.select(*APP, "view", "id").unionByName(roots.select(*APP, "view", F.col("tab_id").alias("id")))
    led = leads.where("how <> 'embeds'").join(ids.withColumnRenamed("id", "source"), [*APP, "view"])
    led = led.join(ids.select(*APP, F.col("view").alias("target"), F.col("id").alias("to")), [*APP, "target"])
    push = F.col("how") == "push"
    place = at(F.concat(F.lit("1"), F.col("first.path")), number("first.place"), number("nth"))
    return nodes, edges.unionByName(edge(led, place, F.col("source"), F.col("to"), F.when(push, "navigation").otherwise("modal"), F.when(~push, F.col("how"))))


def ui_flows(comps: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(screens, edges) of all client apps in a UI framework; an app's views are those of its files and of all components below."""
    apps = comps.where(F.col("type").isin(V.UI_TYPES) & F.col("framework").isin(V.UI_FRAMEWORKS)).select("repo", F.col("id").alias("app"), F.col("path").alias("app_path"))
    found = views(files).join(files.select("repo", "path", "owner"), ["repo", "path"])
    above = found.select("*", F.explode(F.concat(F.when(F.col("owner") == "", F.array(F.lit(""))).otherwise(F.filter(T.ancestors(F.col("owner")), lambda a: a != "")), F.when(F.col("owner") == "", F.array().cast("array<string>")).otherwise(F.array("owner")))).alias("app_path"))
    return flow(above.join(apps, ["repo", "app_path"]).drop("app_path", "owner"))
