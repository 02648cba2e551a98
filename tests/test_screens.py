"""Screens of apps: the joins against plain loops over one app."""

import random
import re

from archspark import values as V
from archspark.operators import uiflow
from archspark.sources import storage


def bare_name(view: str) -> str:
    for s in V.NAME_SUFFIXES:
        if view.endswith(s) and len(view) > len(s):
            return view[: -len(s)]
    return view


def is_helper(view: str) -> bool:
    return bare_name(view).endswith(V.HELPER_SUFFIXES) or any(x in view for x in V.HELPER_PARTS)


def in_ui_dir(path: str) -> bool:
    return any(p.lower() in V.UI_DIRS for p in path.split("/"))


def human_name(view: str) -> str:
    return re.sub(r"(?<=[a-z])(?=[A-Z])", " ", bare_name(view))


def _shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


def by_hand(app: str, rows: list[dict]) -> tuple[list[dict], list[dict]]:
    """(nodes, edges) of one app by plain loops. rows: its views, in the order of files and places; the last of equal names counts."""
    known: dict[str, dict] = {}
    for r in rows:
        known[r["view"]] = {**known.get(r["view"], {}), **r}
    entry = next((r for r in known.values() if r["main"] and r["tab_view"]), None) or next((r for r in known.values() if r["tab_view"]), None)
    tabs = entry["tabs"] if entry else []
    leads = {v: [t for t in r["targets"] if t["how"] != "embeds" or t["target"] in known] for v, r in known.items()}
    wanted = {t["target"] for ts in leads.values() for t in ts if t["how"] != "embeds"}
    roots = {t["view"] for t in tabs}
    screens = {v: r["path"] for v, r in known.items() if v in roots or (not is_helper(v) and (v in wanted or (in_ui_dir(r["path"]) and v.endswith(V.SCREEN_SUFFIXES))))}
    if not screens and not tabs:
        return [], []
    base = f"{app}/__ui__"
    nodes: list[dict] = []
    edges: list[dict] = []
    node = lambda **x: nodes.append({"parent": None, "description": None, "framework": "SwiftUI", "language": "swift", **x})
    if tabs:
        node(id=f"{base}/tab-bar", name="Tab Bar", type="tab-container", path=entry["path"], parent=app, description=f"{len(tabs)} tabs")
    ids: dict[str, str] = {}
    for t in tabs:
        ids[t["view"]] = own = f"{base}/tab-{t['label'].lower().replace(' ', '-')}"
        said = f"Entry: {human_name(t['view'])}" if t["view"] in screens else None
        node(id=own, name=t["label"], type="tab", path=screens.get(t["view"], ""), parent=f"{base}/tab-bar", description=said)
        edges.append({"source": f"{base}/tab-bar", "target": own, "type": "tab", "label": t["label"]})
    # Distances from every tab at once, by waves.
    far: dict[str, tuple[int, int]] = {}
    for order, t in enumerate(tabs):
        wave, seen, hops = {t["view"]}, {t["view"]}, 0
        while wave:
            hops += 1
            met = {x["target"] for v in wave for x in leads.get(v, ())}
            for v in met:
                far[v] = min(far.get(v, (hops, order)), (hops, order))
            wave = {v for v in met if v in known} - seen
            seen |= wave
    folder = lambda p: p.rsplit("/", 1)[0] if "/" in p else "."
    for v, path in screens.items():
        if v in ids:
            continue
        tab = tabs[far[v][1]]["view"] if v in far else None
        if tab is None and tabs:
            near = [(_shared(folder(known[t["view"]]["path"]), folder(path)), -k) for k, t in enumerate(tabs) if t["view"] in known]
            best = max(near, default=(0, 0))
            tab = tabs[-best[1]]["view"] if best[0] >= 2 else None
        ids[v] = f"{base}/{v.lower()}"
        node(id=ids[v], name=human_name(v), type="screen", path=path, parent=ids[tab] if tab else app)
    for v, ts in leads.items():
        for t in ts:
            if t["how"] != "embeds" and v in ids and t["target"] in ids:
                push = t["how"] == "push"
                edges.append({"source": ids[v], "target": ids[t["target"]], "type": "navigation" if push else "modal", "label": None if push else t["how"]})
    return nodes, edges


FOUND = uiflow.VIEWS + ", app string"
NODE = ["id", "name", "type", "path", "parent", "description"]
EDGE = ["source", "target", "type", "label"]


def flows(spark, apps: dict[str, list[dict]]) -> tuple[list[dict], list[dict]]:
    names = "repo path view place main tab_view tabs targets app".split()
    rows = [tuple({**r, "repo": "r", "app": app}[c] for c in names) for app, views in apps.items() for r in views]
    nodes, edges = uiflow.flow(spark.createDataFrame(rows, FOUND))
    return [r.asDict() for r in nodes.collect()], [r.asDict() for r in edges.orderBy("app", "at").collect()]


def test_flow(spark):
    leads = lambda *t: [{"target": a, "how": b} for a, b in t]
    row = lambda view, path, targets=(), **x: {"view": view, "path": path, "place": 0, "main": False, "tab_view": False, "tabs": [], "targets": leads(*targets), **x}
    tabs = [{"label": "Home", "view": "HomeView"}, {"label": "My Stuff", "view": "StuffView"}]
    rows = [
        row("RootView", "App/App.swift", main=True, tab_view=True, tabs=tabs),
        row("HomeView", "App/UI/Home/HomeView.swift", [("DetailView", "push"), ("StepView", "embeds")]),
        row("StuffView", "App/UI/Stuff/StuffView.swift", [("DetailView", "push"), ("InfoView", "sheet")]),
        row("DetailView", "App/UI/Home/DetailView.swift", [("HomeView", "push")]),
        row("StepView", "App/UI/Home/StepView.swift", [("DeepScreen", "push")]),
        row("DeepScreen", "App/x/DeepScreen.swift"), row("InfoView", "App/x/InfoView.swift"), row("LostView", "App/UI/Stuff/LostView.swift"), row("UserRowView", "App/UI/UserRowView.swift"), row("Other", "Other.swift"),
    ]
    nodes, edges = flows(spark, {"app": rows})
    parent = {n["id"]: n["parent"] for n in nodes}
    b = "app/__ui__"
    assert parent == {
        f"{b}/tab-bar": "app", f"{b}/tab-home": f"{b}/tab-bar", f"{b}/tab-my-stuff": f"{b}/tab-bar", f"{b}/detailview": f"{b}/tab-home", f"{b}/stepview": f"{b}/tab-home", f"{b}/deepscreen": f"{b}/tab-home",
        f"{b}/infoview": f"{b}/tab-my-stuff", f"{b}/lostview": f"{b}/tab-my-stuff",
    }
    kinds = {(e["source"].removeprefix(b), e["target"].removeprefix(b), e["type"], e["label"]) for e in edges}
    assert {("/tab-bar", "/tab-home", "tab", "Home"), ("/tab-home", "/detailview", "navigation", None), ("/tab-my-stuff", "/infoview", "modal", "sheet"), ("/detailview", "/tab-home", "navigation", None)} <= kinds and len(kinds) == 7
    assert flows(spark, {"app": [row("Thing", "a.swift")]}) == ([], [])


def some_app(seed: int) -> list[dict]:
    """Views of an app at random: cycles, repeated names, unknown targets, tabs without a view, no tabs at all."""
    rnd = random.Random(seed)
    names = [f"{a}{b}" for a in ("Home", "More", "List", "Edit", "UserRow", "View") for b in ("View", "Screen", "Sheet", "")]
    folders = ["App", "App/UI/Home", "App/UI/More", "App/Core/x", "Lib/Views/Home"]
    rows = []
    for n in range(rnd.randint(0, 25)):
        targets = [{"target": rnd.choice([*names, "GoneView"]), "how": rnd.choice(["push", "sheet", "fullscreen", "embeds"])} for _ in range(rnd.randint(0, 3))]
        tabs = [{"label": rnd.choice(["Home", "My Stuff", "More", f"Tab {k + 1}"]), "view": rnd.choice([*names, "LostView"])} for k in range(rnd.randint(0, 4))]
        tab_view = rnd.random() < 0.15
        path = f"{rnd.choice(folders)}/F{rnd.randint(0, 9)}.swift" if rnd.random() < 0.9 else f"F{n}.swift"
        rows.append({"view": rnd.choice(names), "path": path, "place": n, "main": rnd.random() < 0.3, "tab_view": tab_view, "tabs": tabs if tab_view else [], "targets": targets})
    return sorted(rows, key=lambda r: (r["path"], r["place"]))


def test_flow_by_hand(spark):
    apps = {f"app{seed:03}": some_app(seed) for seed in range(240)}
    deep = [{"view": f"V{n}View", "path": f"a/{n:03}.swift", "place": 0, "main": n == 0, "tab_view": n == 0, "tabs": [{"label": "A", "view": "V1View"}] if n == 0 else [], "targets": [{"target": f"V{(n + 1) % 12}View", "how": "push"}]} for n in range(12)]
    apps["deep"] = deep
    nodes, edges = flows(spark, apps)
    wanted_nodes, wanted_edges = [], []
    for app, rows in apps.items():
        n, e = by_hand(app, rows)
        wanted_nodes += [{**x, "app": app} for x in n]
        wanted_edges += [{**x, "app": app} for x in e]
    shown = lambda rows, names: sorted((str([r["app"], *[r.get(c) for c in names]])) for r in rows)
    assert len(wanted_nodes) > 500 and len(wanted_edges) > 500
    assert shown(nodes, NODE) == shown(wanted_nodes, NODE)
    assert shown(edges, EDGE) == shown(wanted_edges, EDGE)
    order = lambda rows, app: [[r[c] for c in EDGE] for r in rows if r["app"] == app]
    for app in apps:
        tab = lambda e: e[2] == "tab"
        assert [e for e in order(edges, app) if tab(e)] == [e for e in order(wanted_edges, app) if tab(e)]
        assert [e for e in order(edges, app) if not tab(e)] == [e for e in order(wanted_edges, app) if not tab(e)]


def test_no_views(spark):
    assert flows(spark, {"app": []}) == ([], [])


def test_a_walk_of_many_steps_takes_a_turn_for_several(spark, monkeypatch):
    """A chain with loops back and a second tab further on: nearest tab, first of equals, one table a turn."""
    turns = []
    monkeypatch.setattr(uiflow, "cut", lambda df, name: turns.append(name) or storage.cut(df, name))
    n = 23
    leads = [("r", "a", f"v{i}", f"v{i + 1}") for i in range(n)] + [("r", "a", f"v{i}", f"v{i // 2}") for i in range(n)] + [("r", "a", "w", "v9"), ("r", "b", "v0", "v5")]
    roots = [("r", "a", "v0", 1), ("r", "a", "w", 0), ("r", "b", "x", 0)]
    dist = {}
    for k, start in sorted((k, v) for _, app, v, k in roots if app == "a"):
        wave, steps = {start}, 0
        seen = set()
        while wave:
            for v in wave:
                dist[v] = min(dist.get(v, (steps, k)), (steps, k))
            seen |= wave
            wave = {t for _, app, s, t in leads if app == "a" and s in wave} - seen
            steps += 1
    found = uiflow.nearest_tabs(spark.createDataFrame(leads, "repo string, app string, view string, target string"), spark.createDataFrame(roots, "repo string, app string, view string, k int")).collect()
    assert {r["view"]: r["k"] for r in found if r["app"] == "a"} == {v: k for v, (_, k) in dist.items()}
    assert len(found) == len(dist) + 1
    assert len(turns) <= n // uiflow.HOPS + 1
