"""Whole analyses of small trees."""

import json
import plistlib

import pytest
from pyspark.sql import functions as F

from archspark.operators import multirepo, views
from archspark.operators import symbols as S
from archspark.plans.analyze import analyze, tables
from archspark.sources import export
from archspark.sources.tree import read_tree, with_text

MONO = {
    "README.md": "# Mono\n\nA set of services.\n",
    "package.json": json.dumps({"name": "mono-root", "description": "All of it"}),
    ".git/config": '[remote "origin"]\n\turl = git@github.com:acme/mono.git\n',
    "web/package.json": json.dumps({"name": "web-app", "description": "The site", "dependencies": {"react": "18"}}),
    "web/src/App.tsx": "import React from 'react';\nimport './lib/util';\n\nexport const App = () => {\n  fetch('http://api-svc:8080/items');\n}\n",
    "web/src/Button.tsx": "export function Button() {\n}\n",
    "web/src/lib/util.ts": "export type Id = string;\n",
    "web/src/lib/more.ts": "import { x } from 'shared';\n",
    "web/next.config.js": "module.exports = { API_URL: 'http://localhost:8080' }\n",
    "api/pyproject.toml": '[project]\nname = "api-svc"\ndescription = "Serves items"\n',
    "api/main.py": '"""Entry."""\nimport os\nfrom flask import Flask\n\n\nclass Api:\n    """Serves."""\n\n\n@app.get(\'/items\')\ndef items():\n    return os.environ["DB_URL"] + "https://api.stripe.com/v1"\n\n\napp.run(host=x, port=8080)\n',
    "api/__init__.py": "x = 1\r\ny = 2\r\n",
    "api/_test_main.py": "import shared\n",
    "api/empty.py": "",
    "api/docs/one.md": "# One\nfirst\n",
    "api/docs/two.txt": "no heading",
    "shared/setup.py": "import setuptools\n",
    "shared/model.py": b"name = '\xff\xfe'\n",
    "shared/view.py": "a = 1\n",
    "shared/viewmodel.py": "a = 1\n",
    "scripts/Makefile": "all:\n",
    "scripts/log_server.py": "import http.server\ndefault = 9100\n",
    "infra/docker-compose.yml": "services:\n  db:\n    ports:\n      - '5432:5432'\n",
    "third/Makefile": "x", "third/LICENSE": "x", "third/top.c": "int x;\n", **{f"third/d{i}/a.c": "int a;\n" for i in range(6)},
    "notes/docs/x.md": "text\n", "notes/docs/y.md": "text\n",
    "node_modules/a/index.js": "x\n", "build/x.py": "x\n", "pic.png": b"\x89PNG",
}

TABBED = 'import SwiftUI\n@main\nstruct RootView: View {\n  var body: some View { TabView { HomeView().tabItem { Label("Home", systemImage: "x") } } }\n}\n'
IOS = {
    "Phone/Info.plist": plistlib.dumps({"CFBundleName": "Phone App"}, fmt=plistlib.FMT_BINARY),
    "Phone/App.swift": TABBED + 'let u = URLSession.shared\nlet s = "http://backend/x"\n',
    "Phone/UI/HomeView.swift": "import SwiftUI\nimport WatchConnectivity\nstruct HomeView: View { var body: some View { NavigationLink(destination: DetailView()) } }\n",
    "Phone/UI/DetailView.swift": "import SwiftUI\nstruct DetailView: View { }\n",
    "Phone Watch/Info.plist": "not a plist",
    "Phone Watch/Watch.swift": "import SwiftUI\nstruct Face: View { }\n",
    "backend/Cargo.toml": '[package]\nname = "backend"\n[dependencies]\naxum = "0.7"\n',
    "backend/src/main.rs": 'use axum::Router;\n/// Starts\npub fn main() {\n  x.listen(7000)\n}\n',
    "backend/src/lib.rs": "use std::io;\n",
}


def put(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())


@pytest.fixture(scope="module")
def merged(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("repos")
    put(base / "mono", MONO)
    put(base / "phones", IOS)
    config = base / "config.json"
    rule = {"source_repo": "apps", "target_repo": "mono", "type": "http", "label": "calls", "port": 8080, "bidirectional": True}
    config.write_text(json.dumps({"solution": "Both", "description": "d", "repositories": [{"name": "mono", "path": "mono"}, {"name": "apps", "path": str(base / "phones")}], "cross_repo_relationships": [rule]}))
    arch = multirepo.analyze_all(spark, str(config))
    return arch, export.document(arch)


@pytest.fixture(scope="module")
def comps(merged):
    found = {}

    def walk(nodes):
        for n in nodes:
            found[n["id"]] = n
            walk(n["children"])

    walk(merged[1]["components"])
    return found


def test_components(comps):
    kind = {k: (c["name"], c["type"], c["framework"], c["port"]) for k, c in comps.items()}
    assert kind["mono/root"][:2] == ("mono-root", "package")
    assert kind["mono/web"] == ("web-app", "web-client", None, None)
    assert kind["mono/web/src"] == ("src", "web-client", "React", None)
    assert kind["mono/api"] == ("api-svc", "api-server", "Flask", 8080)
    assert kind["mono/shared"][:2] == ("shared", "package")
    assert kind["mono/scripts"] == ("Log Server", "service", None, 9100)
    assert kind["mono/infra"] == ("infra", "content", None, 5432)
    assert kind["mono/third"][:2] == ("third", "library")
    assert kind["mono/notes/docs"][1] == "content"
    assert kind["apps/phone"][:3] == ("Phone App", "ios-client", "SwiftUI")
    assert kind["apps/phone-watch"][:2] == ("Phone Watch", "watch-app")
    assert kind["apps/backend"] == ("backend", "api-server", None, 7000)  # its child's
    assert kind["apps/backend/src"][1:] == ("api-server", "Axum", 7000)
    assert kind["repo:mono"][:2] == ("mono", "repository") and not any("d0" in k or "node_modules" in k or k.startswith("mono/build") for k in kind)


def test_files_and_metrics(merged, comps):
    _, made = merged
    files = {f["path"]: f for f in made["files"]}
    assert "mono/api/__init__.py" in files and "mono/api/empty.py" not in files and "mono/third/top.c" in files and "mono/third/d0/a.c" not in files and "mono/build/x.py" not in files and "mono/pic.png" not in files
    assert files["mono/api/__init__.py"]["lines"] == 3 and files["mono/api/__init__.py"]["size_bytes"] == 14
    assert files["mono/api/main.py"]["imports"] == ["flask", "os"] and files["mono/api/main.py"]["module_doc"] == "Entry."
    api = comps["mono/api"]["metrics"]
    python = [MONO[f"api/{n}.py"].count("\n") + 1 for n in ("main", "__init__", "_test_main")]
    assert api["files"] == 5 and api["languages"]["python"] == sum(python) and api["symbols"] == 2
    assert comps["repo:mono"]["metrics"]["files"] == sum(p.startswith("mono/") for p in files)
    assert made["stats"]["total_files"] == len(files) and made["stats"]["languages"]["rust"] == 8


def test_docs(comps):
    api = comps["mono/api"]["docs"]
    assert api["purpose"] == "Serves items" and api["env_vars"] == ["DB_URL"] and [tuple(e.values()) for e in api["api_endpoints"]] == [("GET", "/items")]
    assert api["architecture_notes"] == "**One** (one.md): first" and api["tech_stack"] == ["Flask", "Python"]
    assert "MVVM" in comps["mono/shared"]["docs"]["patterns"]
    assert comps["mono/api"]["external_services"] == [{"name": "Stripe", "category": "payments"}]
    assert comps["mono/root"]["docs"]["readme"].startswith("# Mono") and comps["repo:mono"]["description"] == "A set of services."
    assert comps["mono/infra"]["config_files"][0]["ports"] == [{"service": "db", "host": 5432, "container": 5432}]


def test_relationships(merged):
    edges = {(e["source"], e["target"], e["type"]): e for e in merged[1]["relationships"]}
    assert edges["mono/api", "mono/shared", "import"]["label"] == "shared" and ("mono/web/src/lib", "mono/shared", "import") in edges
    assert edges["mono/web/src", "mono/web/src/lib", "import"]["label"] == "./lib/util"
    call = edges["mono/web/src", "mono/api", "http"]
    assert call["label"] == "port 8080" and call["port"] == 8080 and call["bidirectional"]
    assert ("mono/web", "mono/api", "http") in edges
    assert edges["apps/phone", "apps/backend", "http"]["label"] == "calls backend"
    assert edges["apps/phone-watch", "apps/phone", "import"]["label"] == "companion app"
    assert edges["repo:apps", "repo:mono", "http"]["port"] == 8080
    assert edges["apps/phone/__ui__/tab-bar", "apps/phone/__ui__/tab-home", "tab"]["label"] == "Home"
    assert ("apps/phone/__ui__/tab-home", "apps/phone/__ui__/detailview", "navigation") in edges


def test_screens(comps):
    assert comps["apps/phone"]["children"][0]["id"] == "apps/phone/__ui__/tab-bar"
    bar = comps["apps/phone/__ui__/tab-bar"]["children"]
    assert [(t["name"], t["description"]) for t in bar] == [("Home", "Entry: Home")] and [s["name"] for s in bar[0]["children"]] == ["Detail"]


def test_queries_on_an_analysis(merged):
    arch, made = merged
    c, e = arch.components, arch.relationships
    assert [r["id"] for r in views.breadcrumbs(c, "mono/web/src").collect()] == ["repo:mono", "mono/root", "mono/web", "mono/web/src"]
    top = {r["id"] for r in views.visible(c, e).collect()}
    assert {"mono/web", "apps/phone", "apps/phone-watch", "mono/api"} <= top and "mono/shared" not in top
    assert {r["id"] for r in views.files_of(c, arch.files, "mono/shared").select("path").withColumnRenamed("path", "id").collect()} == {"mono/shared/setup.py", "mono/shared/model.py", "mono/shared/view.py", "mono/shared/viewmodel.py"}
    assert {r["name"] for r in views.symbols_of(c, arch.files, arch.symbols, "mono/api").collect()} == {"Api", "items"}
    assert views.search(views.search_index(c, arch.files, arch.symbols), "web-app").first()["id"] == "mono/web"
    assert [r["key"] for r in views.doc_sections(c, "mono/root").collect()] == ["readme"]
    assert views.can_drill(c, "mono/web") and views.drill_up(c, "mono/web") == "mono/root"
    assert "mono/web" in {r["id"] for r in views.visible(c, e, "mono/root").collect()}
    others = {r["id"] for r in views.other_components(c, views.visible(c, e)).collect()}
    assert "mono/shared" not in top and "mono/root" in others
    assert [r["name"] for r in views.symbols_in_file(arch.files, arch.symbols, "mono/web/src/App.tsx").collect()] == ["App"]
    assert views.matching_files(arch.files, "BUTTON").count() == 1 and {r["kind"] for r in views.symbol_kinds(arch.symbols).collect()} >= {"class", "component", "struct"}
    assert views.documented(arch.symbols, 2).count() == 2 and views.hit(c, arch.files, arch.symbols, "file", "mono/api/main.py").count() == 1
    assert ("mono/web", "mono/api") in {(r["source"], r["target"]) for r in views.induced(e, views.visible(c, e)).collect()}
    json.dumps(made)
    assert "Components:" in export.summary(made)


def test_review(spark, merged):
    rows = [("1", "mono/api", "component", "mono/api", "", "Split\nit", None), ("2", "mono/api", "symbol", "mono/api/main.py:Api:6", "Api", "Rename", None), ("3", "mono/web", "file", "mono/web/src/App.tsx", "App.tsx", "Why", None)]
    text = export.review(merged[0], spark.createDataFrame(rows, views.ANNOTATION))
    for line in ("## 1. api-svc (api-server)", "> Split", "- Purpose: Serves items", "- Port: 8080", "## 2. File: App.tsx", "- Symbols: App", "## 3. Symbol: Api", "- Docstring: Serves.", "- Components reviewed: 2"):
        assert line in text.split("\n")
    assert export.review(merged[0], spark.createDataFrame([], views.ANNOTATION)) == ""


def test_one_tree_and_limits(spark, tmp_path):
    put(tmp_path / "one", {"package.json": '{"name": "x", "description": "d"}', "big.ts": "a" * 1000, "small.ts": "export class A {\n}\nfunction f() {}\n", "b.ts": "class B {}\n"})
    arch = analyze(spark, str(tmp_path / "one"), max_file_size=500, max_symbols=2)
    made = export.write_json(arch, str(tmp_path / "out" / "a.json"))
    assert {f["path"] for f in made["files"]} == {"package.json", "small.ts", "b.ts"}
    assert [s["name"] for s in made["symbols"]] == ["A", "B"] and made["stats"]["total_symbols"] == 3
    assert made["name"] == "one" and made["components"][0]["id"] == "root" and json.loads((tmp_path / "out" / "a.json").read_text())["stats"] == made["stats"]
    export.write_tables(arch, str(tmp_path / "tables"))
    assert export.read_tables(spark, str(tmp_path / "tables"))["files"].count() == 3


def test_bad_roots(spark, tmp_path):
    with pytest.raises(ValueError):
        tables(spark, {"x": str(tmp_path / "missing")})
    with pytest.raises(ValueError):
        read_tree(spark, {})
    bad = tmp_path / "c.json"
    for repos in ([], [{"name": "x", "path": "/nonexistent/path"}], [{"name": "x"}]):
        bad.write_text(json.dumps({"repositories": repos}))
        with pytest.raises(ValueError):
            multirepo.analyze_all(spark, str(bad))


def test_tree_reads_hidden_and_broken_names(spark, tmp_path):
    put(tmp_path, {"a/__tests__/_x.py": b"\xff\r\nok\rend", ".env.json": "{}", "a.framework/x.py": "x", ".hidden/x.py": "x", "q.txt": "t", "z.bin": b"0"})
    rows = {r["path"]: r for r in with_text(read_tree(spark, {"r": str(tmp_path)})).collect()}
    assert set(rows) == {"a", "a/__tests__", "a/__tests__/_x.py", ".env.json", "q.txt", "z.bin"}
    assert rows["a/__tests__/_x.py"]["content"] == "�\nok\nend" and rows["z.bin"]["content"] is None


def test_annotations(spark):
    log = spark.createDataFrame([("1", "c", "component", None, "", "a", None, 1), ("2", "c", "component", None, "", " b ", None, 2), ("3", "c", "file", "f", "", "x", None, 3), ("4", "c", "file", "g", "", "  ", None, 4)], views.ANNOTATION + ", seq long")
    now = views.current_annotations(log)
    assert {(r["targetType"], r["text"]) for r in now.collect()} == {("component", "b"), ("file", "x")}
    assert views.annotations_for(now, target_type="file").count() == 1 and views.deleted(now).count() == 0 and views.deleted(now, "3").count() == 1
    assert views.updated(now, "3", "new").where("id = '3'").first()["text"] == "new"


def test_formats(spark):
    row = spark.createDataFrame([(0, 1536, 10_000_000)], "a long, b long, c long").select(*[views.format_bytes(F.col(c)).alias(c) for c in "abc"], views.format_count(F.col("c")).alias("n")).first()
    assert tuple(row) == ("0 B", "1.5 KB", "9.5 MB", "10,000,000")
    ages = spark.sql("select timestamp'2024-01-10 00:00:00' as now, explode(array(timestamp'2024-01-09 23:59:30', timestamp'2024-01-09 23:30:00', timestamp'2024-01-09 20:00:00', timestamp'2024-01-07 00:00:00', timestamp'2023-12-01 00:00:00')) as t")
    assert [r[0] for r in ages.select(views.format_age(F.col("t"), F.col("now"))).collect()] == ["just now", "30m ago", "4h ago", "3d ago", "12/1/2023"]
    names = spark.createDataFrame([("React",), ("vue.js",), ("@x/tool",), ("none",)], "name string")
    table = spark.createDataFrame([("React", "r", "u"), ("vue", "v", "u"), ("tool", "t", "u")], "name string, description string, url string")
    assert {r["name"]: r["description"] for r in views.tech_reference(names, table).collect()} == {"React": "r", "vue.js": "v", "@x/tool": "t", "none": None}
    style = spark.createDataFrame([("http",), ("zzz",)], "k string").select(views.edge_style(F.col("k"))["color"]).collect()
    assert [r[0] for r in style] == ["#3B82F6", "#6B7280"]


def test_symbols_below_the_limit_keep_their_order(spark):
    rows = spark.createDataFrame([("r", "b", 0, "function", "public"), ("r", "a", 1, "class", "private"), ("r", "a", 0, "function", "public")], "repo string, file string, ordinal int, kind string, visibility string")
    assert [(r["file"], r["ordinal"]) for r in S.top_symbols(rows, 5).orderBy("rank").collect()] == [("a", 0), ("a", 1), ("b", 0)]
    assert [(r["file"], r["ordinal"]) for r in S.top_symbols(rows, 2).orderBy("rank").collect()] == [("a", 1), ("a", 0)]
