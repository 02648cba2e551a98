"""Functions on the text of files: what is found, and where blocks end."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from archspark import values as V
from archspark.functions import text as T
from archspark.functions.blocks import Braces, Ends, Indents, brace_body
from archspark.operators import docs, symbols, uiflow
from archspark.operators.roles import script_name
from archspark.sources import configs


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return row.select(column.alias("r")).first()["r"]


def on(spark, function, text):
    return one(spark, function(F.col("t")), t=text)


# --- found by patterns ------------------------------------------------------------------

IMPORTS = [
    ("python", "import os.path\nfrom flask import Flask\n  import os\nfrom .x import y\n", ["", "flask", "os"]),
    ("typescript", "import React from 'react';\nimport { a } from '@scope/pkg/deep';\nimport './style.css';\nconst f = require('fs/promises');\nrequire('@s/p')", ["./style.css", "@s", "@scope/pkg", "fs", "react"]),
    ("javascript", "import x from \"lodash/get\"", ["lodash"]),
    ("swift", "import SwiftUI\nimport Foundation.NSURL\nimport SwiftUI\n", ["SwiftUI", "Foundation.NSURL", "SwiftUI"]),
    ("go", 'import (\n"fmt"\n"net/http"\n)\nx := "a b"', ["fmt", "http"]),
    ("rust", "use std::io;\nuse crate::x;\n  use tokio::net;\nuse self::y;", ["std", "tokio"]),
    ("ruby", "require 'sinatra/base'\nrequire_relative 'lib/x'\nrequire \"json\"", ["json", "lib", "sinatra"]),
    ("java", "import java.util.List;", []),
]


@pytest.mark.parametrize("lang, text, want", IMPORTS)
def test_imports(spark, lang, text, want):
    assert one(spark, T.imports(F.col("l"), F.col("t")), l=lang, t=text) == want


FRAMEWORKS = [
    ("python", "from flask import Flask", "Flask"), ("python", "from django.db import models", "Django"), ("python", "try:\n    import flask\nexcept ImportError:\n    pass\nimport click", "Click"),
    ("python", "try:\n    import flask\nexcept ImportError:\n    x = 1\nimport flask", "Flask"), ("typescript", "import React from 'react'", "React"), ("javascript", 'require("express")', "Express"),
    ("typescript", "import next from 'next/app'; import 'react'", "Next.js"), ("swift", "#if os(macOS)\nimport AppKit\n#endif\nimport SwiftUI", "SwiftUI"), ("swift", "import AppKit", "AppKit"), ("swift", "import Vapor", "Vapor"),
    ("go", 'import "net/http"\nhttp.Get(x)', None), ("go", 'import "net/http"\nhttp.ListenAndServe(x)', "net/http"), ("go", '"github.com/gin-gonic/gin"', "Gin"), ("rust", "use axum::Router;\nuse tokio::net;", "Axum"),
    ("ruby", "class A < ActionController::Base", "Rails"), ("ruby", "Sinatra::Base", "Sinatra"), ("c", "import flask", None),
]


@pytest.mark.parametrize("lang, text, want", FRAMEWORKS)
def test_frameworks(spark, lang, text, want):
    assert one(spark, T.framework(F.col("l"), F.col("t")), l=lang, t=text) == want


ENDPOINTS = [
    ("python", "@app.get('/a')\n@bp.route(\"/b\")\nrouter.add_post('/c', h)\nweb.put('/d')", ["GET /a", "ROUTE /b", "POST /c", "PUT /d"]),
    ("typescript", "app.get('/a', h)\nexport async function POST(req) {}", ["GET /a", "POST (file-based)"]),
    ("swift", 'app.get("a") { }\nroutes.group("api") { }', ["GET a", "GROUP api"]),
    ("go", 'r.GET("/a", h)\nr.Post("/b", h)\nhttp.HandleFunc("/c", h)', ["GET /a", "POST /b", "ANY /c", "ANY /c"]),
    ("rust", 'x.get("/a")', ["GET /a"]),
    ("ruby", "get '/a'\n  post '/b'; put '/c'\nx", ["GET /a", "GET /b", "POST /c", "GET /a", "POST /b", "PUT /c"]),
]


@pytest.mark.parametrize("lang, text, want", ENDPOINTS)
def test_endpoints(spark, lang, text, want):
    got = one(spark, T.endpoints(F.col("l"), F.col("t")), l=lang, t=text)
    assert [f"{e['method']} {e['path']}" for e in got] == want


def test_ports_and_variables(spark):
    text = "app.listen(3000)\nserver.listen( 80 )\nPORT = 8766\n  PORT = 8767\nuvicorn.run(app, port=8080)\nbind('0.0.0.0:9000')\nx.get('MY_PORT', '7001')\nDB_PORT: 5432\nAPI_PORT=99999\nlocalhost:4000"
    assert on(spark, T.ports, text) == [3000, 7001, 8080, 8766, 9000]
    assert on(spark, T.env_vars, "os.environ[\"A\"] getenv('B') process.env.C env::var(\"D\") environ.get('E') process.env.A") == ["A", "B", "C", "D"]
    assert sorted(on(spark, T.referred_ports, "localhost:8080 127.0.0.1:81x 'http://h:9090/a:7:8' port = 5000; PORT: 6000")) == [7, 8, 5000, 6000, 8080, 9090]


def test_paths(spark):
    assert on(spark, T.ancestors, "a/b/c.py") == ["", "a", "a/b"] and on(spark, T.ancestors, "c.py") == [""]
    for name, want in [("a.PY", ".py"), (".env", ""), (".env.json", ".json"), ("x.", ""), ("a.tar.gz", ".gz"), ("Makefile", "")]:
        assert on(spark, T.suffix, name) == want
    for start, rel, want in [("src/a", "./b", "src/a/b"), ("src/a", "../../lib", "lib"), ("", "./x", "x"), ("a", "../../x", "x"), ("a", "..", "")]:
        assert one(spark, T.folded(F.col("d"), F.col("r")), d=start, r=rel) == want
    assert on(spark, T.component_id, "My App/Sub") == "my-app/sub" and on(spark, T.component_id, "") == "root"
    assert on(spark, T.titled, "o'neil log2x a-b") == "O'Neil Log2X A-B"
    assert on(spark, T.spaced, "MyGreatApp") == "My Great App"


def test_quoted_patterns(spark):
    assert one(spark, F.rlike(F.col("t"), T.quoted(F.col("q"))), t="x a.b(\\E)+ y", q="a.b(\\E)+") and not one(spark, F.rlike(F.col("t"), T.quoted(F.col("q"))), t="axb", q="a.b")


# --- blocks ---------------------------------------------------------------------------------


def walked_end(lines, start, quotes):
    """Character by character."""
    depth = 0
    for i in range(start, min(start + 500, len(lines))):
        inside = False
        for k, ch in enumerate(lines[i]):
            if quotes and ch in "\"'`" and (k == 0 or lines[i][k - 1] != "\\"):
                inside = not inside
            if not inside and ch in "{}":
                depth += 1 if ch == "{" else -1
                if ch == "}" and depth == 0:
                    return i
    return min(start + 10, len(lines) - 1)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="{}\n\"'\\a", max_size=60), st.booleans())
def test_braces(text, quotes):
    lines = text.split("\n")
    b = Braces(text, quotes)
    assert [b.end(i) for i in range(len(lines))] == [walked_end(lines, i, quotes) for i in range(len(lines))]


def test_long_blocks():
    text = "f {\n" + "x\n" * 498 + "}\n"
    assert Braces(text).end(0) == 499
    assert Braces("f {\n" + "x\n" * 499 + "}\n").end(0) == 10


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["def a:", "  x", "    y", "", "# c", "  # d", "z"]), min_size=1, max_size=20))
def test_indents(lines):
    for start in range(len(lines)):
        base = len(lines[start]) - len(lines[start].lstrip())
        after = [i for i in range(start + 1, len(lines)) if lines[i].strip() and not lines[i].strip().startswith("#") and len(lines[i]) - len(lines[i].lstrip()) <= base]
        assert Indents(lines).end(start) == (after[0] - 1 if after else min(start + 10, len(lines) - 1))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["def a", "  if x", "end", "  end", "y do", "z", "end; q"]), min_size=1, max_size=20))
def test_ends(lines):
    for start in range(len(lines)):
        depth, want = 0, min(start + 10, len(lines) - 1)
        for i in range(start, len(lines)):
            depth += bool(re.match(V.RUBY_BLOCK, lines[i])) or lines[i].strip().endswith(" do")
            if lines[i].strip() == "end" or lines[i].strip().startswith(("end ", "end;")):
                depth -= 1
                if depth == 0:
                    want = i
                    break
        assert Ends(lines).end(start) == want


def test_brace_body():
    assert brace_body("a {b{c}d} e", 0) == "{b{c}d}" and brace_body("a {b", 0) == "{b" and brace_body("none", 0) == ""


# --- symbols -----------------------------------------------------------------------------------


def found(lang, text, path="f"):
    return [(s["name"], s["kind"], s["line"], s["end_line"], s["visibility"], s["docstring"]) for s in symbols.symbols(lang, path, text)]


def test_python_symbols():
    text = 'class A(B):\n    """Doc."""\n    def m(self):\n        pass\n\n\nasync def _f():\n\n    \'\'\'Long\n    more\n    \'\'\'\n    return 1\nx = 1\n'
    assert found("python", text) == [("A", "class", 1, 6, "public", "Doc."), ("_f", "function", 7, 12, "private", "Long\nmore")]
    assert symbols.symbols("python", "d/a.py", text)[0]["id"] == "d/a.py:A:1"
    assert symbols.symbols("python", "a", text)[0]["code_preview"].endswith("\n    ...")


def test_typescript_symbols():
    text = "/**\n * Shown.\n */\nexport class A {\n  x = '}';\n}\ninterface I {}\nexport type T = string;\nconst Button = () => {\n}\nexport default function main() {}\n"
    want = [("A", "class", 4, 6, "public", "Shown."), ("I", "interface", 7, 7, "internal", None), ("T", "type", 8, 8, "public", None), ("Button", "component", 9, 10, "internal", None), ("main", "function", 11, 11, "public", None)]
    assert found("typescript", text, "a.tsx") == want
    assert found("javascript", text, "a.js")[3][1] == "function"


def test_swift_symbols():
    text = "/// Says.\npublic struct A: View {\n    private func f() {\n    }\n          func deep() {}\n}\nextension A {\n}\nactor B {}\n"
    assert found("swift", text) == [("A", "struct", 2, 6, "public", "Says."), ("f", "function", 3, 4, "private", None), ("extension A", "extension", 7, 8, "internal", None), ("B", "actor", 9, 9, "internal", None)]
    assert [s["id"] for s in symbols.symbols("swift", "a", text)] == ["a:A:2", "a:f:3", "a:ext_A:7", "a:B:9"]


def test_rust_go_ruby_symbols():
    rust = "/// Doc\npub(crate) struct A {\n}\nimpl<T> A {\n    pub async fn f() {\n    }\n}\nenum E {}\n"
    assert found("rust", rust) == [("A", "struct", 2, 3, "public", "Doc"), ("impl A", "impl", 4, 7, "internal", None), ("f", "function", 5, 6, "public", None), ("E", "enum", 8, 8, "private", None)]
    go = "// no doc\ntype S struct {\n}\nfunc (s *S) Do() {\n}\nfunc low() {}\n"
    assert found("go", go) == [("S", "struct", 2, 3, "public", None), ("Do", "function", 4, 5, "public", None), ("low", "function", 6, 6, "private", None)]
    ruby = "# Doc\n# more\nclass A::B\n  def self.x?\n    if y\n    end\n  end\n  def _z\n  end\nend\n"
    assert found("ruby", ruby) == [("A::B", "class", 3, 10, "public", "Doc\nmore"), ("self.x?", "function", 4, 7, "public", None), ("_z", "function", 8, 9, "private", None)]
    assert symbols.symbols("java", "a", "class A {}") == []


FILE_DOCS = [
    ("python", "#!/x\n\n\"\"\"Module.\"\"\"\nimport x", "Module."), ("python", "import x\n\"\"\"No\"\"\"", None), ("swift", "//\n//  App.swift\n//  Says it\n\nimport X\n// no", "Says it"), ("rust", "// c\n//! One\n\n//! Two\nuse x;\n//! no", "One\nTwo"),
    ("go", "// +build x\n// Package a\n// does.\npackage a", "Package a\ndoes."), ("go", "// old\n\nx\n// New\npackage a", "New"), ("typescript", "'use client'\n/** Top.\n * more\n */\nimport x", "Top.\nmore"), ("javascript", "// eslint-disable\n// Head\n\n// no", "Head"),
    ("ruby", "# none", None),
]


@pytest.mark.parametrize("lang, text, want", FILE_DOCS)
def test_file_docs(lang, text, want):
    assert symbols.file_doc(lang, text) == want


# --- configuration ------------------------------------------------------------------------------


def test_packages(spark):
    p = on(spark, configs.package_json, '{"name": "web", "description": "d", "dependencies": {"react": "1", "a": "2"}, "devDependencies": {"jest": "1", "a": "3"}, "scripts": {"x": "y"}}')
    assert (p["ok"], p["name"], p["description"], p["dependencies"], p["scripts"]) == (True, "web", "d", ["a", "jest", "react"], ["x"])
    assert on(spark, configs.package_json, "{broken")["ok"] is False
    c = on(spark, configs.cargo_toml, '[package]\nedition = "2021"\nname = "srv"\n\n[dependencies]\naxum = "0.7"\ntokio = { version = "1" }\n[dev-dependencies]\nrand="1"\n[profile]\nx = 1\n')
    assert (c["name"], c["dependencies"]) == ("srv", ["axum", "tokio", "rand"])
    t = on(spark, configs.pyproject_toml, '[project]\nname = "svc"\ndependencies = ["flask>=2", "python", "httpx"]\n')
    assert t["name"] == "svc" and t["dependencies"] == ["flask"]
    assert on(spark, configs.gemfile, "gem 'rails'\ngem \"pg\"\ngem 'rails'") == ["pg", "rails"]


def test_services(spark):
    d = on(spark, configs.docker_compose, "version: '3'\nservices:\n  api:\n    ports:\n      - \"8080:80\"\n      - 9090:90\n    image: x\n  db-1:\n    ports:\n      - 5432:5432\nvolumes:\n  v:\n")
    assert d["services"] == ["api", "db-1"] and [tuple(p) for p in d["ports"]] == [("api", 8080, 80), ("api", 9090, 90), ("db-1", 5432, 5432)]
    s = on(spark, configs.sam_template, "Resources:\n  Fn:\n    Type: AWS::Serverless::Function\n    Properties:\n      Handler: a.b\n      Runtime: python3.12\n      CodeUri: src/\n  Bucket:\n    Type: AWS::S3::Bucket\n  Two:\n    Type: AWS::Serverless::Function\nOutputs:\n  X:\n    Value: AWS::Serverless::Api\n")
    assert [tuple(f) for f in s["functions"]] == [("Fn", "python3.12", "a.b", "src/"), ("Two", "", "", "")] and s["has_api_gateway"] and s["type"] == "sam"
    v = on(spark, configs.serverless_yml, "provider:\n  name: aws\nfunctions:\n  one:\n    handler: x\n  two:\n    handler: y\nresources:\n  three:\n")
    assert [f["name"] for f in v["functions"]] == ["one", "two"] and v["provider"] == "aws"


def test_summaries_and_names(spark):
    s = on(spark, docs.summary, "intro\n\n## Title here\n\nA\nB\n\nC")
    assert (s["heading"], s["text"]) == ("Title here", "A B")
    assert on(spark, docs.summary, "# T\na\nb\nc\nd")["text"] == "a b c"
    name = lambda path, text: one(spark, script_name(F.col("p"), F.col("t")), p=path, t=text)
    assert name("x/log_server.py", "import x") == "Log Server"
    assert name("a.py", '"""Remote Log Server with Web Interface\n\nmore"""') == "Remote Log Server"
    assert name("a.py", '#!x\n"""An exceedingly long description of things"""') == "An exceedingly long"


# --- screens ----------------------------------------------------------------------------------------


def test_tabs_and_targets():
    text = 'struct Main: View { var body: some View { TabView { HomeView().tabItem { Label("Home", systemImage: "x") } MoreView(a: 1).tabItem { Text("t") } } } }'
    assert uiflow.tabs_of(text) == [("Home", "HomeView"), ("Tab 2", "MoreView")]
    body = '{ NavigationLink { DetailView() } label: {} NavigationLink(destination: EditScreen(x)) .sheet(isPresented: $a) { InfoSheet() } .fullScreenCover(item: $b) { BigView() } RowView(1) }'
    assert uiflow.targets_of(body, "RowView")[:4] == [("DetailView", "push"), ("EditScreen", "push"), ("InfoSheet", "sheet"), ("BigView", "fullscreen")]
