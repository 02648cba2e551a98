"""Queries on source text: parts are files, written in six languages from templates.

The operators read the text as they would read a file. The SQL writes the same text and
derives symbols, ends, comments, imports and routes from its lines: windows over lines and
braces, in place of the operators' walks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import values as V
from ..functions import text as T
from ..operators import symbols
from .registry import _joined, _read, query
from .written import dealt, quoted, text, text_sql

_COLUMNS = {"k": "p_partkey", "s": "p_size", "n": "p_name", "b": "p_brand"}

#: Texts of each language; a part has the one that its key's remainder chooses.
TEMPLATES = {
    "swift": [
        "// View{{k}}.swift\n// Shows {{n}}.\n//\n// Second part\nimport SwiftUI\n#if os(macOS)\nimport AppKit\n#endif\n\n/// {{n}}\n///  of size {{s}}\npublic final class Model{{k}} {\n    var x = {{s}}\n    func helper() { }\n        func deep() { }\n}\n\nextension Model{{k}} {\n    private func more() {\n        if true { print(\"a\") }\n    }\n}\n",
        "import Vapor\nimport Foundation.NSURL\n// Routes of {{n}}\n\n/** Block about {{n}}.\n * @par second {{s}}\n */\nstruct Api{{k}} {\n    let a = 1\n\nfunc routes(app: App) {\n    app.get(\"items/{{s}}\") { r in 1 }\n    app.post( \"items\") { r in 2 }\n    api.group(\"v{{s}}\") { }\n}\n",
        "import AppKit\nenum Kind{{s}} { case a }\nprotocol P{{k}} {\n}\nactor A{{k}}\n{\n  open func go() {\n  }\n}\n",
    ],
    "python": [
        '#!/usr/bin/env python\n# coding\n"""Module of {{n}}."""\nimport os.path\nfrom flask import Flask\n\n\nclass P{{k}}(Base):\n    """{{n}}"""\n\n    def inner(self):\n        return {{s}}\n# not deeper, but a comment\n    x = 1\n\n\n@app.get("/items/{{s}}")\nasync def _f{{s}}():\n    return 1\n@app.route(\'/all\')\ndef g():\n    return 2\n',
        'try:\n    import flask\nexcept ImportError:\n    flask = None\nimport click, sys\nfrom . import x\n\ndef first():\n\n    \'\'\'\n    Opens {{n}}\n\n      and closes {{s}}\'\'\'\n    if True:\n        pass\n\nclass _Q{{k}}:\n    pass\nrouter.add_post("/r{{s}}", h)\n',
        "\n\nx = 1\nclass Open{{k}}:\n    a = 1\n    b = 2\n",
    ],
    "rust": [
        "//! Crate of {{n}}.\n//! More.\n\nuse std::io;\nuse axum::{Router, routing::get};\nuse crate::x;\n\n/// {{n}}\npub struct S{{k}} {\n    a: u32,\n}\n\nimpl<T> S{{k}} {\n    pub fn new() -> Self { S{{k}} { a: {{s}} } }\n        fn deep() {}\n}\n\npub(crate) async fn serve() {\n    let app = Router::new().get(\"/s{{s}}\").post('/p');\n}\n",
        "// plain\n//! Inner {{n}}\nuse tokio::net::TcpListener;\n  use self::y;\n\n#[derive(Debug)]\nenum E{{s}} { A, B }\n\ntrait T{{k}} {\n    fn a(&self);\n    fn b(&self) {\n    }\n}\nunion U{{k}} { a: u8 }\n",
    ],
    "typescript": [
        "/**\n * Page of {{n}}.\n * Size {{s}}\n */\nimport React from 'react';\nimport { a } from '@scope/pkg/deep';\nimport './style.css';\n\n// not a doc\n/** Props of {{k}} */\nexport interface Props{{k}} {\n  a: string;\n}\n\nexport type Id{{k}} = string;\nexport default function Card{{s}}(p: Props) {\n  const t = \"{ not a brace\";\n  return '}' + p;\n}\n\nabstract class Store{{k}} {\n  run() { return { a: 1 }; }\n}\n",
        "'use client'\n// Serves {{n}}\n// eslint-disable\nconst express = require('express');\nconst fs = require('fs/promises')\n\nasync function main{{k}}() {\n  app.get('/items/{{s}}', h);\n  router.delete(\"/x\", h);\n}\nexport async function GET(r) {\n}\n     const nested = 1;\nexport const open{{s}} = () => {\n  return 1;\n",
    ],
    "go": [
        "// +build linux\n\n// Package p{{k}} holds {{n}}.\n// Second.\npackage p{{k}}\n\nimport (\n\t\"fmt\"\n\t\"net/http\"\n\t\"github.com/acme/x{{s}}\"\n)\n\ntype Server{{k}} struct {\n\ta int\n}\n\ntype handler interface {\n}\n\nfunc (s *Server{{k}}) Serve() {\n\thttp.HandleFunc(\"/s{{s}}\", h)\n\thttp.ListenAndServe(\":80\", nil)\n}\n\nfunc helper() {\n\tif true { x() }\n}\n",
        "// Lost\n\nx\npackage main\nimport \"github.com/gin-gonic/gin\"\nfunc Main() {\n\tr.GET(\"/a{{s}}\", h)\n\tr.Post('/b', h)\n",
    ],
    "ruby": [
        "require 'sinatra/base'\nrequire_relative 'lib/x{{s}}'\n\n# {{n}}\n# of size {{s}}\nmodule M{{k}}\n  class A::B{{k}} < Base\n    def self.make\n      if true\n        [1].each do |x|\n        end\n      end\n    end\n\n    # Asks\n    def ok?\n      while x\n      end\n    end\n  end\nend\nget '/items/{{s}}' do\nend\npost \"/p\"\n",
        "#!/usr/bin/env ruby\nclass App{{k}} < ActionController::Base\n  def index\n    case x\n    when 1 then 2\n    end\n  end\nend\ndef _hidden\n",
    ],
}


def _text(language: str) -> Column:
    """A part's text."""
    column, n = None, len(TEMPLATES[language])
    for i, template in enumerate(TEMPLATES[language]):
        same, own = F.col("p_partkey") % n == i, text(template, _COLUMNS)
        column = F.when(same, own) if column is None else column.when(same, own)
    return column


def _text_sql(language: str) -> str:
    cases = [f"when {i} then {text_sql(template, _COLUMNS)}" for i, template in enumerate(TEMPLATES[language])]
    return f"case p_partkey % {len(cases)} {' '.join(cases)} end"


def _files(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    parts = dealt(_read(spark, sf_dir, "part").select(*_COLUMNS.values()), "p_partkey")
    return parts.select(F.lit("all").alias("repo"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), F.lit(language).alias("language"), _text(language).alias("content"))


def _lines_sql(language: str) -> str:
    """f: files; l: their lines, numbered from 1, with the trimmed line."""
    return f"""f as (select 'p' || p_partkey as path, {_text_sql(language)} as content from part),
x as (select path, content, string_split(content, chr(10)) as ls from f),
l as (select path, line, n, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as bare from (select path, unnest(ls) as line, generate_subscripts(ls, 1) as n from x)),
t as (select path, max(n) as total from l group by path)"""


# --- symbols -------------------------------------------------------------------------------


def _found_sql(language: str) -> str:
    """s: the lines with a symbol: kind, name, shown name, visibility."""
    match, kind, name, vis, own, deep = [], [], [], [], [], []
    for i, (pattern, fixed) in enumerate(V.SYMBOLS[language]):
        p, groups = quoted(pattern), re.compile(pattern).groupindex
        group = lambda g, p=p, groups=groups: f"regexp_extract(line, {p}, {groups[g]})" if g in groups else "''"
        match.append(f"when regexp_matches(line, {p}) then {i}")
        kind.append(f"when {i} then " + (quoted(fixed) if fixed else group("kind")))
        name.append(f"when {i} then {group('name')}")
        vis.append(f"when {i} then {group('vis')}")
        own.append(f"when {i} then {group('own')}")
        deep.append(f"when {i} then length({group('indent')}) > {V.NESTED_INDENT}")
    shown = "case when own <> '' then 'self.' || name else name end"
    visible = {
        "swift": "case when kind = 'extension' then 'internal' else coalesce(nullif(vis, ''), 'internal') end",
        "typescript": "case when vis <> '' then 'public' else 'internal' end",
        "rust": "case when kind = 'impl' then 'internal' when vis <> '' then 'public' else 'private' end",
        "go": "case when regexp_matches(name, '^[A-Z]') then 'public' else 'private' end",
        "ruby": f"case when kind in ('class', 'module') then 'public' when {shown} like '\\_%' escape '\\' then 'private' else 'public' end",
        "python": "case when name like '\\_%' escape '\\' then 'private' else 'public' end",
    }[language]
    real_kind = "case when kind = 'function' and react and regexp_matches(name, '^[A-Z]') then 'component' else kind end" if language == "typescript" else "kind"
    at = lambda cases: "case j " + " ".join(cases) + " end"
    return f"""m as (select l.*, case {' '.join(match)} end as j, contains(left(x.content, 500), 'React') as react from l join x on x.path = l.path),
g as (select *, {at(kind)} as kind, {at(name)} as name, {at(vis)} as vis, {at(own)} as own, {at(deep)} as deep from m where j is not null),
s as (select path, n, line, {real_kind} as kind, name, {shown} as shown, {visible} as visibility from g where not deep)"""


def _ends_sql(language: str) -> str:
    """e: (path, n, end_line) of the symbols, by running depths."""
    fallback = f"least(s.n + {V.BLOCK_FALLBACK}, t.total)"
    if language == "python":
        return f"""d as (select path, n, length(line) - length(ltrim(line)) as depth from l where bare <> '' and bare not like '#%'),
e as (select s.path, s.n, coalesce((select min(d.n) - 1 from d where d.path = s.path and d.n > s.n and d.depth <= length(s.line) - length(ltrim(s.line))), {fallback}) as end_line from s join t on t.path = s.path)"""
    if language == "ruby":
        return f"""d as (select path, n, bare = 'end' or bare like 'end %' or bare like 'end;%' as closes, sum(case when regexp_matches(line, {quoted(V.RUBY_BLOCK)}) or bare like '% do' then 1 else 0 end - case when bare = 'end' or bare like 'end %' or bare like 'end;%' then 1 else 0 end) over (partition by path order by n) as depth from l),
e as (select s.path, s.n, coalesce((select min(d.n) from d where d.path = s.path and d.n >= s.n and d.closes and d.depth = coalesce(b.depth, 0)), {fallback}) as end_line from s join t on t.path = s.path left join d b on b.path = s.path and b.n = s.n - 1)"""
    code = "regexp_replace(regexp_replace(line, '[\"''`][^\"''`]*[\"''`]', '', 'g'), '[\"''`].*$', '')" if language == "typescript" else "line"
    return f"""c as (select path, n, unnest(regexp_extract_all({code}, '[{{}}]')) as c, generate_subscripts(regexp_extract_all({code}, '[{{}}]'), 1) as k from l),
d as (select path, n, c, sum(case c when '{{' then 1 else -1 end) over (partition by path order by n, k) as depth, row_number() over (partition by path order by n, k) as r from c),
h as (select s.path, s.n, coalesce((select arg_max(d.depth, d.r) from d where d.path = s.path and d.n < s.n), 0) as base from s),
e as (select s.path, s.n, case when s.kind = 'type' then s.n else coalesce((select min(d.n) from d where d.path = s.path and d.n >= s.n and d.c = '}}' and d.depth = h.base), {fallback}) end as end_line from s join h on h.path = s.path and h.n = s.n join t on t.path = s.path)"""


def _comments_sql(language: str) -> str:
    """q: (path, n, docstring) of the symbols."""
    if language == "go":
        return "q as (select path, n, cast(null as varchar) as docstring from s)"
    if language == "python":
        return """o as (select s.path, s.n, (select min(l.n) from l where l.path = s.path and l.n > s.n and l.n < s.n + 5 and l.bare <> '') as first from s),
w as (select o.path, o.n, o.first, l.bare, left(l.bare, 3) as quote from o join l on l.path = o.path and l.n = o.first where left(l.bare, 3) in ('\"\"\"', '''''''')),
z as (select w.*, (select min(l.n) from l where l.path = w.path and l.n > w.first and contains(l.line, w.quote)) as last from w),
q as (select path, n, case when length(bare) > 6 and ends_with(bare, quote) then trim(substr(bare, 4, length(bare) - 6))
  else (select string_agg(y, chr(10) order by k) from (select l.n as k, regexp_replace(replace(case when l.n = z.first then substr(z.bare, 4) else l.line end, z.quote, ''), '^\\s+|\\s+$', '', 'g') as y from l where l.path = z.path and l.n between z.first and coalesce(z.last, z.first + 29)) where y <> '') end as docstring from z)"""
    return r"""cm as (select path, n, bare, case when bare like '///%' then 1 when bare like '#%' and bare not like '#!%' then 2 else 0 end as mark from l),
cr as (select *, n - row_number() over (partition by path, mark order by n) as run from cm),
up as (select s.path, s.n, c.bare, c.mark, c.run, (select max(l.n) from l where l.path = s.path and l.n < s.n and contains(l.line, '/*')) as opened from s join cr c on c.path = s.path and c.n = s.n - 1),
q as (select path, n, case when ends_with(bare, '*/') then
    (select string_agg(y, chr(10) order by k) from (select l.n as k, regexp_replace(regexp_replace(regexp_replace(l.bare, '^/\*\*?\s?', ''), '\s?\*/$', ''), '^\*\s?', '') as y from l where l.path = up.path and l.n between up.opened and up.n - 1) where y <> '')
  when mark > 0 then (select string_agg(trim(ltrim(ltrim(c.bare, case up.mark when 1 then '/' else '#' end))), chr(10) order by c.n) from cr c where c.path = up.path and c.mark = up.mark and c.run = up.run and c.n < up.n) end as docstring from up)"""


def _symbols_sql(language: str) -> str:
    count = f"case when s.kind = 'type' then {V.TYPE_PREVIEW_LINES} else {V.PREVIEW_LINES} end"
    mark = "case s.kind when 'extension' then 'ext_' when 'impl' then 'impl_' else '' end"
    return f"""with {_lines_sql(language)}, {_found_sql(language)}, {_ends_sql(language)}, {_comments_sql(language)},
v as (select s.path, s.n, string_agg(l.line, chr(10) order by l.n) as shown from s join l on l.path = s.path and l.n >= s.n and l.n < s.n + {count} group by s.path, s.n)
select s.path || ':' || {mark} || s.shown || ':' || s.n as id, case when {mark} <> '' then s.kind || ' ' || s.name else s.shown end as name, s.kind, cast(s.n as bigint) as line, cast(e.end_line as bigint) as end_line, s.visibility, q.docstring,
  md5(v.shown || case when s.n + {count} - 1 < t.total and not regexp_matches(v.shown, '}}\\s*$') then chr(10) || '    ...' else '' end) as preview
from s join e on e.path = s.path and e.n = s.n join v on v.path = s.path and v.n = s.n join t on t.path = s.path left join q on q.path = s.path and q.n = s.n"""


def _symbols_query(language: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = symbols.symbol_table(symbols.parsed(_files(spark, sf_dir, language)))
        return rows.select("id", "name", "kind", "line", "end_line", "visibility", "docstring", F.md5(F.col("code_preview").cast("binary")).alias("preview"))

    run.__name__, run.__doc__ = f"symbols_{language}", f"Symbols of {language} text: kinds, ends of their blocks, visibility, documentation and previews."
    query(_symbols_sql(language))(run)


# --- what files hold --------------------------------------------------------------------------


def _all(pattern: str, group: int, flags: str = "") -> str:
    return f"regexp_extract_all(content, {quoted((f'(?{flags})' if flags else '') + pattern)}, {group})"


def _sorted(values: str) -> str:
    return f"array_to_string(list_sort(list_distinct({values})), ',')"


_PYTHON = V.IMPORTS["python"]
_PACKAGE = "lambda m: case when starts_with(m, '.') then m when starts_with(m, '@') and contains(m, '/') then array_to_string(list_slice(string_split(m, '/'), 1, 2), '/') else split_part(m, '/', 1) end"
_IMPORTS_SQL = {
    "swift": f"array_to_string({_all(V.IMPORTS['swift'], 1, 'm')}, ',')",
    "python": _sorted(f"list_transform(list_filter(list_transform(list_zip({_all(_PYTHON, 1, 'm')}, {_all(_PYTHON, 2, 'm')}), lambda z: case when z[1] <> '' then z[1] else z[2] end), lambda m: m <> ''), lambda m: split_part(m, '.', 1))"),
    "rust": _sorted(f"list_filter(list_transform({_all(V.IMPORTS['rust'], 1, 'm')}, lambda m: split_part(m, '::', 1)), lambda m: m not in ('self', 'super', 'crate'))"),
    "typescript": _sorted(f"list_concat(list_transform({_all(V.IMPORTS['typescript'], 1, 'm')}, {_PACKAGE}), list_transform({_all(V.IMPORTS['require'], 1)}, lambda m: split_part(m, '/', 1)))"),
    "go": _sorted(f"list_transform({_all(V.IMPORTS['go'], 1)}, lambda m: regexp_extract(m, '[^/]*$'))"),
    "ruby": _sorted(f"list_transform(list_concat({_all(V.IMPORTS['ruby'], 1)}, {_all(V.IMPORTS['ruby_relative'], 1)}), lambda m: split_part(m, '/', 1))"),
}


def _cases(rules: list[tuple[str, str]]) -> str:
    return "case " + " ".join(f"when {c} then {quoted(v)}" for c, v in rules) + " end"


def _has(word: str) -> str:
    return f"contains(content, {quoted(word)})"


#: AppKit outside #if ... #endif, flask outside try ... except: the guarded part is taken out first.
_UNGUARDED = "contains(regexp_replace(content, '(?s)#if .*?#endif', '', 'g'), 'import AppKit')"
_PLAIN = "regexp_replace(content, '(?s)try:.*?except', '', 'g')"
_FRAMEWORK_SQL = {
    "swift": _cases([(_has("import Vapor"), "Vapor"), (_UNGUARDED, "AppKit"), (_has("import UIKit"), "UIKit"), (_has("import SwiftUI"), "SwiftUI")]),
    "python": _cases([(f"contains({_PLAIN}, {quoted('import ' + k)}) or contains({_PLAIN}, {quoted('from ' + k)})", name) for k, name in V.FRAMEWORKS["python"]]),
    "rust": _cases([(_has(k), name) for k, name in V.FRAMEWORKS["rust"]]),
    "typescript": _cases([(_has("'" + k) + " or " + _has('"' + k), name) for k, name in V.FRAMEWORKS["typescript"]]),
    "go": _cases([*[(_has(k), name) for k, name in V.FRAMEWORKS["go"]], (_has('"net/http"') + " and (" + " or ".join(map(_has, V.GO_SERVER_TOKENS)) + ")", "net/http")]),
    "ruby": _cases([(_has(k), name) for k, name in V.FRAMEWORKS["ruby"]]),
}


def _endpoints_sql(language: str) -> str:
    out = []
    if language == "ruby":  # each route by the verb that stands before it in its line, else GET; then by its own
        before = "list_transform(regexp_extract_all(content, '(?m)^([^\\n]*?)(?:get|post|put|patch|delete)\\s+[\"''][^\"'']+', 1), lambda b: case when contains(lower(b), 'post') then 'POST' when contains(lower(b), 'put') then 'PUT' when contains(lower(b), 'patch') then 'PATCH' when contains(lower(b), 'delete') then 'DELETE' else 'GET' end)"
        out.append(f"list_transform(list_zip({before}, {_all(V.ENDPOINTS['ruby'][0][0], 2)}), lambda z: z[1] || ' ' || z[2])")
    for pattern, method, path in V.ENDPOINTS[language]:
        if isinstance(method, int) and isinstance(path, int):
            out.append(f"list_transform(list_zip({_all(pattern, method)}, {_all(pattern, path)}), lambda z: upper(z[1]) || ' ' || z[2])")
        elif isinstance(method, int):
            out.append(f"list_transform({_all(pattern, method)}, lambda m: upper(m) || ' {path}')")
        else:
            out.append(f"list_transform({_all(pattern, path)}, lambda p: '{method} ' || p)")
    joined = out[0]
    for x in out[1:]:
        joined = f"list_concat({joined}, {x})"
    return f"array_to_string({joined}, ',')"


_BARE = "list_transform(string_split(content, chr(10)), lambda z: regexp_replace(z, '^\\s+|\\s+$', '', 'g'))"
_DOC_SQL = {
    # After imports, blank lines and the file's name: the first run of comment lines.
    "swift": "nullif(array_to_string(list_filter(list_transform(string_split(regexp_extract(content, '(?:\\A|\\n)((?://[ \\t]*\\w+\\.swift\\n)?(?://[^\\n]*\\n)+)', 1), chr(10)), lambda z: trim(ltrim(z, '/'))), lambda z: z <> '' and not regexp_matches(z, '^\\w+\\.swift$')), chr(10)), '')",
    "python": "nullif(trim(regexp_extract(content, '(?s)\\A(?:#[^\\n]*\\n)*\"\"\"(.*?)\"\"\"', 1)), '')",
    "rust": f"nullif(array_to_string(list_transform(list_filter({_BARE.replace('content', quoted('') + ' || regexp_extract(content, ' + quoted(chr(92) + 'A(?:(?://[^' + chr(92) + 'n]*)?' + chr(92) + 'n)*') + ')')}, lambda z: starts_with(z, '//!')), lambda z: trim(substr(z, 4))), chr(10)), '')",
    "typescript": "nullif(array_to_string(list_filter(list_transform(string_split(case when starts_with(content, '/**') then regexp_extract(content, '(?s)\\A/\\*\\*(.*?)\\*/', 1) else regexp_extract(content, '\\A(?:''use [^\\n]*\\n)?((?://[^/][^\\n]*\\n)*)', 1) end, chr(10)), lambda z: trim(regexp_replace(trim(z), '^(\\*|//)\\s?', ''))), lambda z: z <> '' and not starts_with(z, 'eslint') and not starts_with(z, '@ts-')), chr(10)), '')",
    "go": "nullif(array_to_string(list_filter(list_transform(string_split(regexp_extract(content, '((?://[^\\n]*\\n)+)package ', 1), chr(10)), lambda z: trim(substr(z, 3))), lambda z: z <> '' and not starts_with(z, '+build')), chr(10)), '')",
    "ruby": "cast(null as varchar)",
}


def _facts_query(language: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = _files(spark, sf_dir, language)
        lang, content = F.col("language"), F.col("content")
        routes = F.array_join(F.transform(T.endpoints(lang, content), lambda e: F.concat_ws(" ", e["method"], e["path"])), ",")
        facts = files.select("path", "language", "content", _joined(T.imports(lang, content)).alias("imports"), T.framework(lang, content).alias("framework"), routes.alias("endpoints"))
        return symbols.with_module_doc(facts).drop("language")

    run.__name__, run.__doc__ = f"facts_{language}", f"Imports, framework, routes and head comment of {language} text."
    sql = f"with {_lines_sql(language)} select path, {_IMPORTS_SQL[language]} as imports, {_FRAMEWORK_SQL[language]} as framework, {_endpoints_sql(language)} as endpoints, {_DOC_SQL[language]} as module_doc from f"
    query(sql)(run)


for _language in TEMPLATES:
    _symbols_query(_language)
    _facts_query(_language)
