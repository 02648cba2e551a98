"""Queries on source trees: suppliers are directories, customers are components.

Files are written from templates; the SQL has the same files and derives from them what
the operators find: foreign projects, marker and module components, roles, documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import values as V
from ..functions import text as T
from ..operators import components as C
from ..operators import docs, roles
from ..sources.storage import cut
from .registry import _joined, _read, query
from .written import choice, choice_sql, quoted, text, text_sql

_COLUMNS = {"k": "s_suppkey", "n": "s_nationkey"}

#: (modulus, remainders, path, content): suppliers whose key has such a remainder have the file.
FILES = [
    (8, (0,), "d{{k}}/package.json", '{"name": "@n{{n}}/app{{k}}", "description": "Does {{k}}", "dependencies": {"react": "1"}}'),
    (8, (0, 7), "d{{k}}/Dockerfile", "FROM x"),
    (8, (1,), "d{{k}}/Cargo.toml", '[package]\nversion = "1"\nname = "crate{{k}}"\n\n[dependencies]\nclap = "4"\n'),
    (8, (2,), "d{{k}}/pyproject.toml", '[project]\nname = "py{{k}}"\ndescription = "Python {{k}}"\n'),
    (8, (3,), "d{{k}}/Gemfile", "gem 'rails'\n"),
    (8, (3,), "d{{k}}/config/application.rb", "module BigShop{{k}}\n  class Application\n  end\nend\n"),
    (8, (4,), "d{{k}}/docker-compose.yml", "version: '3'\nservices:\n  web{{k}}:\n    ports:\n      - '90{{n}}:80'\n  db:\n    image: y\nvolumes:\n  v:\n"),
    (16, (5,), "d{{k}}/template.yaml", "Resources:\n  One{{k}}:\n    Type: AWS::Serverless::Function\n    Properties:\n      Runtime: python3.12\n  Table:\n    Type: AWS::DynamoDB::Table\n"),
    (16, (13,), "d{{k}}/template.yaml", "Resources:\n  One{{k}}:\n    Type: AWS::Serverless::Function\n  Two:\n    Type: AWS::Lambda::Function\n"),
    (8, (6,), "d{{k}}/serverless.yml", "service: s\nprovider:\n  name: aws\nfunctions:\n  hello{{k}}:\n    handler: h\n  bye:\n    handler: b\nplugins:\n  x:\n"),
    (8, (7,), "d{{k}}/Info.plist", '<?xml version="1.0"?><plist version="1.0"><dict><key>CFBundleName</key><string>Plist {{k}}</string></dict></plist>'),
    (3, (0, 1), "d{{k}}/src/a.py", "x = 1\n"),
    (3, (0,), "d{{k}}/src/b.py", "x = 2\n"),
    (5, (0,), "d{{k}}/one/two/three/four/five/a.go", "package a\n"),
    (5, (0,), "d{{k}}/one/two/three/four/five/b.go", "package a\n"),
    (7, (2, 3), "d{{k}}/third/Makefile", "all:\n"),
    (7, (2,), "d{{k}}/third/LICENSE", "Free"),
    *[(7, (2, 3), f"d{{{{k}}}}/third/{x}/x.c", "int a;\n") for x in "abcde"],
    (7, (2,), "d{{k}}/third/a/y.c", "int b;\n"),
    (7, (2,), "d{{k}}/third/a/package.json", '{"name": "inner"}'),
    (4, (0,), "d{{k}}/README.md", "# Head {{k}}\n\nFirst line of {{k}}.\n"),
    (4, (0, 1), "d{{k}}/README.txt", "Plain {{k}}"),
    (6, (0,), "d{{k}}/HISTORY.md", "old {{k}}"),
    (6, (0, 1), "d{{k}}/CHANGES.md", "new {{k}}"),
]


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and their directories, contents as text."""
    made = F.array(*[F.when((F.col("s_suppkey") % m).isin(*r), F.struct(text(path, _COLUMNS).alias("path"), text(content, _COLUMNS).alias("content"))) for m, r, path, content in FILES])
    out = cut(_read(spark, sf_dir, "supplier").select(F.explode(made).alias("f")).where("f is not null").select("f.*"), "files")
    folders = out.select(F.explode(T.ancestors(F.col("path"))).alias("path")).where("path <> ''").distinct()
    rows = out.withColumn("is_dir", F.lit(False)).unionByName(folders.select("path", F.lit(None).cast("string").alias("content"), F.lit(True).alias("is_dir")))
    return cut(rows.select(F.lit("all").alias("repo"), "path", T.dirname(F.col("path")).alias("dir"), T.basename(F.col("path")).alias("name"), "is_dir", F.octet_length("content").cast("long").alias("size"), "content"), "entries")


def _binary(entries: DataFrame) -> DataFrame:
    return entries.withColumn("content", F.col("content").cast("binary"))


_FILES_SQL = " union all ".join(f"select {text_sql(path, _COLUMNS)} as path, {text_sql(content, _COLUMNS)} as content from supplier where s_suppkey % {m} in ({', '.join(map(str, r))})" for m, r, path, content in FILES)
_TREE_SQL = f"""fl as (select path, content, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as dir, regexp_extract(path, '[^/]*$') as name from ({_FILES_SQL})),
up as (select distinct unnest(list_transform(range(1, len(string_split(dir, '/')) + 1), lambda i: array_to_string(list_slice(string_split(dir, '/'), 1, i), '/'))) as path from fl where dir <> ''),
dirs as (select path, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as dir from up),
foreign_ as (select dir as path from (select dir, bool_or(name in ('Makefile', 'CMakeLists.txt')) as b, bool_or(name in ('LICENSE', 'LICENSE.md')) as l from fl group by dir) where b and l and dir <> '' and (select count(*) from dirs where dirs.dir = foo.dir) >= 5)""".replace("from fl group by dir) where", "from fl group by dir) foo where")


@query(f"with {_TREE_SQL} select path from foreign_")
def vendored_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign projects that were copied into the tree."""
    return C.vendored(_entries(spark, sf_dir)).select("path")


_MARKER_ROWS = ", ".join(f"({i}, {quoted(n)}, {quoted(lang) if lang else 'null'}, {quoted(kind)})" for i, (n, lang, kind) in enumerate(V.MARKERS))
_LANGUAGE_SUFFIXES = "'py', 'go', 'c', 'rb', 'json', 'toml', 'yaml', 'yml', 'md'"
_SAM_NAMES = "regexp_extract_all(content, '(?m)^  (\\w+):\\n    Type: \\S*Function', 1)"
_SERVERLESS_NAMES = "regexp_extract_all(split_part(split_part(content, 'functions:', 2), 'plugins:', 1), '(?m)^  (\\w+):', 1)"
_COMPOSE_NAMES = "regexp_extract_all(split_part(split_part(content, 'services:', 2), 'volumes:', 1), '(?m)^  (\\w+):', 1)"
_COMPONENTS_SQL = f"""{_TREE_SQL}, mk(prio, name, lang, kind) as (values {_MARKER_ROWS}),
inside as (select d.path from dirs d join foreign_ f on starts_with(d.path, f.path || '/')),
best as (select fl.dir as path, arg_min(struct_pack(name := fl.name, content := fl.content, lang := mk.lang, kind := mk.kind), mk.prio) as m from fl join mk on mk.name = fl.name where fl.dir not in (select path from inside) and fl.dir not in (select path from foreign_) group by fl.dir),
marked as (select path, m.name as file, m.content as content, m.lang as language, m.kind as kind, regexp_extract(path, '[^/]*$') as folder from best),
ruby as (select regexp_replace(dir, '/config$', '') as path, regexp_replace(regexp_extract(content, 'module (\\w+)', 1), '([a-z])([A-Z])', '\\1 \\2', 'g') as name from fl where name = 'application.rb'),
described as (select k.path, case when file = 'package.json' then regexp_extract(content, '"name": "([^"]*)"', 1) when file in ('Cargo.toml', 'pyproject.toml') then regexp_extract(content, '(?m)^name = "([^"]*)"', 1)
    when file = 'Info.plist' then regexp_extract(content, '<string>([^<]*)', 1) when file = 'Gemfile' then r.name when file = 'template.yaml' and len({_SAM_NAMES}) = 1 then {_SAM_NAMES}[1] else folder end as name,
  case when file in ('template.yaml', 'serverless.yml') then 'api-server' else kind end as type, language,
  case when file = 'package.json' then regexp_extract(content, '"description": "([^"]*)"', 1) when file = 'docker-compose.yml' then 'Services: ' || array_to_string({_COMPOSE_NAMES}, ', ') when file = 'template.yaml' then 'AWS SAM: ' || array_to_string({_SAM_NAMES}, ', ')
    when file = 'serverless.yml' then 'Serverless: ' || array_to_string({_SERVERLESS_NAMES}, ', ') end as description,
  case when file = 'docker-compose.yml' then cast(regexp_extract(content, '''(\\d+):\\d+''', 1) as bigint) end as port,
  case when file = 'docker-compose.yml' then 'docker-compose' when file = 'template.yaml' then 'sam' when file = 'serverless.yml' then 'serverless' when file not in ('Dockerfile', 'Makefile') then file end as config
  from marked k left join ruby r on r.path = k.path),
found as (select * from described union all select path, regexp_extract(path, '[^/]*$'), 'library', null, null, null, null from foreign_),
dense as (select dir as path from fl where regexp_extract(name, '[^.]*$') in ({_LANGUAGE_SUFFIXES}) and contains(name, '.') and dir not in (select path from inside) group by dir having count(*) >= 2 and length(dir) - length(replace(dir, '/', '')) <= 4),
comps as (select * from found union all select path, regexp_extract(path, '[^/]*$'), 'module', null, null, null, null from dense where path not in (select path from found) union all select '', 'tree', 'project', null, null, null, null)"""


@query(f"with {_COMPONENTS_SQL} select path, case when path = '' then 'root' else lower(path) end as id, name, type, language, description, port, config from comps")
def discovered_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components by marker files in their order, foreign projects and directories with several source files."""
    texts = _entries(spark, sf_dir)
    found = C.components(_binary(texts), texts, C.vendored(texts), {"all": "tree"})
    return found.select("path", "id", "name", "type", "language", "description", "port", F.get("config_files", F.lit(0))["type"].alias("config"))


@query(f"""
with {_TREE_SQL}, inside as (select d.path from dirs d join foreign_ f on starts_with(d.path, f.path || '/'))
select path, case regexp_extract(name, '[^.]*$') when 'py' then 'python' when 'go' then 'go' when 'c' then 'c' when 'rb' then 'ruby' when 'json' then 'json' when 'toml' then 'toml' when 'md' then 'markdown' else 'yaml' end as language,
  cast(length(content) - length(replace(content, chr(10), '')) + 1 as bigint) as lines from fl where contains(name, '.') and regexp_extract(name, '[^.]*$') in ({_LANGUAGE_SUFFIXES}) and dir not in (select path from inside)
""")
def files_outside_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that are analysed: none below a foreign project."""
    texts = _entries(spark, sf_dir)
    return C.source_files(texts, C.vendored(texts)).select("path", "language", "lines")


_DOCS_SQL = "(select arg_min({value}, {rank}) from fl x where x.dir = d.path and x.name in ({names}))"


def _pick(names: list[str]) -> str:
    rank = "case x.name " + " ".join(f"when {quoted(n)} then {i}" for i, n in enumerate(names)) + " end"
    return f"(select arg_min(x.content, {rank}) from fl x where x.dir = d.path and x.name in ({', '.join(map(quoted, names))}))"


@query(f"with {_TREE_SQL}, d as (select distinct dir as path from fl where name in ({', '.join(quoted(n) for _, ns in V.DOC_FILES for n in ns)})) select d.path, {_pick(V.DOC_FILES[0][1])} as readme, {_pick(V.DOC_FILES[2][1])} as changelog from d")
def chosen_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a directory's README and change files the first in their order."""
    return docs.documents(_entries(spark, sf_dir)).select("path", "readme", "changelog")


@query(f"""
with {_COMPONENTS_SQL} select fl.dir as path, case when fl.name = 'package.json' then nullif(regexp_extract(content, '"description": "([^"]*)"', 1), '') else nullif(regexp_extract(content, 'description = "([^"]*)"', 1), '') end as purpose
from fl join comps c on c.path = fl.dir and c.config = fl.name where fl.name in ('package.json', 'Cargo.toml', 'pyproject.toml') and contains(content, 'description')
""")
def package_purposes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What package files say that their component is for."""
    texts = _entries(spark, sf_dir)
    found = C.components(_binary(texts), texts, C.vendored(texts), {"all": "tree"})
    return docs.purposes(found, texts).select("path", "purpose")


@query(f"""
with {_COMPONENTS_SQL}, ruby_ as (select path, name from ruby), py as (select dir as path, regexp_extract(content, '(?m)^name = "([^"]*)"', 1) as name from fl where name = 'pyproject.toml')
select d.path, coalesce(case when d.path like '%' then r.name end, py.name, regexp_extract(d.path, '[^/]*$')) as name from (select distinct path from dirs where not contains(path, '/')) d left join ruby_ r on r.path = d.path left join py on py.path = d.path
""")
def names_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components named like their folder take the name that Ruby applications or Python projects state."""
    texts = _entries(spark, sf_dir)
    comps = texts.where("is_dir and dir = ''").select("repo", "path", "name")
    project = texts.where("name = 'pyproject.toml'").select("repo", F.col("dir").alias("path"), F.col("content").alias("pyproject_text"))
    ruby = texts.where("name = 'Gemfile'").select("repo", F.col("dir").alias("path"), F.lit("ruby").alias("language"))
    rows = comps.join(project, ["repo", "path"], "left").join(ruby, ["repo", "path"], "left")
    rows = rows.withColumn("language", F.coalesce("language", F.when(F.col("pyproject_text").isNotNull(), "python"))).withColumn("framework", F.lit(None).cast("string"))
    return roles.named(rows, texts).select("path", "name")


# --- roles: customers are components; what they are is told by facts that vary independently ----------------

_FOLDERS = ["core", "applewatch", "admin", "logs", "scripts", "android-app", "docs", "tests", "api", "telemetry", "Service", "tools", "dashboard"]
_FACTS = {
    "fw": (["flask", None, "swiftui", "react", "electron", "appkit", None, "click", "axum", "uikit", "vue", None, "watchkit", "sinatra", "next.js", None, None], "c_custkey"),
    "lang": (["python", "swift", "typescript", "rust", "kotlin", "ruby", None], "c_custkey"),
    "folder": (_FOLDERS, "c_custkey"),
    "kind": (["module", "application", "package"], "(c_custkey // 3)"),
    "port_": ([None, 8080, None, None, 9000], "(c_custkey // 5)"),
    "deps": (["", "express", "react", "express,react", "react-native", "electron", "winston", "vue,vite", "", "", "lodash", ""], "(c_custkey // 7)"),
    "crates": (["", "clap", "axum,tokio", "clap,warp", "serde", "", ""], "(c_custkey // 11)"),
    "gems": (["", "rails", "rake", "", ""], "(c_custkey // 13)"),
    "plist": ([True, False, False, False], "(c_custkey // 2)"),
    "manifest": ([False, False, False, False, False, False, False, True, False, False, False, False], "(c_custkey // 17)"),
    "gradle": ([False, True], "(c_custkey // 4)"),
    "flutter": ([False] * 9 + [True], "(c_custkey // 19)"),
    "macos": ([False, True, False], "(c_custkey // 6)"),
    "frontend": ([False, True], "(c_custkey // 8)"),
    "script": ([False, False, False, True], "(c_custkey // 9)"),
    "markdown": ([0, 0, 9, 2], "(c_custkey // 10)"),
}


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer").select("c_custkey")
    rows = rows.select("c_custkey", *[choice(v, key).alias(name) for name, (v, key) in _FACTS.items()])
    return rows.withColumn("path", F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("/"), F.col("folder"))).withColumn("repo", F.lit("all"))


def _role_files(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that are analysed, entries of directories)."""
    names = lambda c, form: F.array_join(F.transform(F.filter(F.split(c, ","), lambda d: d != ""), lambda d: F.format_string(form, d)), "")
    pkg = F.concat(F.lit('{"name": "x", "dependencies": {"z": "1"'), names("deps", ', "%s": "1"'), F.lit("}}"))
    one = lambda name, content, when=None: F.when(F.lit(True) if when is None else F.col(when), F.struct(F.lit(name).alias("name"), (content if isinstance(content, Column) else F.lit(content)).alias("content")))
    code = [one("a.swift", "NSWindow()", "macos"), one("v.tsx", "x", "frontend"), one("my_server.py", "'''Mail gateway for people'''\nimport aiohttp\nport = 7001\n", "script"), one("b.go", "package b")]
    notes = F.transform(F.when(F.col("markdown") > 0, F.sequence(F.lit(1), F.col("markdown"))).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.concat(F.lit("n"), i.cast("string"), F.lit(".md")).alias("name"), F.lit("# x").alias("content")))
    others = [
        one("package.json", pkg), one("Cargo.toml", F.concat(F.lit("[dependencies]\n"), names("crates", '%s = "1"\n'))), one("Gemfile", names("gems", "gem '%s'\n")),
        one("Info.plist", "x", "plist"), one("AndroidManifest.xml", "x", "manifest"), one("build.gradle", "x", "gradle"), one("pubspec.yaml", "flutter:\n", "flutter"),
    ]

    def table(made: Column) -> DataFrame:
        rows = facts.select("repo", F.col("path").alias("owner"), F.explode(made).alias("f")).where("f is not null").select("repo", "owner", F.col("owner").alias("dir"), "f.*", F.lit(False).alias("is_dir"))
        return cut(rows.withColumn("path", F.concat_ws("/", "owner", "name")), "role_files")

    files = table(F.concat(F.array(*code), notes))
    return files, table(F.array(*others)).unionByName(files)


_has = lambda c, names: "(" + " or ".join(f"list_contains(string_split({c}, ','), {quoted(n)})" for n in names) + ")"
_in = lambda c, names: f"{c} in ({', '.join(map(quoted, names))})"
_ROLE_FACTS_SQL = "select c_custkey, " + ", ".join(f"{choice_sql(v, key)} as {name}" for name, (v, key) in _FACTS.items()) + " from customer"
_ROLES_SQL = f"""r0 as ({_ROLE_FACTS_SQL}), r1 as (select *, coalesce(fw, '') as f, coalesce(lang, '') as l, lower(folder) as d, 'c' || c_custkey || '/' || folder as path, 1 + cast(macos as int) + cast(frontend as int) + cast(script as int) + markdown as n_files from r0),
r2 as (select *, (d in ({', '.join(map(quoted, V.CONTENT_DIRS))}) and (n_files - markdown) / n_files < 0.2) or markdown / n_files > 0.8 as content_only,
  case when contains(d, 'watch') and (l = 'swift' or f in ('swiftui', 'watchkit')) then 'watch-app'
    when f = 'appkit' or (f = 'swiftui' and macos) then 'desktop-app'
    when f in ('swiftui', 'uikit') and (plist or kind = 'application') then 'ios-client'
    when manifest or (gradle and l in ('java', 'kotlin') and contains(d, 'android')) then 'android-client'
    when {_has("deps", ["react-native"])} or flutter then 'mobile-client'
    when f = 'electron' or {_has("deps", ["electron"])} then 'desktop-app'
    when {_in("f", V.SERVER_FRAMEWORKS)} then 'api-server'
    when {_has("deps", V.PURE_SERVER_DEPS)} and not {_has("deps", V.CLIENT_DEPS)} then 'api-server'
    when {_has("crates", V.RUST_SERVER_DEPS)} or {_has("gems", V.RUBY_SERVER_DEPS)} then 'api-server' end as early from r1),
r3 as (select *, not content_only and early is null and script and not {_in("d", V.TEST_DIRS)} as scripted from r2),
r4 as (select *, case when content_only then 'content' when early is not null then early when scripted then 'service'
    when port_ is not null and {_in("l", V.SERVER_LANGUAGES)} and not {_has("deps", V.CLIENT_DEPS)} and not {_in("d", V.UTILITY_DIRS)} then 'api-server'
    when {_in("d", V.LOGGING_DIRS)} and (port_ is not null or {_in("l", V.SERVER_LANGUAGES)}) then 'service'
    when {_has("deps", V.LOGGING_DEPS)} and port_ is not null then 'service'
    when {_in("f", V.WEB_FRAMEWORKS)} or {_has("deps", V.WEB_DEPS)} then 'web-client'
    when {_in("d", V.ADMIN_DIRS)} and frontend then 'web-client'
    when l = 'python' and f in ('click', 'typer') then 'cli-tool'
    when {_has("crates", ["clap"])} and not {_has("crates", V.RUST_SERVER_DEPS)} then 'cli-tool' else kind end as type from r3)"""


@query(f"with {_ROLES_SQL} select path, type, cast(case when scripted and port_ is null then 7001 else port_ end as bigint) as port, case when scripted and d = folder then 'Mail gateway' else folder end as name from r4")
def architectural_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What components are, by the ordered rules; server scripts give a port and a name."""
    facts = _facts(spark, sf_dir)
    files, entries = _role_files(facts)
    comps = facts.select("repo", "path", F.col("folder").alias("name"), F.col("kind").alias("type"), F.col("lang").alias("language"), F.col("fw").alias("framework"), F.col("port_").cast("long").alias("port"))
    return roles.promoted(comps, files, entries).select("path", "type", "port", "name")


@query(f"""
with r as ({_ROLE_FACTS_SQL}), f as (select 'c' || c_custkey % 50 as path, c_custkey, fw from r where fw is not null),
k as (select *, case fw {' '.join(f"when {quoted(a)} then {b}" for a, b in V.FRAMEWORK_RANK.items())} else 1 end as rank from f) select path, arg_min(fw, row(-rank, lpad(cast(c_custkey as varchar), 9, '0'))) as framework from k group by path
""")
def component_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a component's frameworks the most specific, of equal ones that of the first file."""
    facts = _facts(spark, sf_dir)
    files = facts.select("repo", F.concat(F.lit("c"), (F.col("c_custkey") % 50).cast("string")).alias("owner"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("path"), F.col("fw").alias("framework"))
    return roles.frameworks(files).select(F.col("owner").alias("path"), "framework")


_TECH = ["tsconfig.json", "jest.config.js", "vite.config.ts", "a.py", ".eslintrc", "b.py", "webpack.config.js"]


@query(f"""
with f as (select 'c' || c_nationkey as path, {choice_sql(_TECH, 'c_custkey')} as name, row_number() over (partition by c_nationkey order by lpad(cast(c_custkey as varchar), 9, '0')) as k from customer),
t as (select path, case name {' '.join(f"when {quoted(a)} then {quoted(b)}" for a, b in V.TECH_FILES.items())} end as tech from f where k <= {V.TECH_FILES_READ}),
c as (select 'c' || n_nationkey as path, {choice_sql(['Flask', None, 'React'], 'n_nationkey')} as framework, {choice_sql(['python', 'typescript', None, 'go'], 'n_nationkey')} as language from nation)
select c.path, array_to_string(list_sort(list_distinct(list_filter(list_concat([c.framework, upper(left(c.language, 1)) || substr(c.language, 2)], coalesce((select list(tech) from t where t.path = c.path), [])), lambda x: x is not null))), ',') as stack from c
""")
def tech_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framework, language and what configuration files among the first fifty tell."""
    n, c = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "customer")
    owner = lambda k: F.concat(F.lit("c"), F.col(k).cast("string"))
    comps = n.select(F.lit("all").alias("repo"), owner("n_nationkey").alias("path"), choice(["Flask", None, "React"], "n_nationkey").alias("framework"), choice(["python", "typescript", None, "go"], "n_nationkey").alias("language"))
    files = c.select(F.lit("all").alias("repo"), owner("c_nationkey").alias("owner"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("path"), choice(_TECH, "c_custkey").alias("name"))
    return docs.tech_stack(comps, files).select("path", _joined("tech_stack").alias("stack"))


@query("""
with a as (select 'c' || c_nationkey as path, 'n' || lpad(cast(c_custkey as varchar), 6, '0') || '.md' as name, c_custkey, c_custkey % 4 = 3 as doc from customer),
f as (select * from a where not doc or path not in (select path from a where not doc)),
k as (select *, row_number() over (partition by path order by name) as k from f where c_custkey % 4 <> 2)
select path, string_agg('**Note ' || c_custkey || '** (' || name || '): one two', chr(10) || chr(10) order by k) as notes from k where k <= 20 group by path
""")
def architecture_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty notes with a heading of each docs folder; where there is one, doc is not read."""
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    folder = F.when(k % 4 == 3, "doc").otherwise("docs")
    name = F.concat(F.lit("n"), F.lpad(k.cast("string"), 6, "0"), F.lit(".md"))
    text = F.when(k % 4 == 2, F.lit("no heading\nat all")).otherwise(F.concat(F.lit("# Note "), k.cast("string"), F.lit("\n\none\ntwo\n\nthree")))
    top = F.concat(F.lit("c"), F.col("c_nationkey").cast("string"))
    files = c.select(F.lit("all").alias("repo"), F.concat_ws("/", top, folder, name).alias("path"), F.concat_ws("/", top, folder).alias("dir"), name.alias("name"), F.lit(False).alias("is_dir"), text.alias("content"))
    folders = files.select("repo", F.col("dir").alias("path"), T.dirname(F.col("dir")).alias("dir"), T.basename(F.col("dir")).alias("name"), F.lit(True).alias("is_dir"), F.lit(None).cast("string").alias("content")).distinct()
    return docs.notes(files.unionByName(folders)).select("path", F.col("architecture_notes").alias("notes"))


@query("""
select 's' || s_suppkey as repo, case when s_suppkey % 3 = 0 then '' else left('Supplies ' || s_name || repeat(' and more', s_suppkey % 40), 200) end as description, case when s_suppkey % 2 = 0 then 'https://github.com/acme/s' || s_suppkey end as repository from supplier
""")
def project_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The README's first line of text and the origin's address of each repository."""
    s = _read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    repo = F.concat(F.lit("s"), k)
    readme = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "# Only a head\n=====\n").otherwise(F.concat(F.lit("# Head\n\n====\n  Supplies "), "s_name", F.expr("repeat(' and more', cast(s_suppkey % 40 as int))"))), F.lit("\n"))
    git = F.concat(F.lit('[remote "origin"]\n\turl = git@github.com:acme/s'), k, F.lit(".git\n\tfetch = x"))
    row = lambda path, folder, name, content: s.select(repo.alias("repo"), F.lit(path).alias("path"), F.lit(folder).alias("dir"), F.lit(name).alias("name"), F.lit(False).alias("is_dir"), content.alias("content"), "s_suppkey")
    texts = row("README.md", "", "README.md", readme).unionByName(row(".git/config", ".git", "config", git).where("s_suppkey % 2 = 0")).drop("s_suppkey")
    return docs.project_info(texts)


@query("""
with s as (select s_suppkey, s_nationkey, s_suppkey % 3 as m from supplier),
own as (select 'n' || s_nationkey as path, cast(arg_min(3000 + s_suppkey, lpad(cast(s_suppkey as varchar), 9, '0')) as bigint) as first_port from s where m = 0 group by s_nationkey),
c as (select 'n' || n_nationkey as path, case when n_nationkey % 3 = 2 then 'module' else 'api-server' end as type, case when n_nationkey % 7 = 0 then cast(80 as bigint) end as port from nation),
child as (select 'n' || s_nationkey || '/x' || lpad(cast(s_suppkey as varchar), 9, '0') as path, 'n' || s_nationkey as up, cast(5000 + s_suppkey as bigint) as port from s where m = 1)
select c.path, coalesce(c.port, case when c.type = 'api-server' then coalesce(own.first_port, (select arg_min(child.port, child.path) from child where child.up = c.path)) end) as port from c left join own on own.path = c.path
union all select path, port from child
""")
def server_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Servers without a port take their first file's, then their first child's."""
    s, n = _read(spark, sf_dir, "supplier"), _read(spark, sf_dir, "nation")
    pad = F.lpad(F.col("s_suppkey").cast("string"), 9, "0")
    top = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
    k = F.col("n_nationkey")
    comps = n.select(F.lit("all").alias("repo"), F.concat(F.lit("n"), k.cast("string")).alias("path"), F.when(k % 3 == 2, "module").otherwise("api-server").alias("type"), F.when(k % 7 == 0, 80).cast("long").alias("port"), F.lit("").alias("parent_path"))
    below = s.where("s_suppkey % 3 = 1").select(F.lit("all").alias("repo"), F.concat(top, F.lit("/x"), pad).alias("path"), F.lit("service").alias("type"), F.lit(None).cast("long").alias("port"), top.alias("parent_path"))
    comps = comps.unionByName(below).withColumn("id", T.component_id(F.col("path"))).withColumn("ord", F.struct(F.lit(1).alias("kind"), "path"))
    m = F.col("s_suppkey") % 3
    listen = F.when(m == 0, 3000 + F.col("s_suppkey")).when(m == 1, 5000 + F.col("s_suppkey"))
    files = s.where("s_suppkey % 3 <> 2").select(F.lit("all").alias("repo"), F.when(m == 1, F.concat(top, F.lit("/x"), pad)).otherwise(top).alias("owner"), pad.alias("path"), F.lit("go").alias("language"), F.array(listen.cast("int")).alias("ports"))
    return roles.with_ports(comps, files).select("path", "port")


@query("""
with c as (select 'n' || n_nationkey as path from nation union all select 'n' || n_nationkey || '/lib' from nation union all select ''),
i as (select 'n' || (s_suppkey % 25) || '/src/f' || s_suppkey as file, case s_suppkey % 4 when 0 then '../lib/x' when 1 then './y' when 2 then '../../n' || (s_suppkey % 7) || '/lib/z' else '../../../w' end as import, 'n' || (s_suppkey % 25) || case s_suppkey % 4 when 0 then '/lib/x' when 1 then '/src/y' else '' end as whole, s_suppkey from supplier),
p as (select file, import, case s_suppkey % 4 when 2 then 'n' || (s_suppkey % 7) || '/lib/z' when 3 then 'w' else whole end as path from i)
select file, import, (select arg_max(c.path, length(c.path)) from c where c.path = '' or starts_with(p.path, c.path || '/')) as target from p
""")
def relative_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components that relative imports lead to."""
    n, s = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "supplier")
    top = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    comps = n.select(F.explode(F.array(top, F.concat(top, F.lit("/lib")), F.lit(""))).alias("path")).distinct()
    comps = comps.select(F.lit("all").alias("repo"), "path", F.lit("zz").alias("name"), F.struct(F.lit(1).alias("kind"), "path").alias("ord"))
    k = F.col("s_suppkey")
    text = F.when(k % 4 == 0, "../lib/x").when(k % 4 == 1, "./y").when(k % 4 == 2, F.concat(F.lit("../../n"), (k % 7).cast("string"), F.lit("/lib/z"))).otherwise("../../../w")
    found = s.select(F.lit("all").alias("repo"), F.concat(F.lit("n"), (k % 25).cast("string"), F.lit("/src/f"), k.cast("string")).alias("file"), text.alias("import"))
    return C.resolve_imports(found, comps).select("file", "import", "target")
