"""Queries on components, screens and whole repositories, with SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import values as V
from ..functions import text as T
from ..operators import metrics, multirepo, relationships, textsearch, uiflow, views
from .registry import _SEARCHED, _TREE, _TREE_EDGES, _joined, _read, _tree, _tree_edges, query
from .written import choice, choice_sql, quoted

# --- one component, its files, its symbols --------------------------------------------------------


def _nation_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(components, files, symbols): nations, their customers, these customers' orders."""
    n, c, o = (_read(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    node = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    owned = c.groupBy("c_nationkey").agg(F.collect_list("c_name").alias("files"))  # customers of a nation, as files of a component are listed
    docs = F.struct(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("readme"), F.lit("").alias("claude_md"), F.col("n_comment" if "n_comment" in n.columns else "n_name").alias("architecture_notes"), F.lit(None).cast("string").alias("api_docs"), F.lower("n_name").alias("changelog"))
    comps = n.join(owned, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(node.alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("n_name").alias("name"), F.lit("module").alias("type"), node.alias("path"), F.coalesce("files", F.array().cast("array<string>")).alias("files"), docs.alias("docs"))
    keys = o.groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("symbols"))
    files = c.join(keys, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_name").alias("path"), F.lit("go").alias("language"), F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"))
    said = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 3 == 1, "")
    symbols = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("name"), F.col("o_orderpriority").alias("kind"), F.col("c_name").alias("file"), F.col("o_orderkey").alias("line"), said.alias("docstring"))
    return comps, files, symbols


@query(f"with t as ({_TREE}) select id, parent_id, name, type from t where id = 'n3'")
def one_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.component(_tree(spark, sf_dir), "n3").select("id", "parent_id", "name", "type")


_ENTERED = ["all", "r1", "n3", "c5", "c20", "c40", "nobody"]


@query(f"with t as ({_TREE}), a as (select unnest([{', '.join(map(quoted, _ENTERED))}]) as id) select a.id, coalesce(t.n_files > 0, false) or a.id in (select parent_id from t where parent_id is not null) as enters, t.parent_id as up from a left join t on t.id = a.id")
def drill_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether components can be entered, and where leaving them leads."""
    tree = _tree(spark, sf_dir)
    return spark.createDataFrame([(i, views.can_drill(tree, i), views.drill_up(tree, i)) for i in _ENTERED], "id string, enters boolean, up string")


@query("select c_name as path from customer where c_nationkey = 3")
def component_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    comps, files, _ = _nation_tables(spark, sf_dir)
    return views.files_of(comps, files, "n3").select("path")


@query("select cast(o_orderkey as varchar) as id, c_name as file from orders join customer on c_custkey = o_custkey where c_nationkey = 3")
def component_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    comps, files, symbols = _nation_tables(spark, sf_dir)
    return views.symbols_of(comps, files, symbols, "n3").select("id", "file")


@query("select cast(o_orderkey as varchar) as id from orders join customer on c_custkey = o_custkey where c_name = (select min(c_name) from customer)")
def symbols_of_a_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, files, symbols = _nation_tables(spark, sf_dir)
    first = files.agg(F.min("path")).first()[0]
    return views.symbols_in_file(files, symbols, first).select("id")


@query("select cast(o_orderkey as varchar) as id, o_orderpriority as docstring from orders join customer on c_custkey = o_custkey where o_orderkey % 3 = 0 order by c_name, o_orderkey limit 8")
def documented_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight symbols with documentation."""
    return views.documented(_nation_tables(spark, sf_dir)[2]).select("id", "docstring")


@query("select distinct o_orderpriority as kind from orders join customer on c_custkey = o_custkey")
def symbol_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.symbol_kinds(_nation_tables(spark, sf_dir)[2])


@query("""
select 'component' as what, 'n4' as id, n_name as name from nation where n_nationkey = 4 union all select 'file', c_name, 'go' from customer where c_custkey = 5
union all select 'symbol', cast(o_orderkey as varchar), o_orderstatus from orders join customer on c_custkey = o_custkey where o_orderkey = (select min(o_orderkey) from orders)
""")
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records behind three search results."""
    comps, files, symbols = _nation_tables(spark, sf_dir)
    file = _read(spark, sf_dir, "customer").where("c_custkey = 5").first()["c_name"]
    symbol = str(_read(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0])
    shown = lambda kind, id_, own, name: views.hit(comps, files, symbols, kind, id_).select(F.lit(kind).alias("what"), F.col(own).alias("id"), F.col(name).alias("name"))
    return shown("component", "n4", "id", "name").unionByName(shown("file", file, "path", "language")).unionByName(shown("symbol", symbol, "id", "name"))


@query("select 'readme' as key, 'README' as label, n_name as content from nation where n_nationkey = 4 union all select 'architecture_notes', 'Architecture', n_name from nation where n_nationkey = 4 union all select 'changelog', 'Changelog', lower(n_name) from nation where n_nationkey = 4")
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A component's documents; empty ones are left out."""
    comps = _nation_tables(spark, sf_dir)[0]
    same = F.struct(*[F.col(f"docs.{k}").alias(k) for k in ("readme", "claude_md", "api_docs", "changelog")], F.col("name").alias("architecture_notes"))
    return views.doc_sections(comps.withColumn("docs", same), "n4").select("key", "label", "content")


_NAMED = ["React", "vue.js", "@angular/core", "Next.js", "Nothing", "express"]
_REFERENCE = [("react", "Builds pages"), ("vue", "Builds pages too"), ("core", "A scope's core"), ("Next.js", "As it is"), ("next.js", "In lower case"), ("express", "Serves")]


@query(f"""
with t(name, description) as (values {', '.join(f'({quoted(a)}, {quoted(b)})' for a, b in _REFERENCE)}), n as (select c_custkey, {choice_sql(_NAMED, 'c_custkey')} as name from customer)
select n.name, coalesce(a.description, b.description, c.description) as description from (select distinct name from n) n left join t a on a.name = n.name left join t b on b.name = lower(n.name) left join t c on c.name = regexp_replace(regexp_replace(lower(n.name), '\\.js$', ''), '^@\\w+/', '')
""")
def technology_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reference table says about technologies, by name, lower-case name or bare name."""
    names = _read(spark, sf_dir, "customer").select(choice(_NAMED, "c_custkey").alias("name")).distinct()
    table = spark.createDataFrame([(a, b, "") for a, b in _REFERENCE], "name string, description string, url string")
    return views.tech_reference(names, table).select("name", "description")


@query(f"""
with recursive t as ({_TREE}), top as (
  select n.id from t r join t n on n.parent_id = r.id where r.parent_id = 'all' and n.type in ('web-client', 'api-server') union all select c.id from t r join t n on n.parent_id = r.id join t c on c.parent_id = n.id where r.parent_id = 'all' and n.type not in ('web-client', 'api-server') and c.type = 'service'),
w as (select id, name, type, 'Root' as under from t where parent_id is null
  union all select t.id, t.name, t.type, case when w.id in (select id from top) then w.name else w.under end from t join w on t.parent_id = w.id where w.id in (select id from top) or w.type in ('project', 'repository'))
select under as parent_name, id from w where id not in (select id from top) and type not in ('project', 'repository', 'content')
""")
def components_besides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components that the top view leaves out, by what stands above them."""
    tree = _tree(spark, sf_dir)
    return views.other_components(tree, views.top_candidates(tree).distinct()).select("parent_name", "id")


# --- annotations, formats, places ------------------------------------------------------------------


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("c"), (F.col("user_id") % 20).cast("string")).alias("componentId"), F.when(F.col("event_id") % 2 == 0, "file").otherwise("component").alias("targetType"), F.col("user_id").cast("string").alias("targetId"), F.col("event_type").alias("text"))


@query("select cast(event_id as varchar) as id, case when event_id = (select min(event_id) from events) then 'changed' else event_type end as text from events where event_id <> (select max(event_id) from events)")
def edited_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One annotation with a new text, one gone."""
    first, last = _read(spark, sf_dir, "events").agg(F.min("event_id"), F.max("event_id")).first()
    return views.deleted(views.updated(_annotations(spark, sf_dir), str(first), "changed"), str(last)).select("id", "text")


@query("select cast(event_id as varchar) as id from events where user_id % 20 = 7 and event_id % 2 = 0")
def annotations_of_a_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.annotations_for(_annotations(spark, sf_dir), "c7", "file").select("id")


@query("""
select o_orderkey, case when s < 60 then 'just now' when s < 3600 then (s // 60) || 'm ago' when s < 86400 then (s // 3600) || 'h ago' when s < 604800 then (s // 86400) || 'd ago'
  else strftime(timestamp '2024-03-01 12:00:00' - to_seconds(s), '%-m/%-d/%Y') end as age, regexp_replace(cast(s as varchar), '(\\d)(\\d{3})$', '\\1,\\2') as shown from (select o_orderkey, o_orderkey * 37 % 900000 as s from orders)
""")
def ages_and_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages and counts as they are shown."""
    now = F.to_timestamp(F.lit("2024-03-01 12:00:00"))
    s = F.col("o_orderkey") * 37 % 900_000
    return _read(spark, sf_dir, "orders").select("o_orderkey", views.format_age(F.timestamp_seconds(F.unix_timestamp(now) - s), now).alias("age"), views.format_count(s).alias("shown"))


_PLACED = [*V.TYPE_ORDER, "library", "module"]


@query(f"select c_custkey, least(c_custkey % {len(_PLACED)}, {len(V.TYPE_ORDER)}) + case when c_custkey % {len(_PLACED)} >= {len(V.TYPE_ORDER)} then {V.LAST_TYPE - len(V.TYPE_ORDER)} else 0 end as place, cast({choice_sql([V.EDGE_STYLES[k][3] for k in V.EDGE_STYLES], 'c_custkey')} as double) as width from customer")
def layout_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of all types and the widths of all edges in a layout."""
    width = views.edge_style(choice(list(V.EDGE_STYLES), "c_custkey"))["width"]
    return _read(spark, sf_dir, "customer").select("c_custkey", views.type_order(choice(_PLACED, "c_custkey")).alias("place"), width.alias("width"))


# --- what stands in text: all patterns -----------------------------------------------------------------

_PORT_TEXTS = [
    "x.listen( 8{k}", "s.bind('0.0.0.0', a:8{k})", "y.serve(app, 8{k})", 'TcpListener::bind("h:8{k}")', "app.run(host=h, port=8{k})", "uvicorn.run(app, port = 8{k})", "createServer(x).listen(8{k})", "axum::serve(bind(h:8{k}))", "HTTP_PORT: 8{k}",
    "web.run_app(a, port=8{k})", "0.0.0.0:8{k}", "a\nPORT = int(\"8{k})", "MY_PORT, '8{k}'", "os.environ.get('PORT', '8{k}')", "default_value = \"8{k}\"", "port 8{k}", "x.listen(42) LISTEN_PORT=8{k} x.listen(8{k})",
]


@query("select c_custkey, case when c_custkey % 17 = 15 then '' else '8' || (100 + c_custkey % 800) end as ports from customer")
def all_port_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ports in all the ways in which files name them."""
    shape = F.replace(choice(_PORT_TEXTS, "c_custkey"), F.lit("{k}"), (100 + F.col("c_custkey") % 800).cast("string"))
    return _read(spark, sf_dir, "customer").select("c_custkey", _joined(T.ports(shape)).alias("ports"))


_ENV_TEXTS = ["os.environ['A{k}'] and getenv( \"B\" )", "process.env.C{k} + process.env.D", 'env::var( "E{k}" )', "env['F{k}'] os.environ.get('no')", "nothing"]


@query("""
select c_custkey, case c_custkey % 5 when 0 then 'A' || k || ',B' when 1 then 'C' || k || ',D' when 2 then 'E' || k when 3 then 'F' || k else '' end as names
from (select c_custkey, 100 + c_custkey % 800 as k from customer)
""")
def all_env_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.replace(choice(_ENV_TEXTS, "c_custkey"), F.lit("{k}"), (100 + F.col("c_custkey") % 800).cast("string"))
    return _read(spark, sf_dir, "customer").select("c_custkey", _joined(T.env_vars(shape)).alias("names"))


#: Languages and their extensions, stated apart from ``values``, so that the query holds one against the other.
_LANGUAGE_OF = (
    "swift .swift; python .py; rust .rs; typescript .ts .tsx; javascript .js .jsx; go .go; java .java; kotlin .kt; ruby .rb; cpp .cpp .hpp; c .c .h; csharp .cs; dart .dart; vue .vue; svelte .svelte; "
    "html .html; css .css; scss .scss; sql .sql; shell .sh .bash .zsh; toml .toml; yaml .yaml .yml; json .json; markdown .md .mdx"
)
_KNOWN_EXTENSIONS = [(ext, language) for language, *own in (x.split() for x in _LANGUAGE_OF.split("; ")) for ext in own] + [(".png", None), ("", None), (".TXT", None)]
_EXTENSIONS = [ext for ext, _ in _KNOWN_EXTENSIONS]


@query(f"select c_custkey, {choice_sql([language for _, language in _KNOWN_EXTENSIONS], 'c_custkey')} as language, case when {choice_sql(_EXTENSIONS, 'c_custkey')} = '' then '' else lower({choice_sql(_EXTENSIONS, 'c_custkey')}) end as suffix from customer")
def all_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all known file extensions, in upper case too."""
    ext = choice(_EXTENSIONS, "c_custkey")
    name = F.concat(F.lit("file"), F.when(F.col("c_custkey") % 2 == 0, F.upper(ext)).otherwise(ext))
    return _read(spark, sf_dir, "customer").select("c_custkey", T.language(name).alias("language"), T.suffix(name).alias("suffix"))


#: Domains of cloud services with name and category, stated apart from ``values``.
_CLOUDS = [x.split("|") for x in (
    "api.openai.com|OpenAI|ai", "api.anthropic.com|Anthropic|ai", "api.groq.com|Groq|ai", "api.cohere.ai|Cohere|ai", "api.mistral.ai|Mistral|ai", "generativelanguage.googleapis.com|Google AI|ai", "api.deepgram.com|Deepgram|speech",
    "api.assemblyai.com|AssemblyAI|speech", "api.elevenlabs.io|ElevenLabs|speech", "api.speechmatics.com|Speechmatics|speech", "api.stripe.com|Stripe|payments", "api.twilio.com|Twilio|communications", "api.sendgrid.com|SendGrid|email",
    "api.github.com|GitHub|devtools", "api.gitlab.com|GitLab|devtools", "api.slack.com|Slack|communications", "api.firebase.google.com|Firebase|backend", "firestore.googleapis.com|Firestore|database",
)]


@query(f"""
with d(i, name, category) as (values {', '.join(f'({i}, {quoted(n)}, {quoted(c)})' for i, (_, n, c) in enumerate(_CLOUDS))}), f as (select 'n' || c_nationkey as source, c_custkey % {len(_CLOUDS) + 2} as i, c_custkey % 4 as form from customer)
select source, string_agg(name || ':' || category, ',' order by name) as services from (select distinct source, name, category from f join d on d.i = f.i where form <> 3) group by source
""")
def all_cloud_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All known cloud services, by addresses in quotes, sockets and hosts."""
    domain = choice([d for d, _, _ in _CLOUDS] + ["example.com", "api.unknown.io"], "c_custkey")
    form = F.col("c_custkey") % 4
    text = F.when(form == 0, F.concat(F.lit("'https://"), domain, F.lit("/v1'"))).when(form == 1, F.concat(F.lit("wss://"), domain)).when(form == 2, F.concat(F.lit('host = "'), domain, F.lit('"'))).otherwise(domain)
    node = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    comps = _read(spark, sf_dir, "nation").select(F.lit("all").alias("repo"), node("n_nationkey").alias("path"), node("n_nationkey").alias("id"), F.lit("module").alias("type"))
    files = _read(spark, sf_dir, "customer").select(F.lit("all").alias("repo"), node("c_nationkey").alias("owner"), F.lit("go").alias("language"), text.alias("content"))
    found = relationships.external_services(files, comps)
    return found.select("source", F.array_join(F.transform("external_services", lambda s: F.concat_ws(":", s["name"], s["category"])), ",").alias("services"))


@query("""
with a as (select 'a' || s_suppkey as id, case s_suppkey % 4 when 0 then 'watch-app' when 1 then 'ios-client' else 'module' end as type, s_suppkey % 5 < 2 as uses from supplier),
w as (select * from a where type = 'watch-app'), p as (select * from a where type = 'ios-client')
select distinct w.id as source, p.id as target from w, p where w.uses or p.uses
""")
def watch_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watch apps and phone apps of which one side imports the connection."""
    s = _read(spark, sf_dir, "supplier")
    id_, k = F.concat(F.lit("a"), F.col("s_suppkey").cast("string")), F.col("s_suppkey") % 4
    comps = s.select(F.lit("all").alias("repo"), id_.alias("id"), id_.alias("path"), F.when(k == 0, "watch-app").when(k == 1, "ios-client").otherwise("module").alias("type"), F.struct(F.lit(1).alias("kind"), id_.alias("path")).alias("ord"))
    imports = F.when(F.col("s_suppkey") % 5 < 2, F.array(F.lit("SwiftUI"), F.lit("WatchConnectivity"))).otherwise(F.array(F.lit("SwiftUI")))
    files = s.select(F.lit("all").alias("repo"), id_.alias("owner"), F.concat(id_, F.lit("/x.swift")).alias("path"), F.lit("swift").alias("language"), imports.alias("imports"))
    return relationships.watch_edges(files, comps).select("source", "target")


# --- several repositories -----------------------------------------------------------------------------


def _repositories(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    s = _read(spark, sf_dir, "supplier")
    repo, key = F.concat(F.lit("g"), F.col("s_nationkey").cast("string")), F.col("s_suppkey").cast("string")
    ids = lambda mark: F.array(F.concat(F.lit(mark), key))
    return {
        "components": s.select(repo.alias("repo"), key.alias("id"), F.concat(F.lit("a/"), key).alias("path"), F.when(F.col("s_suppkey") % 2 == 0, "0").alias("parent_id"), ids("f").alias("files")),
        "relationships": s.select(repo.alias("repo"), key.alias("source"), F.lit("0").alias("target"), F.lit("http").alias("type")),
        "symbols": s.select(repo.alias("repo"), F.concat(F.lit("s"), key).alias("id"), F.concat(F.lit("f"), key).alias("file")),
        "files": s.select(repo.alias("repo"), F.concat(F.lit("f"), key).alias("path"), ids("s").alias("symbols")),
    }


@query("""
with g as (select 'g' || s_nationkey || '/' as p, s_suppkey as k from supplier)
select 'component' as what, p || k as id, p || 'a/' || k as place, case when k % 2 = 0 then p || '0' else 'repo:' || left(p, length(p) - 1) end as other from g
union all select 'edge', p || k, null, p || '0' from g union all select 'symbol', p || 's' || k, p || 'f' || k, null from g union all select 'file', p || 'f' || k, null, p || 's' || k from g
""")
def merged_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and paths of all tables of several repositories, made distinct by their names."""
    m = multirepo.with_prefixes(_repositories(spark, sf_dir))
    none = F.lit(None).cast("string")
    row = lambda t, what, id_, place, other: m[t].select(F.lit(what).alias("what"), F.col(id_).alias("id"), (none if place is None else F.col(place)).alias("place"), (none if other is None else other).alias("other"))
    out = row("components", "component", "id", "path", F.col("parent_id")).unionByName(row("relationships", "edge", "source", None, F.col("target")))
    return out.unionByName(row("symbols", "symbol", "id", "file", None)).unionByName(row("files", "file", "path", None, F.col("symbols")[0]))


@query("""
with f as (select source as repo, count(*) as files, cast(sum(strlen(text)) as bigint) as size_bytes from documents group by source)
select 'repo:' || repo as id, '@' || repo as path, repo as name, 'repository' as type, case when repo like '%e%' then 'About ' || repo end as description, files, size_bytes, null as parent_id from f
""")
def repository_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node above each repository's components, with its sums."""
    from .registry import _doc_files

    files = _doc_files(spark, sf_dir, F.col("source"))
    own = files.select("repo", F.col("owner").alias("path")).distinct()
    stats = metrics.repository_stats(files, own, own.limit(0))
    info = stats.select("repo", F.when(F.col("repo").contains("e"), F.concat(F.lit("About "), "repo")).otherwise("").alias("description"))
    strings = "array<string>"
    shape = (
        "repo string, id string, parent_id string, path string, name string, type string, language string, description string, files array<string>, "
        f"metrics struct<files:long,lines:long,size_bytes:long,symbols:long,languages:map<string,bigint>>, docs struct<readme:string,purpose:string,patterns:{strings}>"
    )
    nodes = multirepo.repository_nodes(spark.createDataFrame([], shape), stats, info)
    return nodes.select("id", "path", "name", "type", "description", F.col("metrics.files").alias("files"), F.col("metrics.size_bytes").alias("size_bytes"), "parent_id")


_RULES = [("web", "api", "http", "calls", 8080, True), ("api", "jobs", "import", None, None, False), ("web", "api", "http", "again", None, False)]


@query("values ('repo:web', 'repo:api', 'http', 'calls', cast(8080 as bigint), true), ('repo:api', 'repo:jobs', 'import', null, null, false), ('repo:web', 'repo:api', 'http', 'again', null, false)".replace("values", "select * from (values") + ") as t(source, target, type, label, port, bidirectional)")
def stated_cross_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between repositories as a configuration states them, repeats and all."""
    rules = [{"source_repo": a, "target_repo": b, "type": t, "label": lab, "port": p, "bidirectional": both} for a, b, t, lab, p, both in _RULES]
    empty = spark.createDataFrame([], "repo string, source string, target string, type string, label string, protocol string, port long, bidirectional boolean, stage int, at struct<k0:string,k1:string,k2:string,k3:string>")
    return multirepo.cross_edges(spark, rules, empty).select("source", "target", "type", "label", "port", "bidirectional")


@query("""
select 'repo:n' || (l_suppkey % 25) as source, 'repo:n' || (l_partkey % 25) as target, case when l_returnflag = 'R' then 'import' else 'http' end as type, case when l_returnflag = 'R' then 'import' end as protocol, l_linestatus as label,
  case when l_quantity > 25 then cast(l_quantity as bigint) end as port, l_tax > 0.04 as bidirectional from lineitem where l_linenumber = 7
""")
def cross_edges_of_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between repositories by rules in a table, as many as it has."""
    rows = _read(spark, sf_dir, "lineitem").where("l_linenumber = 7")
    node = lambda c: F.concat(F.lit("n"), (F.col(c) % 25).cast("string"))
    rules = rows.select(node("l_suppkey").alias("source_repo"), node("l_partkey").alias("target_repo"), F.when(F.col("l_returnflag") == "R", "import").alias("type"), F.col("l_linestatus").alias("label"), F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("long")).alias("port"), (F.col("l_tax") > 0.04).alias("bidirectional"), F.col("l_orderkey").alias("i"))
    empty = spark.createDataFrame([], "source string, target string, type string, protocol string, label string, port long, bidirectional boolean")
    return multirepo.cross_edges(spark, rules, empty)


# --- search with errors ---------------------------------------------------------------------------------------

_PHRASES = "select distinct w as phrase from (select unnest([p_name, substr(p_name, 1, 2) || substr(p_name, 4), lower(p_brand)]) as w from part)"


@query(f"""
with x as ({_SEARCHED}), ph as ({_PHRASES}), p as (select phrase, cast(length(phrase) as integer) as m, greatest(least(cast(floor(length(phrase) * 0.4) as integer), cast((length(phrase) - 2) // 2 as integer)), 0) as k from ph where length(phrase) >= 2),
f as (select distinct lower(t) as text from (select unnest([name, path, kind]) as t from x) where t is not null),
d as (select phrase, text, m, min(levenshtein(substr(text, i, l), phrase)) as edits, any_value(k) as k from p, f, range(1, 64) as a(i), range(0, 64) as b(l) where i + l - 1 <= length(text) and l between m - k and m + k group by phrase, text, m),
e as (select phrase, text, cast(edits as double) / m + cast(0.1 as double) * (1 - least(cast(m as double) / length(text), 1)) as far from d where edits <= k),
s as (select e.phrase, x.type, x.id, e.far as score from x join e on e.text = lower(x.name) union all select e.phrase, x.type, x.id, e.far * cast(1.1 as double) + cast(1.1 as double) - 1 from x join e on e.text = lower(x.path) union all select e.phrase, x.type, x.id, e.far * cast(1.2 as double) + cast(1.2 as double) - 1 from x join e on e.text = lower(x.kind)),
b as (select phrase, type, id, round(min(score), 6) as score from s group by phrase, type, id)
select phrase, cast(row_number() over (partition by phrase order by score, type, id) as integer) as rank, type, id, score from b qualify rank <= 20
""")
def phrases_searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best hits of every name and brand of a part, also with a letter left out, in suppliers and parts: one search in a stored index."""
    s, p = _read(spark, sf_dir, "supplier"), _read(spark, sf_dir, "part")
    key = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    a = s.select(F.lit("component").alias("type"), key("s", "s_suppkey").alias("id"), F.col("s_name").alias("name"), key("supplier/", "s_suppkey").alias("path"), F.lit("module").alias("kind"))
    b = p.select(F.lit("symbol").alias("type"), key("p", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("path"), F.col("p_type").alias("kind"))
    shorter = F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 4)"))
    phrases = p.select(F.explode(F.array("p_name", shorter, F.lower("p_brand"))).alias("phrase"))
    return textsearch.search(textsearch.build(a.unionByName(b)), phrases, 20)


@query("select url as path from pages where contains(lower(url), 'example') and contains(lower(url), '/en/')")
def matching_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose paths have two given parts, in any case."""
    rows = _read(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    return views.matching_files(views.matching_files(rows, "EXAMPLE"), "/En/").select("path")


# --- screens: nations are apps, customers are views ----------------------------------------------------------

_SWIFT_TABS = "@main\nstruct Main{n}App: App {\n  var body: some Scene {\n    TabView {\n      A{n}View()\n        .tabItem { Label(\"Home\", x) }\n      B{n}View()\n        .tabItem { Label(\"My Items\", x) }\n    }\n  }\n}\nstruct A{n}View: View {\n  var body: some View {\n    NavigationLink(destination: V{a}View()) { }\n  }\n}\nstruct B{n}View: View {\n  var body: some View {\n    Text(\"x\").sheet(isPresented: $y) { V{b}View() }\n  }\n}\n"
_SWIFT_VIEW = "struct {v}: View {\n  var body: some View {\n    NavigationLink(destination: V{a}View()) { Text(\"{ }\") }\n    Button(\"x\") { }\n      .fullScreenCover(isPresented: $z) { V{b}View() }\n  }\n}\n"


def _shaped(shape: str, **columns):
    parts = re.split(r"\{(v|n|a|b)\}", shape)
    return F.concat(*[columns[x].cast("string") if j % 2 else F.lit(x) for j, x in enumerate(parts)])


def _screen_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n, c = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    app = lambda k: F.concat(F.lit("n"), F.col(k).cast("string"))
    comps = n.select(F.lit("all").alias("repo"), app("n_nationkey").alias("id"), app("n_nationkey").alias("path"), F.lit("ios-client").alias("type"), F.lit("SwiftUI").alias("framework"))
    k = F.col("n_nationkey")
    mains = n.select(F.lit("all").alias("repo"), app("n_nationkey").alias("owner"), F.concat(app("n_nationkey"), F.lit("/Views/App.swift")).alias("path"), _shaped(_SWIFT_TABS, n=k, a=k * 3 + 1, b=k * 5 + 2).alias("content"))
    name = F.when(key % 7 == 3, F.concat(F.lit("Item"), key.cast("string"), F.lit("Row"))).otherwise(F.concat(F.lit("V"), key.cast("string"), F.lit("View")))
    view = c.select(F.lit("all").alias("repo"), app("c_nationkey").alias("owner"), F.concat(app("c_nationkey"), F.lit("/Views/c"), F.lpad(key.cast("string"), 9, "0"), F.lit(".swift")).alias("path"), _shaped(_SWIFT_VIEW, v=name, a=key * 2 % 60, b=(key * 3 + 1) % 90).alias("content"))
    return comps, mains.unionByName(view)


_SCREENS_SQL = """apps as (select n_nationkey as app from nation),
v as (select c_nationkey as app, case when c_custkey % 7 = 3 then 'Item' || c_custkey || 'Row' else 'V' || c_custkey || 'View' end as view, c_custkey % 7 = 3 as helper, 'V' || (c_custkey * 2 % 60) || 'View' as push, 'V' || ((c_custkey * 3 + 1) % 90) || 'View' as modal, 'fullscreen' as how from customer
  union all select app, 'A' || app || 'View', false, 'V' || (app * 3 + 1) || 'View', null, null from apps union all select app, 'B' || app || 'View', false, null, 'V' || (app * 5 + 2) || 'View', 'sheet' from apps),
leads as (select app, view, push as target from v where push is not null union select app, view, modal from v where modal is not null),
tabs as (select app, 0 as k, 'A' || app || 'View' as view, 'home' as slug from apps union all select app, 1, 'B' || app || 'View', 'my-items' from apps),
walk as (select app, k, view, 0 as hops from tabs union select w.app, w.k, l.target, w.hops + 1 from walk w join leads l on l.app = w.app and l.view = w.view where w.hops < 40 and exists (select 1 from v where v.app = w.app and v.view = w.view)),
far as (select app, view, arg_min(k, row(hops, k)) as k from walk where hops > 0 group by app, view),
screens as (select v.app, v.view, case when t.slug is not null then 'n' || v.app || '/__ui__/tab-' || t.slug else 'n' || v.app || '/__ui__/' || lower(v.view) end as id, t.slug is not null as tab from v left join tabs t on t.app = v.app and t.view = v.view where not helper)"""


@query(f"""
with recursive {_SCREENS_SQL}
select id, case when tab then case when id like '%home' then 'Home' else 'My Items' end else regexp_replace(regexp_replace(s.view, 'View$', ''), '([a-z])([A-Z])', '\\1 \\2', 'g') end as name, case when tab then 'tab' else 'screen' end as type,
  case when tab then 'n' || s.app || '/__ui__/tab-bar' else 'n' || s.app || '/__ui__/tab-' || case when coalesce(f.k, 0) = 0 then 'home' else 'my-items' end end as parent from screens s left join far f on f.app = s.app and f.view = s.view
union all select 'n' || app || '/__ui__/tab-bar', 'Tab Bar', 'tab-container', 'n' || app from apps
""")
def app_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab bars, tabs and screens of apps; a screen belongs to the tab that reaches it first."""
    return uiflow.ui_flows(*_screen_tables(spark, sf_dir))[0].select("id", "name", "type", "parent")


@query(f"""
with recursive {_SCREENS_SQL}
select a.id as source, b.id as target, 'navigation' as type, null as label from v join screens a on a.app = v.app and a.view = v.view join screens b on b.app = v.app and b.view = v.push
union all select a.id, b.id, 'modal', v.how from v join screens a on a.app = v.app and a.view = v.view join screens b on b.app = v.app and b.view = v.modal
union all select 'n' || app || '/__ui__/tab-bar', 'n' || app || '/__ui__/tab-' || slug, 'tab', case k when 0 then 'Home' else 'My Items' end from tabs
""")
def app_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How screens lead to each other."""
    return uiflow.ui_flows(*_screen_tables(spark, sf_dir))[1].select("source", "target", "type", "label")


@query(f"""
with recursive {_SCREENS_SQL}, t as ({_TREE}), te as ({_TREE_EDGES})
select source, target, type, cast(1 as integer) as stage from te
union all select a.id, b.id, 'navigation', 12 from v join screens a on a.app = v.app and a.view = v.view join screens b on b.app = v.app and b.view = v.push
union all select a.id, b.id, 'modal', 12 from v join screens a on a.app = v.app and a.view = v.view join screens b on b.app = v.app and b.view = v.modal
union all select 'n' || app || '/__ui__/tab-bar', 'n' || app || '/__ui__/tab-' || slug, 'tab', 12 from tabs
""")
def edges_with_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between components with those between screens behind them."""
    none = lambda kind: F.lit(None).cast(kind)
    place = F.struct(*[F.lit("").alias(f"k{i}") for i in range(4)])
    own = _tree_edges(spark, sf_dir).select(F.lit("all").alias("repo"), "source", "target", "type", none("string").alias("label"), none("string").alias("protocol"), none("long").alias("port"), F.lit(False).alias("bidirectional"), F.lit(1).alias("stage"), place.alias("at"))
    return relationships.with_screens(own, uiflow.ui_flows(*_screen_tables(spark, sf_dir))[1]).select("source", "target", "type", "stage")
