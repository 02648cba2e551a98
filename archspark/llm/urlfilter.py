"""URL rules by sort-merge range joins, in DataFrame operations only.

The labels of a host, reversed and each followed by a dot, are its canonical key:
``example.com`` is ``com.example.``. A rule's host and all its subdomains are then the
keys that begin with the rule's key, an interval; so are the paths that begin with a rule's path. Intervals are nested or
disjoint, so that one sorted sweep finds those over each point: the active ones are a stack, and what opened last
before a point has that stack, but for what has closed since. ``last(...) over (order by key)`` hands it on, and a comparison
of prefixes drops what is closed.

1. A sweep over hosts gives each url the rule hosts around its host, from the outermost on (as many as the labels of a rule's host at most).
2. For each depth of rule hosts a sweep over paths, apart for each rule host: the rule that opened last carries the
   lengths and verdicts of the rules of its host whose paths its own begins with, and the longest of them that the url's
   path begins with is that host's. A host's rules are rows, never one list; a rule's own list has no more numbers than its path has letters.
3. The longest rule of all depths wins (host and path together, then host).

Sweeps are dealt out by salts: urls by a hash of the whole row, rules to every salt, and by rule host.
A host with most of the urls is spread like any other; a task's memory is a window's
current row. Rules are repeated once for each salt: N rules are N x 2 x shuffle partitions rows of the plan.

Cases: a null url, or one without ``://``, has empty host and path and no rule; the
verdict without a rule is ``allow``; a host's port and user info stay part of it, as it is
cut at ``/``, ``?``, ``#`` only; rules with equal host and path: ``block`` wins; rules with null or empty host or null path are none; repeated rows
are judged each; urls of any length are judged whole; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

#: (host, path, verdict). These are the rules of the fixed query.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; A-Z of the host in lower case."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, upper, lower), path


def host_key(host: Column) -> Column:
    """Labels in reverse order, a dot after each; the empty host has the empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as a table (host, path, verdict), from literals."""
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if not rules:
        return spark.sql("select '' as host, '' as path, '' as verdict where false")
    return spark.sql("select * from values " + ", ".join(f"({', '.join(map(quote, r))})" for r in rules) + " as t(host, path, verdict)")


def rule_hosts(rules: DataFrame) -> DataFrame:
    """(key, stack) for each rule host: the keys of all rule hosts around it and its own, from the outermost on."""
    keys = rules.select(host_key(F.col("host")).alias("key")).distinct()
    parts = F.split("key", r"\.", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "."), F.lit(".")))
    around = keys.select("key", F.explode(prefixes).alias("outer"))
    return around.join(keys.withColumnRenamed("key", "outer"), "outer").groupBy("key").agg(F.array_sort(F.collect_list("outer")).alias("stack"))  # as many as labels


def rule_paths(rules: DataFrame) -> DataFrame:
    """(host, path, chain) for each rule: chain has (size, verdict) of the rules of its host whose paths its path begins with."""
    sizes = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("sizes"))  # of one path's letters at most
    up = rules.join(sizes, "host").select("host", "path", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("size"))
    above = rules.select("host", F.col("path").alias("outer"), "verdict")
    met = up.withColumn("outer", F.expr("substring(path, 1, size)")).join(above, ["host", "outer"])
    return met.groupBy("host", "path").agg(F.array_sort(F.collect_list(F.struct("size", "verdict"))).alias("chain"))


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", salts: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of pages (page_id, url)."""
    salts = salts or 2 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rules = rules.where("host <> '' and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block over allow
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    points = urls.select(F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(salts)).cast("int").alias("salt"), host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "page_id", "host", "path")
    hosts = rule_hosts(rules)
    opens = hosts.select(every_salt, "key", F.lit(0).alias("kind"), "stack")
    running = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sweep = running(Window.partitionBy("salt").orderBy("key", "kind"))
    swept = points.unionByName(opens, allowMissingColumns=True).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    rule = "struct<size:int,host_size:int,host:string,path:string,verdict:string>"
    rows = swept.select("page_id", "host", "path", "salt", F.filter("stack", lambda s: F.col("key").startswith(s)).alias("stack"), F.lit(None).cast(rule).alias("best"))
    depths = hosts.agg(F.max(F.size("stack"))).first()[0] or 0
    chains = rule_paths(rules).withColumn("at", host_key(F.col("host"))).join(hosts.select(F.col("key").alias("at"), F.size("stack").alias("depth")), "at")
    for depth in range(1, depths + 1):
        starts = chains.where(F.col("depth") == depth).select(every_salt, "at", "path", F.lit(0).alias("kind"), F.struct("host", "path", "chain").alias("open"))
        events = rows.withColumns({"at": F.get("stack", F.lit(depth - 1)), "kind": F.lit(1)}).unionByName(starts, allowMissingColumns=True)
        sweep = running(Window.partitionBy("salt", "at").orderBy("path", "kind"))
        met = events.withColumn("open", F.last("open", ignorenulls=True).over(sweep)).where("kind = 1")
        longest = F.array_max(F.filter(F.col("open.chain"), lambda c: F.col("path").startswith(F.substring(F.col("open.path"), F.lit(1), c["size"]))))
        own = F.struct((F.length("open.host") + longest["size"]).alias("size"), F.length("open.host").alias("host_size"), F.col("open.host").alias("host"), F.substring(F.col("open.path"), F.lit(1), longest["size"]).alias("path"), longest["verdict"].alias("verdict"))
        fits = F.when(longest.isNotNull() & F.col("at").isNotNull(), own).cast(rule)
        rows = met.select("page_id", "host", "path", "salt", "stack", F.greatest("best", fits).alias("best"))
    return rows.select("page_id", "host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judged(read(spark, sf_dir, "pages"), rule_table(spark, RULES))


ORACLE = r"""
with u as (
  select page_id, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), h as (
  select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from u
), p as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h
), r(rhost, rpath, verdict) as (
  values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), m as (
  select p.page_id, p.host, p.path, r.rhost || r.rpath as rule, r.verdict,
    row_number() over (partition by p.page_id order by length(r.rhost || r.rpath) desc, length(r.rhost) desc) as k
  from p left join r on (p.host = r.rhost or ends_with(p.host, '.' || r.rhost)) and starts_with(p.path, r.rpath)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from m where k = 1
"""
