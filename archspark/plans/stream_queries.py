"""Queries on streams: the rows that hold after batches of changes, with SQL over all that was said."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import fresh_path
from ..streaming import edits, totals
from .registry import _map_text, _read, query
from .written import choice, choice_sql

# --- customers as files, orders as what changes them ------------------------------------------------

_LANGUAGES = ["go", "rust", "swift"]


def _customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return _read(spark, sf_dir, "customer").select(
        F.concat(F.lit("r"), nation % 3).alias("repo"), F.concat(F.lit("f"), key).alias("path"), F.concat(F.lit("o"), nation).alias("owner"), choice(_LANGUAGES, "c_custkey").alias("language"),
        (key % 50 + 1).cast("long").alias("lines"), F.floor(F.abs("c_acctbal")).cast("long").alias("size_bytes"), (key % 4).cast("long").alias("n_symbols"), F.lit(False).alias("deleted"), F.lit(-1).cast("long").alias("seq"),
    )


def _order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order changes its customer's file, moves it to another component, or deletes it."""
    key = F.col("o_orderkey")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return _read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("r"), F.col("c_nationkey") % 3).alias("repo"), F.concat(F.lit("f"), "c_custkey").alias("path"), F.concat(F.lit("o"), key % 25).alias("owner"), choice(_LANGUAGES, "o_orderkey").alias("language"),
        (key % 97 + 1).cast("long").alias("lines"), F.floor("o_totalprice").cast("long").alias("size_bytes"), (key % 5).cast("long").alias("n_symbols"), (key % 11 == 0).alias("deleted"), key.cast("long").alias("seq"),
    )


_HELD = f"""
with e as (select 'r' || (c_nationkey % 3) as repo, 'f' || c_custkey as path, 'o' || c_nationkey as owner, {choice_sql(_LANGUAGES, 'c_custkey')} as language, c_custkey % 50 + 1 as lines, cast(floor(abs(c_acctbal)) as bigint) as size_bytes, c_custkey % 4 as n_symbols, false as deleted, -1 as seq from customer
union all select 'r' || (c_nationkey % 3), 'f' || c_custkey, 'o' || (o_orderkey % 25), {choice_sql(_LANGUAGES, 'o_orderkey')}, o_orderkey % 97 + 1, cast(floor(o_totalprice) as bigint), o_orderkey % 5, o_orderkey % 11 = 0, o_orderkey from orders join customer on o_custkey = c_custkey),
k as (select *, row_number() over (partition by repo, path order by seq desc) as place from e), f as (select * from k where place = 1 and not deleted)
"""


def _measured_sql(level: str, keys: str, owner: str) -> str:
    return f"""select '{level}' as level, a.repo, {owner} as owner, a.files, a.lines, a.size_bytes, a.symbols, b.languages, b.main_language from
(select {keys}, count(*) as files, cast(sum(lines) as bigint) as lines, cast(sum(size_bytes) as bigint) as size_bytes, cast(sum(n_symbols) as bigint) as symbols from f group by {keys}) a join
(select {keys}, string_agg(language || '=' || l, ',' order by language) as languages, first(language order by l desc, p) as main_language from (select {keys}, language, cast(sum(lines) as bigint) as l, min(path) as p from f group by {keys}, language) group by {keys}) b using ({keys})"""


def _streamed(spark: SparkSession, kept, batches: list[DataFrame]) -> tuple[str, int]:
    """(folder, last batch) of a kept state after batches, each taken by a query that starts again where the one before it ended."""
    source, out, checkpoint = (fresh_path(spark, f"stream-{x}") for x in ("events", "held", "checkpoint"))
    for rows in batches:
        rows.write.mode("append").parquet(source)
        kept.keep(spark.readStream.schema(kept.EVENT).parquet(source), out, checkpoint).awaitTermination()
    return out, len(batches) - 1


def _kept(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """Totals after two batches, customers and then all orders."""
    return _streamed(spark, totals, [_customer_files(spark, sf_dir), _order_changes(spark, sf_dir)])


@query(f"{_HELD} {_measured_sql('component', 'repo, owner', 'a.owner')} union all {_measured_sql('repository', 'repo', 'null')}")
def totals_kept_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, sums and languages of components and of repositories after a stream of files that come, change, move and go."""
    out, n = _kept(spark, sf_dir)
    shown = lambda df, level: df.withColumn("level", F.lit(level)).withColumn("languages", _map_text("languages"))
    whole = totals.repository_totals(spark, out, n).withColumn("owner", F.lit(None).cast("string"))
    return shown(totals.component_metrics(spark, out, n), "component").unionByName(shown(whole, "repository"))


@query(f"{_HELD} select language, cast(sum(lines) as bigint) as lines from f group by language")
def languages_kept_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each language over all repositories after the same stream."""
    return totals.language_lines(spark, *_kept(spark, sf_dir))


# --- documents that change --------------------------------------------------------------------------


def _document_files(spark: SparkSession, sf_dir: str, later: bool) -> DataFrame:
    """Documents as files of their source; later every seventh is gone, and of the others every third is in another one with a line more."""
    key, size = F.col("doc_id"), F.octet_length(F.coalesce("text", F.lit("")))
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    rows = _read(spark, sf_dir, "documents").where(F.lit(not later) | (key % 7 == 0) | (key % 3 == 0))
    return rows.select(
        F.lit("all").alias("repo"), key.cast("string").alias("path"), (F.lit("moved") if later else F.col("source")).alias("owner"), F.col("lang").alias("language"),
        (lines + int(later)).cast("long").alias("lines"), size.cast("long").alias("size_bytes"), (key % 5).cast("long").alias("n_symbols"), (F.lit(later) & (key % 7 == 0)).alias("deleted"), F.lit(int(later)).cast("long").alias("seq"),
    )


@query(f"""
with f as (select 'all' as repo, cast(doc_id as varchar) as path, case when doc_id % 3 = 0 then 'moved' else source end as owner, lang as language, len(string_split(coalesce(text, ''), chr(10))) + case when doc_id % 3 = 0 then 1 else 0 end as lines, strlen(coalesce(text, '')) as size_bytes, doc_id % 5 as n_symbols from documents where doc_id % 7 <> 0)
select repo, owner, files, lines, size_bytes, symbols, languages, main_language from ({_measured_sql('component', 'repo, owner', 'a.owner').replace(' from f ', ' from f where owner is not null and language is not null ')})
""")
def documents_kept_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, sums and languages of sources after a batch of all documents and a batch of those that move or go."""
    out, n = _streamed(spark, totals, [_document_files(spark, sf_dir, later) for later in (False, True)])
    return totals.component_metrics(spark, out, n).withColumn("languages", _map_text("languages"))


# --- annotations: events as additions, new texts, deletions and clearings ---------------------------

_ACTIONS = ["add", "add", "add", "update", "add", "delete", "add", "update"]
#: What an update or a deletion is about: an event some places before it.
_BACK = "event_id - event_id % 8 - 1"


def _annotation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, user = F.col("event_id"), F.col("user_id")
    action = F.when(key % 9973 == 9972, "clear").otherwise(choice(_ACTIONS, "event_id"))
    edit = action.isin("update", "delete")
    return _read(spark, sf_dir, "events").select(
        F.when(edit, F.expr(_BACK)).otherwise(key).cast("string").alias("id"), user.cast("string").alias("componentId"), F.when(F.col("event_type").isin("click", "view"), "component").otherwise("file").alias("targetType"),
        (user * 7 % 1000).cast("string").alias("targetId"), F.lit("").alias("targetName"), F.concat("event_type", F.lit(" "), key).alias("text"), F.col("ts").alias("createdAt"), action.alias("action"), key.alias("seq"),
    )


@query(f"""
with e as (select *, case when event_id % 9973 = 9972 then 'clear' else {choice_sql(_ACTIONS, 'event_id')} end as action, case when event_type in ('click', 'view') then 'component' else 'file' end as kind, cast(user_id as varchar) as own, cast(user_id * 7 % 1000 as varchar) as target, event_type || ' ' || event_id as said from events),
a as (select *, row_number() over (partition by kind, case when kind = 'component' then own else target end order by event_id desc) as place from e where action = 'add'),
u as (select {_BACK} as id, max(event_id) as seq, arg_max(said, event_id) as said from e where action = 'update' group by 1), d as (select {_BACK} as id, max(event_id) as seq from e where action = 'delete' group by 1)
select cast(a.event_id as varchar) as id, own as "componentId", kind as "targetType", target as "targetId", case when u.seq > a.event_id then u.said else a.said end as text
from a left join u on u.id = a.event_id left join d on d.id = a.event_id where place = 1 and coalesce(d.seq < a.event_id, true) and coalesce((select max(event_id) from e where action = 'clear') < a.event_id, true)
""")
def annotations_kept_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations that hold after a stream of events, of which those with odd places come first."""
    events = _annotation_events(spark, sf_dir)
    out, n = _streamed(spark, edits, [events.where("seq % 2 = 1"), events.where("seq % 2 = 0")])
    return edits.state(spark, out, n).select("id", "componentId", "targetType", "targetId", "text")
