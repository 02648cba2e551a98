"""Merkle manifests of datasets by mountain ranges.

Rows of a group are leaves in order of their key. Every ``FANOUT`` consecutive nodes of a level become
one node of the next, the last run fewer, even one, without padding, until one is left: the group's
subroot. Subroots in order of their groups are the leaves of a tree of their own, whose top is the root.
A node is the lower-case hex SHA-256 of its children's hex texts, one after the other.

1. Leaves are hashed in the JVM (``leaves_of``) and stored: a digest of 32 bytes stands for a row from there on.
2. ``indexed`` deals them by ranges of (group, key) to parts of about ``PART_ROWS``, stored in order with their
   place; counts of (part, group) give each leaf its gapless index in the group. A group with most
   rows lies in many parts.
3. Each part goes through its leaves with a stack of one short list a level (``Mountains``): a list that is full
   at an aligned index becomes a node and carries into the next level. Nodes that a part completes leave it as
   records; what is left over at its two unaligned edges, at most seven nodes a level and side, are its peaks.
4. ``merged`` joins the peaks of neighbouring parts, level by level from below: each level is an aggregate of
   at most eight children a parent, over some peaks a part, and never over leaves. Short last runs end here.
5. For proofs each part gets, besides its own leaves, the nodes next to its edges that it cannot know (at
   most 16 a level), and hashes its own nodes again.

Cases: null groups come first, other groups by their bytes; null keys come first in their group; rows that
repeat a key are ordered by their digests, so that the root does not depend on the order of reading, and
equal rows are leaves each; nulls and empty texts have leaves like others ("-" and "0:"), of texts of
any length; a null id has the checksum of no bytes. An empty table has no rows and no root. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, read, spread
from .sharding import CRC

FANOUT = 8
#: Leaves of a part, about; a part is 10 MB then.
PART_ROWS = 100_000
#: Runs of leaves (part, group) that may be broadcast: 50 bytes each.
FEW = 200_000

#: A node: its group, level (leaves: 0), index in the level, the group's leaves, and whether it waits for a neighbouring part.
NODE = "grp string, level int, at long, n long, digest binary, edge boolean"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def framed(value: Column) -> Column:
    """A value as its count of UTF-8 bytes, a colon and itself; null is a hyphen."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest_of(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[framed(c) for c in columns]).cast("binary"), 256))


def group_of(value: Column) -> Column:
    """The group as a text that sorts null first and others by their bytes."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def leaves_of(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, leaf, changed): changed is the leaf of a tampered row, else null."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    head = [doc_id, F.col("source"), F.col("lang"), F.col("n_chars")]
    tampered = F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 0
    return spread(docs).select(group_of(F.col("lang")).alias("grp"), doc_id.alias("doc_id"), digest_of([*head, text]).alias("leaf"), F.when(tampered, digest_of([*head, F.translate(text, UPPER, LOWER)])).alias("changed"))


def joined(digests: list[bytes]) -> bytes:
    return sha256(b"".join(digests).hex().encode()).digest()


class Mountains:
    """A run of consecutive nodes, given from left to right, as the peaks of a mountain range.

    records: what is complete, (level, index, digest, edge). A node that no parent in the run takes up is an edge.
    """

    def __init__(self, first: int, fanout: int = FANOUT):
        self.fanout = fanout
        self.start: list[int] = [first]  # of each level: the index of the first node held back
        self.held: list[list[bytes]] = [[]]
        self.records: list[tuple[int, int, bytes, bool]] = []

    def add(self, digests: list[bytes], level: int = 0) -> None:
        held, f = self.held[level], self.fanout
        held += digests
        if skip := min(-self.start[level] % f, len(held)):  # the unaligned left edge: its parent lies partly in another run
            self.records += [(level, self.start[level] + k, d, True) for k, d in enumerate(held[:skip])]
            self.start[level] += skip
            del held[:skip]
        full = len(held) // f * f
        if not full:
            return
        at = self.start[level]
        if level:
            self.records += [(level, at + k, d, False) for k, d in enumerate(held[:full])]
        parents = [joined(held[k : k + f]) for k in range(0, full, f)]
        del held[:full]
        self.start[level] = at + full
        if level + 1 == len(self.held):
            self.held.append([])
            self.start.append(at // f)
        self.add(parents, level + 1)

    def end(self) -> list[tuple[int, int, bytes, bool]]:
        """All records; what is held back are the peaks."""
        for level, (start, held) in enumerate(zip(self.start, self.held, strict=True)):
            self.records += [(level, start + k, d, True) for k, d in enumerate(held)]
            held.clear()
        return self.records


def _climbed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each run of consecutive leaves (part, grp, at, n, digest); a task may get several parts."""
    now, part, group, size, due = None, None, None, 0, 0

    def given() -> pa.RecordBatch:
        records, now.records = now.records, []
        columns = list(zip(*records, strict=True)) or [[]] * 4
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.bool_())
        level, at, digest, edge = (pa.array(c, t) for c, t in zip(columns, kinds, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([group] * len(records), pa.string()), level, at, pa.array([size] * len(records), pa.int64()), digest, edge], names=["grp", "level", "at", "n", "digest", "edge"])

    for b in batches:
        parts, groups, at, sizes, digests = (b.column(c).to_pylist() for c in ("part", "grp", "at", "n", "digest"))
        k = 0
        while k < len(at):
            if now is None or parts[k] != part or groups[k] != group or at[k] != due:
                if now is not None:
                    now.end()
                    yield given()
                now, part, group, size = Mountains(at[k]), parts[k], groups[k], sizes[k]
            end = k + 1
            while end < len(at) and parts[end] == part and groups[end] == group and at[end] == at[end - 1] + 1:
                end += 1
            now.add(digests[k:end])
            due, k = at[end - 1] + 1, end
        if now is not None:
            yield given()
    if now is not None:
        now.end()
        yield given()


def indexed(rows: DataFrame, order: list[str], part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows with part, at and n; runs): the place of each row in its group ``grp`` by ``order``, and the group's size.

    runs has a row for each part and group: (part, grp, first, last, n), the places of its rows. Neither a group nor
    rows that are equal in everything need fit in a part.
    """
    spark = rows.sparkSession
    tie = "__tie"
    stored = cut(rows.withColumn(tie, F.monotonically_increasing_id()), "leaves")
    n = stored.count()
    parts = max(1, -(-n // part_rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // FANOUT**3))
    by = [F.col(c).asc_nulls_first() for c in ("grp", *order, tie)]
    dealt = stored.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop(tie)
    placed = cut(dealt.withColumn("__at", F.monotonically_increasing_id()), "placed")  # the part's number and the place in it
    placed = placed.withColumn("part", F.shiftright("__at", 33))
    runs = placed.groupBy("part", "grp").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("m"))
    of = Window.partitionBy("grp")
    before = F.sum("m").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = cut(runs.select("part", "grp", "__first", F.coalesce(before, F.lit(0)).alias("first"), (F.coalesce(before, F.lit(0)) + F.col("m") - 1).alias("last"), F.sum("m").over(of).alias("n")), "runs")
    bases = runs.select("part", "grp", "__first", "first", "n")
    ranked = placed.join(F.broadcast(bases) if bases.count() <= FEW else bases, ["part", "grp"])
    return ranked.withColumn("at", F.col("__at") - F.col("__first") + F.col("first")).drop("__at", "__first", "first"), runs.drop("__first")


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of longs that are not negative."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def width_of(level: Column) -> Column:
    """How many leaves a whole node of a level stands for."""
    return F.pow(F.lit(float(FANOUT)), level).cast("long")


def nodes_of(level: Column, n: str = "n") -> Column:
    """How many nodes a level has in a tree of n leaves."""
    return _div(F.col(n) + width_of(level) - 1, width_of(level))


@dataclass
class Manifest:
    """A forest of trees: leaves with their places, runs of parts, all inner nodes, and the nodes at edges of parts."""

    leaves: DataFrame
    runs: DataFrame
    nodes: DataFrame
    edges: DataFrame
    height: int

    def tops(self) -> DataFrame:
        """(grp, n, digest) of each group's subroot."""
        return self.edges.where((F.col("at") == 0) & (nodes_of(F.col("level")) == 1)).select("grp", "n", "digest")


def height_of(n: int) -> int:
    level = 0
    while n > 1:
        n, level = -(-n // FANOUT), level + 1
    return level


def merged(found: DataFrame, height: int) -> DataFrame:
    """The nodes that peaks of several parts, or short last runs, make; found: NODE records of all parts."""
    waiting, made = found.where("edge"), None
    now = waiting.where("level = 0")
    for level in range(height):
        open_ = now.where(nodes_of(F.lit(level)) > 1)
        children = F.sort_array(F.collect_list(F.struct("at", "digest")))  # FANOUT at most
        text = F.array_join(F.transform(children, lambda c: F.lower(F.hex(c["digest"]))), "")
        parents = open_.groupBy("grp", "n", _div(F.col("at"), F.lit(FANOUT)).alias("up")).agg(F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
        own = cut(parents.select("grp", F.lit(level + 1).alias("level"), F.col("up").alias("at"), "n", "digest", F.lit(True).alias("edge")), "merged")
        made = own if made is None else made.unionByName(own)
        now = own.unionByName(waiting.where(F.col("level") == level + 1))
    return made if made is not None else found.limit(0)


def manifest(rows: DataFrame, order: list[str], digest: str = "leaf", part_rows: int = PART_ROWS) -> Manifest:
    """The trees of rows (grp, digest, ...), one a group, with leaves by ``order`` and then by digest."""
    leaves, runs = indexed(rows, [*order, digest], part_rows)
    bound_batches(rows.sparkSession)
    inputs = leaves.select("part", "grp", "at", "n", F.col(digest).alias("digest")).sortWithinPartitions("part", "grp", "at")
    found = cut(inputs.mapInArrow(_climbed, NODE), "nodes")
    height = height_of(runs.agg(F.max("n")).first()[0] or 0)
    made = merged(found, height)
    return Manifest(leaves, runs, found.where("level > 0").unionByName(made), found.where("edge").unionByName(made), height)


def _wanted(runs: DataFrame, height: int) -> DataFrame:
    """(part, grp, level, at) of the nodes that a part needs for the proofs of its leaves and that are not complete in it."""
    every = runs.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(height)))).withColumn("width", width_of(F.col("level"))).withColumn("count", nodes_of(F.col("level")))
    every = every.where((F.col("level") == 0) | (nodes_of(F.col("level") - 1) > 1))
    low, high = _div(F.col("first"), F.col("width")), _div(F.col("last"), F.col("width"))
    group = lambda c: _div(c, F.lit(FANOUT)) * FANOUT
    every = every.withColumn("lo", group(low)).withColumn("hi", F.least(group(high) + FANOUT - 1, F.col("count") - 1))
    # Complete in the part: [own, end).
    every = every.withColumn("own", _div(F.col("first") + F.col("width") - 1, F.col("width"))).withColumn("end", _div(F.col("last") + 1, F.col("width")))
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    outside = F.when(F.col("own") >= F.col("end"), span(F.col("lo"), F.col("hi"))).otherwise(F.concat(span(F.col("lo"), F.col("own") - 1), span(F.col("end"), F.col("hi"))))
    return every.select("part", "grp", "level", F.explode(outside).alias("at"))


#: A digest that a part is given: of the group's tree (0) or the tree of subroots (1).
GIVEN = "part long, grp string, tree int, level int, at long, digest binary, top_at long, top_n long"
PROVEN = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def siblings(nodes: dict[int, bytes], at: int, count: int) -> tuple[bytes, bytes]:
    """The hex texts of a node's siblings left and right of it; count: nodes of its level."""
    first = at // FANOUT * FANOUT
    run = [nodes[k].hex().encode() for k in range(first, min(first + FANOUT, count))]
    return b"".join(run[: at - first]), b"".join(run[at - first + 1 :])


def path_of(levels: list[dict[int, bytes]], at: int, n: int, start: int = 0) -> list[tuple[bytes, bytes]]:
    """The siblings on the way from leaf ``at`` to the top of a tree of n leaves, from level ``start`` on."""
    return [siblings(levels[level], at // FANOUT**level, -(-n // FANOUT**level)) for level in range(start, height_of(n))]


def folded(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The hex digest at the end of a path."""
    text = digest.hex().encode()
    for left, right in path:
        text = sha256(left + text + right).hexdigest().encode()
    return text


def _proven(leaves: pa.Table, given: pa.Table) -> pa.Table:
    """The proofs of a part's leaves."""
    outside: dict[tuple[str, int], list[dict[int, bytes]]] = {}
    tops: dict[str, tuple[int, int]] = {}
    for row in given.to_pylist():
        levels = outside.setdefault((row["grp"], row["tree"]), [])
        while len(levels) <= row["level"]:
            levels.append({})
        levels[row["level"]][row["at"]] = row["digest"]
        if row["tree"]:
            tops[row["grp"]] = row["top_at"], row["top_n"]
    rows = leaves.sort_by([("grp", "ascending"), ("at", "ascending")])
    groups, at, sizes, ids, own, changed = (rows.column(c).to_pylist() for c in ("grp", "at", "n", "doc_id", "leaf", "changed"))
    out: list[list] = [[] for _ in PROVEN.split(",")]
    first = 0
    while first < len(at):
        end = first
        while end < len(at) and groups[end] == groups[first]:
            end += 1
        group, n = groups[first], sizes[first]
        levels = outside.get((group, 0), [])
        levels += [{} for _ in range(height_of(n) + 1 - len(levels))]
        range_ = Mountains(at[first])
        range_.add(own[first:end])
        levels[0].update(zip(at[first:end], own[first:end], strict=True))
        for level, k, digest, _ in range_.end():
            levels[level][k] = digest
        place, count = tops[group]
        above = path_of(outside[group, 1], place, count)
        subroot = levels[height_of(n)][0].hex()
        root = outside[group, 1][height_of(count)][0].hex()
        upper, upper_of = [], -1
        for k in range(first, end):
            if at[k] // FANOUT != upper_of:
                upper_of, upper = at[k] // FANOUT, [*path_of(levels, at[k], n, 1), *above]
                joined_upper = b"".join(x for pair in upper for x in pair)
            low = [siblings(levels[0], at[k], n)] if n > 1 else []
            proof = sha256(b"".join(x for pair in low for x in pair) + joined_upper).hexdigest()
            end_text = folded(own[k] if changed[k] is None else changed[k], [*low, *upper]).decode()
            for column, value in zip(out, (ids[k], own[k].hex(), subroot, root, proof, end_text, end_text == root), strict=True):
                column.append(value)
        first = end
    kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
    return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[c.split()[0] for c in PROVEN.split(",")])


def proofs(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (grp, doc_id, leaf, changed)."""
    trees = manifest(rows, ["doc_id"], "leaf", part_rows)
    top = manifest(trees.tops().select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("digest").alias("leaf")), ["name"], "leaf", part_rows)
    edges = trees.edges.select("grp", "level", "at", "digest")
    inner = _wanted(trees.runs, trees.height).join(edges, ["grp", "level", "at"]).select("part", "grp", F.lit(0).alias("tree"), "level", "at", "digest", F.lit(0).cast("long").alias("top_at"), F.lit(0).cast("long").alias("top_n"))
    # Each group's way in the tree of subroots: whole runs, level by level. Every such node is a leaf or an inner node of that tree.
    every = top.leaves.select(F.lit(0).alias("level"), "at", F.col("leaf").alias("digest")).unionByName(top.nodes.select("level", "at", "digest"))
    ways = trees.runs.select("part", "grp").join(top.leaves.select(F.col("name").alias("grp"), F.col("at").alias("top_at"), F.col("n").alias("top_n")), "grp")
    ways = ways.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top.height))))
    first = _div(F.col("top_at"), width_of(F.col("level") + 1)) * FANOUT
    ways = ways.withColumn("at", F.explode(F.sequence(first, F.least(first + FANOUT - 1, nodes_of(F.col("level"), "top_n") - 1))))
    outer = ways.join(every, ["level", "at"]).select("part", "grp", F.lit(1).alias("tree"), "level", "at", "digest", "top_at", "top_n")
    given = cut(inner.unionByName(outer), "given")
    left = trees.leaves.select("part", "grp", "at", "n", "doc_id", "leaf", "changed")
    return left.groupBy("part").cogroup(given.groupBy("part")).applyInArrow(_proven, PROVEN)


def op11_mountain_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of all documents by language, and each document's proof against a tampered copy."""
    return proofs(leaves_of(read(spark, sf_dir, "documents")))


def _oracle(levels: int = 7, tops: int = 3) -> str:
    """SQL level by level, for up to 8^levels rows a language and 8^tops languages."""
    value = lambda x: f"case when {x} is null then '-' else octet_length(encode(cast({x} as varchar))) || ':' || {x} end"
    leaf = lambda text: f"sha256({' || '.join(map(value, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    sides = """coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') as lo,
    coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') as hi, count(*) over (partition by g) as c"""

    def climb(name: str, first: str, count: int) -> list[str]:
        """Tables name0 to nameN: the nodes of each level with the texts of their siblings left and right."""
        made = [f"{name}0 as materialized (select g, i, h, {sides} from {first} window w as (partition by g, i // 8 order by i))"]
        for k in range(count):
            up = f"(select g, i // 8 as i, sha256(string_agg(h, '' order by i)) as h from {name}{k} where c > 1 group by g, i // 8)"
            made.append(f"{name}{k + 1} as materialized (select g, i, h, {sides} from {up} window w as (partition by g, i // 8 order by i))")
        return made

    def walk(name: str, first: str, nodes: str, group: str, at: str, count: int) -> list[str]:
        """Tables name0 to nameN: siblings met and digest folded up to each level."""
        made, last = [], first
        for k in range(count):
            step = f"p.sib || case when a.c > 1 then a.lo || a.hi else '' end as sib, case when a.c > 1 then sha256(a.lo || p.x || a.hi) else p.x end as x"
            made.append(f"{name}{k} as materialized (select p.* exclude (sib, x), {step} from {last} p left join {nodes}{k} a on a.g = p.{group} and a.i = p.{at} // {FANOUT**k})")
            last = f"{name}{k}"
        return made

    steps = [
        "t as materialized (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i)) as crc)",
        f"d as materialized (select doc_id, coalesce('=' || lang, '') as g, {leaf('text')} as h, case when {CRC.format("coalesce(cast(doc_id as varchar), '')")} % 3 = 0 then {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} else {leaf('text')} end as x from documents, t)",
        "l as materialized (select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 as i from d)",
        *climb("a", "l", levels),
        "s as materialized (select g as name, '' as g, h, row_number() over (order by g) - 1 as i from (" + " union all ".join(f"select g, h from a{k} where c = 1" for k in range(levels + 1)) + "))",
        *climb("b", "s", tops),
        "r as materialized (" + " union all ".join(f"select h from b{k} where c = 1" for k in range(tops + 1)) + ")",
        "p as materialized (select l.doc_id, l.h as leaf, l.g, l.i, s.i as top, '' as one, s.h as subroot, '' as sib, l.x from l join s on s.name = l.g)",
        *walk("u", "p", "a", "g", "i", levels),
        *walk("v", f"u{levels - 1}", "b", "one", "top", tops),
    ]
    return f"with {', '.join(steps)} select doc_id, leaf, subroot, r.h as root, sha256(sib) as proof_sha256, x as folded_root, x = r.h as verified from v{tops - 1}, r"


ORACLE = _oracle()
