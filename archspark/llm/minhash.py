"""Near-duplicates by min-max hashing (Ji et al., "Min-Max Hash for Jaccard Similarity", 2013).

Under each of ``PERMUTATIONS`` permutations both the minimum and the maximum of a
document's shingle hashes are kept, so that 160 signature values take 80 hash
evaluations. The fraction of equal values is an unbiased estimate of the Jaccard
similarity with a variance below that of as many independent minima. 32 bands of five
values: a pair at 0.8 shares no band with probability (1 - 0.8^5)^32, about 3 in a million.

1. One pass over the texts gives each document the size and a 128-bit digest of its
   full set, its bands and its signature's low bytes.
2. Documents with equal sets are one class (a minimum by digest, aggregated before the
   shuffle), so that copies, however many, make no pairs.
3. Classes are dealt to buckets by band. In a bucket with two classes at least, estimates from
   the signatures join what may be similar (not below the threshold by over five standard
   deviations); a forest of these joins leaves the task, never all pairs. Their
   components are the groups in which alone links can be.
4. The full sets of classes in such groups are computed from the texts, once. Pairs of each
   group's smallest member with the others are confirmed on them, block by block of the group;
   most groups are one component then. In the others, components are compared with each other on full
   sets, until they are joined or every pair between them is refuted; again a forest leaves the task.

Large buckets and groups are compared block against block, in as many tasks as there are
pairs of blocks; a block has at most about ``BLOCK`` classes and ``BLOCK_SHINGLES`` shingles. Rows of hot
buckets and groups are dealt to all partitions where they meet their group's facts (``salted``). No bucket, group
or candidate list is capped. Links inside a component go unconfirmed, which can't change components.

A shingle is a 64-bit hash of its words' hashes, and those are values of polynomials modulo the
prime 2^61 - 1: two different words of n bytes are taken for one with a chance of about n / 2^61.

Cases: null texts and texts without words have an empty set, link with nothing and are
kept; texts shorter than a shingle have one shingle; null ids have no class of their
own: they get no component and are not kept; rows that repeat an id share its component,
each of their texts links with its own near-duplicates; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mix, read, row_slices, salted, shingle_sets, texts_of, utf8
from .graph import components

PERMUTATIONS = 80
ROWS = 5
BANDS = 2 * PERMUTATIONS // ROWS
#: Members of a bucket that one task compares with as many others.
BLOCK = 512
#: Shingles of full sets in a block: 16 MB.
BLOCK_SHINGLES = 2 << 20

FACTS = "doc_id long, n_shingles long, digest binary, bands array<long>, low binary"


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    raw = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (raw[:PERMUTATIONS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (raw[PERMUTATIONS:] >> np.uint64(32)).astype(np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """For each non-empty set its 80 minima, then its 80 maxima."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint32)
    a, b = _permutations()
    # Cut into runs of sets so that the permuted values stay in the cache.
    edges = [0, *np.flatnonzero(np.diff(starts // 32768)).astype(int) + 1, len(sets)]
    for first, end in zip(edges[:-1], edges[1:], strict=True):
        if first == end:
            continue
        stop = starts[end] if end < len(sets) else len(flat)
        x, at = flat[starts[first] : stop], starts[first:end] - starts[first]
        y = np.empty_like(x)
        for p in range(PERMUTATIONS):
            np.multiply(x, a[p], out=y)
            y += b[p]
            y ^= y >> np.uint32(15)
            out[first:end, p] = np.minimum.reduceat(y, at)
            out[first:end, PERMUTATIONS + p] = np.maximum.reduceat(y, at)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each set and band."""
    values = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)), values.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, r])
    return key.view(np.int64)


def _facts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = utf8(b.column(1))
            for first, end in row_slices(offsets):
                own = offsets[first : end + 1]
                sets = shingle_sets(raw[own[0] : own[-1]], own - own[0], width)
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                low: list = [None] * len(sets)
                digest: list = [None] * len(sets)
                if full:
                    signature = signatures([sets[i] for i in full])
                    keys, bytes_ = band_keys(signature), signature.astype(np.uint8)
                    for j, i in enumerate(full):
                        bands[i], low[i], digest[i] = keys[j], bytes_[j].tobytes(), hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                columns = [b.column(0)[first:end], pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "bands", "low"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = utf8(b.column(1))
            for first, end in row_slices(offsets):
                own = offsets[first : end + 1]
                sets = shingle_sets(raw[own[0] : own[-1]], own - own[0], width)
                whole = [s.tobytes() for s in sets]
                digest = [hashlib.blake2b(x, digest_size=16).digest() for x in whole]
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(whole, pa.binary())], names=["digest", "shingles"])

    return run


def _similar_enough(own: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets (sorted, distinct) are as similar to own as they should be."""
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    shared = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return 100 * shared >= percent * (len(own) + sizes - shared)


def _sets_of(t: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles").combine_chunks()]


def _to_first(percent: int):
    """Links of a group's first member with those of a block that are similar to it, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 2):
            rep, near, sets = t.column("rep").to_numpy(), t.column("near")[0].as_py(), _sets_of(t)
            others = np.flatnonzero(rep != near)
            if len(others):
                fits = others[_similar_enough(sets[int(np.flatnonzero(rep == near)[0])], [sets[o] for o in others], percent)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fits), near)), pa.array(rep[fits])], names=["u", "v"])

    return run


def chunks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, list[int]]]:
    """(rows, edges): runs of rows that are equal in the first ``keys`` columns, of sorted batches; run k is rows[edges[k] : edges[k + 1]]. A run may cross batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([*held, b]).combine_chunks()
        marks = np.zeros(table.num_rows - 1, bool)
        for k in range(keys):
            column = table.column(k).to_numpy()
            marks |= column[1:] != column[:-1]
        edges = [0, *(np.flatnonzero(marks) + 1).tolist()]
        if len(edges) > 1:
            yield table.slice(0, edges[-1]), edges
        held = table.slice(edges[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, [0, table.num_rows]


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of ``chunks`` one by one."""
    for table, edges in chunks(batches, keys):
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            yield table.slice(a, z - a)


def spread(side: np.ndarray, label: np.ndarray, similar: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that join rows as all similar pairs would; fewer than there are rows.

    side: 0 and 1 if only rows of different sides are to be compared, else all 0.
    label: rows with one label count as joined. similar(x, others): which others are similar to
    row x. What is joined already is not compared again: a tight group of n takes about
    n comparisons, and only what stays apart is compared pair by pair.
    """
    both = bool(side.any())
    order = np.argsort(label, kind="stable")
    edges = np.flatnonzero(np.diff(label[order])) + 1
    runs = np.split(order, edges)
    of = np.empty(len(label), np.int64)
    for k, run in enumerate(runs):
        of[run] = k
    fresh = np.ones(len(label), bool)
    links: list[tuple[int, int]] = []
    for run in runs:
        if not fresh[run[0]]:
            continue
        fresh[run] = False
        queue = run.tolist()
        while queue and fresh.any():
            x = queue.pop()
            others = np.flatnonzero(fresh & (side != side[x]) if both else fresh)
            if not len(others):
                continue
            for y in others[similar(x, others)]:
                if fresh[y]:
                    links.append((x, int(y)))
                    fresh[runs[of[y]]] = False
                    queue += runs[of[y]].tolist()
    return links


def _estimated(low: np.ndarray, size: np.ndarray, percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Which rows' estimates do not fall below the threshold by over five standard deviations."""
    share = percent / 100
    least = share - 5 * (share * (1 - share) / (2 * PERMUTATIONS)) ** 0.5

    def similar(x: int, others: np.ndarray) -> np.ndarray:
        same = (low[others] == low[x]).mean(axis=1)
        estimate = (same - 1 / 256) / (1 - 1 / 256)  # low bytes also agree by chance
        return (estimate >= least) & (100 * np.minimum(size[others], size[x]) >= percent * np.maximum(size[others], size[x]))

    return similar


def _alike(percent: int, exact: bool):
    """A forest of the similar pairs of block i and block j of a group: by estimate, or confirmed on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 3):
            rep, block = t.column("rep").to_numpy(), t.column("block").to_numpy()
            low = np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in t.column("low").combine_chunks()])
            estimated = similar = _estimated(low, t.column("n_shingles").to_numpy(), percent)
            if exact:
                sets = _sets_of(t)

                def similar(x: int, others: np.ndarray, sets=sets, estimated=estimated) -> np.ndarray:
                    keep = estimated(x, others)
                    some = np.flatnonzero(keep)
                    if len(some):
                        keep[some] = _similar_enough(sets[x], [sets[o] for o in others[some]], percent)
                    return keep

            label = t.column("component").to_numpy() if exact else np.arange(t.num_rows)
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            links = spread((block == j).astype(np.int8) if i != j else np.zeros(len(rep), np.int8), label, similar)
            if links:
                u, v = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(rep[u]), pa.array(rep[v])], names=["u", "v"])

    return run


def parts(members: Column, shingles: Column | int = 0) -> Column:
    """How many blocks a group is cut into."""
    return F.greatest(F.ceil(members / BLOCK), F.ceil(shingles / F.lit(BLOCK_SHINGLES))).cast("int")


def block_pairs(rows: DataFrame, key: str) -> DataFrame:
    """Rows with columns i, j and block: each group (key, cut into ``parts`` blocks) as pairs of blocks."""
    cut_up = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    each = cut_up.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    each = each.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return each.select(key, "i", "j", *[c for c in cut_up.columns if c not in (key, "parts")])


def by_run(rows: DataFrame, *keys: str) -> DataFrame:
    """Runs of keys in as many partitions as the session has: their work is not told by their bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)


def _forest(rows: DataFrame, key: str, percent: int, exact: bool) -> DataFrame:
    return cut(by_run(rows, key, "i", "j").mapInArrow(_alike(percent, exact), "u long, v long"), "forest")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of docs (doc_id, text): Jaccard similarity of at least percent / 100."""
    texts = texts_of(docs)
    facts = cut(texts.mapInArrow(_facts(width), FACTS), "facts")
    held = facts.where("digest is not null and doc_id is not null")
    classes = held.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("low").alias("low"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    banded = classes.select("rep", F.explode("bands").alias("key"))
    many = banded.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("m")).where("first <> last")
    members = block_pairs(salted(banded, many.select("key", "m", parts(F.col("m")).alias("parts")), "key", "m", BANDS * n, "rep").drop("m"), "key")
    lows = classes.select("rep", "n_shingles", "low")
    # Classes that estimates join: nothing else can be a link.
    near = cut(components(_forest(members.join(lows, "rep").select("key", "i", "j", "block", "rep", "n_shingles", "low"), "key", percent, False)).select(F.col("id").alias("rep"), F.col("component").alias("near")), "near")
    named = near.join(classes.select("rep", "digest", "id", "n_shingles"), "rep")
    sizes = named.groupBy("near").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("w")).select("near", "m", parts(F.col("m"), F.col("w")).alias("parts"))
    named = cut(salted(named, sizes, "near", "m", n, "rep").drop("m"), "named")
    wanted = texts.join(named.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    sets = wanted.mapInArrow(_sets(width), "digest binary, shingles binary").join(named.select("digest", "rep"), "digest")
    sets = cut(sets.select("rep", "shingles").dropDuplicates(["rep"]), "sets")  # an id may have several texts of one class
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    own = F.array(F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    to_first = named.select("near", "rep", F.explode(F.when(F.col("rep") == F.col("near"), every).otherwise(own)).alias("block")).join(sets, "rep")
    links = cut(by_run(to_first.select("near", "block", "rep", "shingles"), "near", "block").mapInArrow(_to_first(percent), "u long, v long"), "links")
    comp = cut(components(links).withColumnRenamed("id", "rep"), "components")
    labelled = named.select("rep", "near", "parts").join(comp, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    apart = labelled.groupBy("near").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("m")).where("c0 <> c1 and m > 2").select("near", "m")
    rest = block_pairs(salted(labelled, apart, "near", "m", n, "rep").drop("m"), "near").join(lows, "rep").join(sets, "rep")
    links = links.unionByName(_forest(rest.select("near", "i", "j", "block", "rep", "component", "n_shingles", "low", "shingles"), "near", percent, True))
    # Classes of one id are one component, whatever their texts.
    of = held.select("doc_id", "digest").join(classes.select("digest", "rep"), "digest")
    several = of.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("last")).where("u <> last").select("doc_id", "u")
    same_id = of.join(several, "doc_id").select("u", F.col("rep").alias("v")).where("u <> v").distinct()
    comp = cut(components(links.unionByName(same_id)).withColumnRenamed("id", "rep"), "components").join(classes.select("rep", "id"), "rep")
    least = comp.groupBy("component").agg(F.min("id").alias("least"))
    known = classes.select("digest", "rep", "id").join(comp.join(least, "component").select("rep", "least"), "rep", "left").select("digest", F.coalesce("least", "id").alias("component"))
    out = facts.select("doc_id", "n_shingles", "digest").join(known, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op5_min_max_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share at least 0.8 of their two-word shingles."""
    return near_duplicates(read(spark, sf_dir, "documents"), width=2)


ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), s as (
  select distinct doc_id, case when len(ws) = 1 then ws[1] else ws[i] || ' ' || ws[i + 1] end as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws), 2))) as i from w where len(ws) > 0)
), n as (select doc_id, count(*) as n from s group by doc_id
), pairs as (
  select a.doc_id as u, b.doc_id as v, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
), links as (
  select u, v from pairs join n x on x.doc_id = u join n y on y.doc_id = v where 100 * shared >= 80 * (x.n + y.n - shared)
), e as (select u, v from links union all select v, u from links
), reach as (
  select doc_id as id, doc_id as to_id from documents
  union select r.id, e.v from reach r join e on e.u = r.to_id
), c as (select id, min(to_id) as component_id from reach group by id)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d join c on c.id = d.doc_id left join n on n.doc_id = d.doc_id
"""
