"""Helpers shared by the training-data operators.

Nothing here keeps state on a machine: intermediate tables go to the folder in
``spark.checkpoint.dir`` (shared by driver and executors), so a lost executor costs
a recomputed task and never a lost table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import at_exit, cut, fresh_path, work_dir  # noqa: F401

#: Rows of one task's numpy work are cut into slices of about this many text bytes.
SLICE_BYTES = 2 << 20

#: Bytes of one Arrow batch between the JVM and a Python worker. Batches are held several times over
#: (writer, reader, what is made of them), in every running task.
BATCH_BYTES = 8 << 20


#: A table of fewer bytes a core may be one file with one row group.
SPREAD_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session are at most BATCH_BYTES; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = int(spark.conf.get(key, "67108864").rstrip("b"))
    if have <= 0 or have > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df written to the shared folder by ``buckets`` hash buckets of key: joins by key need not shuffle it again."""
    spark = df.sparkSession
    path = fresh_path(spark, "bucketed")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    at_exit(lambda: spark.sql(f"drop table if exists {name}"))
    return spark.table(name)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if it is so small (SPREAD_BYTES a core) that its files may give work to a few tasks only."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of docs, in the types that the operators' functions take."""
    bound_batches(docs.sparkSession)
    return spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fold(doc_id: Column) -> Column:
    """crc32 of the decimal id, modulo 5; 0 marks the held-out rows. A null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def rank_within(df: DataFrame, groups: list[str], order: list[str], out: str, buckets: int) -> DataFrame:
    """Adds ``out``: a gapless rank from 0 within ``groups``, where a group may hold most rows.

    Rows are ranked by a checksum of ``order`` (CRC-32 of its values as text, a colon between, nulls
    left out) and then by ``order``, so that ranks do not depend on ``buckets``. Rows of a group are
    dealt to buckets by ranges of the checksum. Counts of each (group, bucket) give a bucket's first
    rank; a window ranks rows inside a bucket. No task sees more than a bucket of a group. df is read
    twice; cut it first if it is dear.
    """
    checksum = F.crc32(F.concat_ws(":", *[F.col(c).cast("string") for c in order]).cast("binary"))
    dealt = df.withColumn("__h", checksum).withColumn("__b", F.floor(F.col("__h") * F.lit(buckets) / F.lit(1 << 32)).cast("int"))
    counts = dealt.groupBy(*groups, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__b").alias("__gb"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*groups, "__b").orderBy("__h", *order)
    ranked = dealt.withColumn("__r", F.row_number().over(inside))
    same = F.col("__b") == F.col("__gb")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    joined = ranked.join(base, same, "left")
    return joined.withColumn(out, (F.col("__base") + F.col("__r") - 1).cast("long")).select(*df.columns, out)


#: A key is hot if it has more than one row in so many; there can be no more hot keys than that.
HOT = 1000


def salted(rows: DataFrame, table: DataFrame, key: str, size: str, total: int, deal: str) -> DataFrame:
    """rows joined with table by key, where one key may have most rows.

    table has each key once, with ``size``, how many of about ``total`` rows have it. Rows of hot keys
    (at most HOT, so the list is broadcast) are dealt to all partitions by a hash of ``deal``; only
    the hot keys' rows of table are repeated for that.
    """
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.col(size) * HOT > total
    hot = table.where(is_hot).select(key, F.lit(salts).alias("__salts"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(deal), F.col("__salts")), F.lit(0)).cast("int"))
    copies = table.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.drop("__salts").join(copies, [key, "__salt"]).drop("__salt")


def query_groups(asked: DataFrame, column: str, most: int) -> Iterator[pa.Table]:
    """Rows (vec_id, column) in groups of vectors of at most ``most`` bytes as doubles, or of one row; one group at least, which may be empty."""
    own = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(n))
    weigh = asked.select("vec_id", (8 * F.size(column) + 8).alias("bytes"))
    groups = max(1, -(-(weigh.agg(F.sum("bytes")).first()[0] or 0) // most))
    while groups > 1 and not weigh.groupBy(own(groups).alias("g")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).where(f"bytes > {most} and n > 1").isEmpty():
        groups *= 2
    for g in range(groups):
        yield asked.where(own(groups) == g).toArrow()


# --- Arrow batches as numpy -------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) runs of rows with about ``limit`` bytes; a longer row makes a run of its own."""
    n, first = len(offsets) - 1, 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end
        first = end


# --- words and shingles -----------------------------------------------------------

_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _separators() -> np.ndarray:
    """For each byte: does it end a word?"""
    sep = np.zeros(256, bool)
    sep[[0x20, *range(0x09, 0x0E)]] = True
    return sep


@cache
def _digits() -> np.ndarray:
    """For each byte its digit, from 1 on; A-Z have those of a-z."""
    digit = np.arange(1, 257, dtype=np.uint64)
    digit[65:91] = digit[97:123]
    return digit


#: Words are numbers to this base modulo this prime: of two different words of n bytes or less, at most n bases of all give both one value.
_PRIME = (1 << 61) - 1
_BASE = 0x9E3779B97F4A7C15 % _PRIME


def _times(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """a * b modulo the prime 2^61 - 1, of values below it."""
    b = np.asarray(b, np.uint64)
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle, last = a1 * b0 + a0 * b1, a0 * b0
    return _reduced(((a1 * b1) << np.uint64(3)) + (middle >> np.uint64(29)) + ((middle & np.uint64((1 << 29) - 1)) << half) + (last >> np.uint64(61)) + (last & np.uint64(_PRIME)))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(_PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(_PRIME), x - np.uint64(_PRIME), x)


_powers_cache: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low 31 bits, other bits, inverse) of the base's powers below n."""
    if not _powers_cache or len(_powers_cache[0][0]) < n:

        def raised(base: int) -> np.ndarray:
            out = np.ones(1, np.uint64)
            while len(out) < n:
                out = np.concatenate([out, _times(out, pow(base, len(out), _PRIME))])
            return out[:n]

        up = raised(_BASE)
        _powers_cache[:] = [((up & np.uint64((1 << 31) - 1)).astype(np.uint32), (up >> np.uint64(31)).astype(np.uint32), raised(pow(_BASE, -1, _PRIME)))]
    return _powers_cache[0]


def _values(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The words raw[start : end] as numbers; raw has 2^22 bytes at most, so that sums of products stay below 2^61."""
    low, high, inverse = _powers(len(raw) + 1)
    digit, sums = _digits()[raw], []
    for power in (low, high):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(digit * power[: len(raw)], out=total[1:])
        sums.append(total[ends] - total[starts])
    return _times(_reduced(_times(_reduced(sums[1]), 1 << 31) + _reduced(sums[0])), inverse[starts])


def _hash_run(raw: np.ndarray, doc_start: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of raw. doc_start: bool for each byte that begins a document."""
    word = ~sep[raw]
    edge = word.copy()
    edge[1:] &= doc_start[1:] | ~word[:-1]
    starts = np.flatnonzero(edge)
    last = word.copy()
    last[:-1] &= doc_start[1:] | ~word[1:]
    ends = np.flatnonzero(last) + 1
    if len(raw) <= 2 * SLICE_BYTES:
        value = _values(raw, starts, ends)
    else:  # a word that is longer than a slice, in pieces
        value = np.zeros(len(starts), np.uint64)
        for k, (start, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            total = 0
            for a in range(start, end, SLICE_BYTES):
                piece = raw[a : min(a + SLICE_BYTES, end)]
                own = int(_values(piece, np.zeros(1, np.int64), np.array([len(piece)]))[0])
                total = (total + own * pow(_BASE, a - start, _PRIME)) % _PRIME
            value[k] = total
    return starts, mix(value ^ ((ends - starts).astype(np.uint64) * np.uint64(_ODD)))


def words(raw: np.ndarray, offsets: np.ndarray, sep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, their documents, words before each document) of texts in bytes.

    A word is a longest run of bytes other than 0x20 and 0x09-0x0D, or those that the bool
    table sep marks; A-Z count as a-z. Runs of bytes are hashed that end between words.
    """
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    begins = np.zeros(len(raw) + 1, bool)
    begins[offsets[:-1]] = True
    begins = begins[:-1]
    sep = _separators() if sep is None else sep
    starts, hashes, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + SLICE_BYTES)
        while end < len(raw) and not (sep[raw[end]] or begins[end]):
            gaps = np.flatnonzero(sep[raw[at:end]] | begins[at:end])
            if len(gaps) and gaps[-1] > 0:
                end = at + int(gaps[-1])
                break
            more = min(len(raw), end + SLICE_BYTES)
            gaps = np.flatnonzero(sep[raw[end:more]] | begins[end:more])
            end = end + int(gaps[0]) if len(gaps) else more
        s, h = _hash_run(raw[at:end], begins[at:end], sep)
        starts.append(s + at)
        hashes.append(h)
        at = end
    start = np.concatenate(starts).astype(np.int64)
    doc = np.searchsorted(offsets, start, "right") - 1
    counts = np.bincount(doc, minlength=n)
    return np.concatenate(hashes), doc, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles.

    With fewer than k words (but one at least) the whole sequence is the one shingle;
    without words the set is empty.
    """
    h, doc, first = words(raw, offsets)
    n = len(offsets) - 1
    span = max(len(h) - k + 1, 0)
    s = h[:span].copy()
    for j in range(1, k):
        s = mix(s * np.uint64(_ODD) + h[j : span + j])
    out = []
    for i in range(n):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            out.append(np.unique(s[a : b - k + 1]))
        elif b > a:
            x = h[a : a + 1].copy()
            for j in range(a + 1, b):
                x = mix(x * np.uint64(_ODD) + h[j : j + 1])
            out.append(mix(x + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
