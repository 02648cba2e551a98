"""Shards by jump consistent hashing (Lamping and Veach, 2014).

A key and the number of shards decide a row's shard; there is no ring table. When one
shard is added, rows move only into it, a fraction of one in n + 1 of all.

``slot`` numbers the rows of a shard from 0 without gaps (order: a checksum of id, text
checksum and size, then these). A shard may be an eighth of the corpus, so ranks come from
bucket counts and windows over buckets (``rank_within``); no task holds a shard.

Cases: null texts have size 1 and the checksum of no bytes (0); a null id is hashed as
0; rows with equal ids go to the same shard, equal texts only by chance; an empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, rank_within, read

SHARDS = 8
#: Rows of a shard are ranked in so many buckets at least; in more where the session has more shuffle partitions.
BUCKETS = 64


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key; keys that have landed leave the loop, which ends after about ln(shards) turns."""
    state = keys.astype(np.uint64)
    out, at = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        out[live] = at[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        at[live] = ((out[live] + 1) * step).astype(np.int64)
        live = live[at[live] < shards]
    return out


def _stable(ids: pd.Series) -> np.ndarray:
    return mix(ids.to_numpy().astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def shard_of(shards: int):
    @F.pandas_udf("int")
    def of(ids: pd.Series) -> pd.Series:
        return pd.Series(jump(_stable(ids), shards).astype("int32"))

    return of


def sharded(docs: DataFrame, shards: int = SHARDS, buckets: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard) of every row of docs (doc_id, text)."""
    buckets = buckets or max(BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    facts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    key = F.coalesce("doc_id", F.lit(0).cast("long"))
    dealt = facts.withColumn("shard", shard_of(shards)(key)).withColumn("grown_shard", shard_of(shards + 1)(key))
    return rank_within(dealt, ["shard"], ["doc_id", "text_crc32", "size"], "slot", buckets)


def op3_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7, under the law ``key``."""
    out = sharded(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The CRC-32 of a text in DuckDB, with ``crc`` as the table of 256 remainders.
CRC = "xor(list_reduce(list_transform(regexp_extract_all(hex(encode({})), '..'), lambda h: cast('0x' || h as bigint)), lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1]), cast(4294967295 as bigint)), 4294967295)"
_WORD = "cast(18446744073709551616 as uhugeint)"

#: The checksum byte by byte, the key's mixing and the jumps by their definitions, on integers of 128 bits.
ORACLE = f"""
with recursive t as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i)) as crc
), d as (
  select doc_id, cast(octet_length(encode(coalesce(text, ''))) + 1 as bigint) as size, {CRC.format("coalesce(text, '')")} as text_crc32 from documents, t
), k0 as (
  select distinct doc_id, (cast(doc_id as uhugeint) + cast(11400714819323198485 as uhugeint)) % {_WORD} as x from d
), k1 as (
  select doc_id, (xor(x, x // 1073741824) * cast(13787848793156543929 as uhugeint)) % {_WORD} as x from k0
), k2 as (
  select doc_id, (xor(x, x // 134217728) * cast(10723151780598845931 as uhugeint)) % {_WORD} as x from k1
), j(doc_id, n, x, b, j) as (
  select doc_id, n, xor(x, x // 2147483648), cast(-1 as bigint), cast(0 as bigint) from k2, (values ({SHARDS}), ({SHARDS + 1})) as v(n)
  union all
  select doc_id, n, y, j, cast(floor((j + 1) * (cast(2147483648 as double) / cast(y // 8589934592 + 1 as double))) as bigint)
  from (select *, (x * cast(2862933555777941757 as uhugeint) + 1) % {_WORD} as y from j where j < n)
), s as (
  select doc_id, cast(max(b) filter (n = {SHARDS}) as integer) as shard, cast(max(b) filter (n = {SHARDS + 1}) as integer) as grown_shard from j where j >= n group by doc_id
), h as (
  select d.*, s.shard, s.grown_shard, {CRC.format("d.doc_id || ':' || d.text_crc32 || ':' || d.size")} as h from d join s on s.doc_id = d.doc_id, t
)
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by h, doc_id, text_crc32, size) - 1 as slot, grown_shard from h
"""
