"""Periodic runs of words: stretches that repeat themselves at least three times.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at
least ``max(MIN_LENGTH, 3 q)`` that neither neighbouring word extends. At lag q it is an island of at least
``max(MIN_LENGTH - q, 2 q)`` consecutive matches (a word and the word q later are identical), so that a lag with fewer
matches in the whole text has no run.

1. Words become numbers (a dictionary of the batch), and matches are counted for every lag up to a third of the text
   (``lag_counts``): of a frequent word by the autocorrelation of its places (an FFT whose rounded values are
   exact), of a rare one by the differences of its places, pair by pair. A word is frequent if its pairs would cost more than its transform.
2. Lags with enough matches get an island scan, from the smallest. Matches inside a run of period p at a multiple of
   p belong to that run and are taken off first: by the theorem of Fine and Wilf no run of a larger period shares them.
   The scan looks at places an eighth of an island apart and goes through all of them only if eight in a row match.
3. An island at lag q whose stretch was found with a smaller period is no run of period q.

Each text is worked on in one task, whole; a batch of texts is counted together. There are no shuffles. Cases: null and
empty texts have no words, no runs and an empty collapsed text; null and repeated ids are texts like others; a text of
any length is taken whole (numbers of its words: 8 bytes each); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import bound_batches, read, texts_of
from .sharding import CRC

MIN_LENGTH = 24
#: Pairs that cost as much as a step of a transform, of m log2(m).
PAIR_COST = 2.0
#: Differences are counted in lots of about this many.
LOT = 1 << 20
#: Places of a transform, and indicators of one batch of transforms together.
PLACES = 1 << 22

RUNS = "array<struct<start:long,length:long,period:long>>"


def needed(lag: np.ndarray, least: int = MIN_LENGTH) -> np.ndarray:
    """Consecutive matches of a run at a lag."""
    return np.maximum(least - lag, 2 * lag)


def lag_counts(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, base): matches at lag q of the text words[first[t] : first[t + 1]] stand at counts[base[t] + q], for q up to a third."""
    n = np.diff(first)
    limit = n // 3
    base = np.concatenate([[0], np.cumsum(limit + 1)])
    counts = np.zeros(base[-1], np.int64)
    if not len(words):
        return counts, base
    text = np.repeat(np.arange(len(n)), n)
    key = text * (int(words.max()) + 1) + words
    place = np.argsort(key, kind="stable")
    key = key[place]
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(edges)
    end = np.repeat(edges[1:], size)
    # A transform of m places has the lags up to a third apart: m >= n + n / 3.
    m = 2.0 ** np.ceil(np.log2(np.maximum(n + limit, 2)))
    group_text = text[place[edges[:-1]]]
    heavy_group = PAIR_COST * size.astype(float) ** 2 / 2 > (m * np.log2(m))[group_text]
    heavy = np.repeat(heavy_group, size)
    alive, step, lot, waiting = np.flatnonzero(~heavy & (np.arange(len(key)) + 1 < end)), 1, [], 0
    while len(alive):
        lag = place[alive + step] - place[alive]
        own = text[place[alive]]
        near = lag <= limit[own]
        alive = alive[near]
        lot.append(base[own[near]] + lag[near])
        waiting += len(alive)
        step += 1
        alive = alive[alive + step < end[alive]]
        if waiting > LOT or not len(alive):
            at, times = np.unique(np.concatenate(lot), return_counts=True)
            counts[at] += times
            lot, waiting = [], 0
    frequent = np.flatnonzero(heavy_group)  # text by text
    bounds = np.flatnonzero(np.concatenate([[True], np.diff(group_text[frequent]) > 0, [True]])) if len(frequent) else []
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        groups, t = frequent[a:z], int(group_text[frequent[a]])
        size_t = int(m[t])
        power = np.zeros(size_t // 2 + 1)
        together = max(1, PLACES // size_t)
        for k in range(0, len(groups), together):
            marks = np.zeros((len(groups[k : k + together]), size_t))
            for row, g in zip(marks, groups[k : k + together], strict=True):
                row[place[edges[g] : edges[g + 1]] - first[t]] = 1
            power += (np.abs(np.fft.rfft(marks, axis=1)) ** 2).sum(axis=0)
        counts[base[t] : base[t + 1]] += np.rint(np.fft.irfft(power, size_t)[: limit[t] + 1]).astype(np.int64)
    return counts, base


def islands(words: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """(first, end) of the places with at least ``least`` consecutive matches at a lag."""
    apart = max(1, least // 8)
    if apart > 1:
        probe = np.arange(apart - 1, len(words) - lag, apart)
        if not len(_long(words[probe] == words[probe + lag], least // apart)):
            return []
    return _long(words[lag:] == words[:-lag], least).tolist()


def _long(same: np.ndarray, least: int) -> np.ndarray:
    """(first, end) of the runs of true values that are long enough."""
    steps = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).view(np.int8)))
    spans = steps.reshape(-1, 2)
    return spans[spans[:, 1] - spans[:, 0] >= least]


def runs_of(words: np.ndarray, counts: np.ndarray, least: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of a text's runs, by start and then period; counts: its matches by lag."""
    counts, found = counts.copy(), {}
    lags = np.arange(len(counts))
    need = needed(lags, least)
    for q in np.flatnonzero((counts >= need) & (lags > 0)).tolist():
        if counts[q] < need[q]:
            continue
        for a, b in islands(words, q, int(need[q])):
            if (a, b + q) not in found:
                found[a, b + q] = q
                length = b + q - a
                more = lags[2 * q : length : q]
                counts[more] -= length - more
    return sorted((a, z - a, q) for (a, z), q in found.items())


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words of the texts one after the other, the first of each text)."""
    pieces = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat, offsets = pieces.flatten(), pieces.offsets.to_numpy().astype(np.int64)
    some = pc.greater(pc.binary_length(flat), 0)  # white space at the ends leaves empty pieces
    kept = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return flat.filter(some), kept[offsets - offsets[0]].astype(np.int64)


def _joined(words: pa.Array, first: np.ndarray) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(first, pa.int32()), words.cast(pa.string())), " ")


def _found(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, first = _words(b.column(1))
            ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
            texts = np.flatnonzero(np.diff(first) >= least)
            keep = np.ones(len(ids), bool)
            starts = np.concatenate([[0], np.cumsum(np.diff(first)[texts])])
            own = np.concatenate([ids[first[t] : first[t + 1]] for t in texts.tolist()]) if len(texts) else ids[:0]
            counts, base = lag_counts(own, starts)
            lag = np.arange(len(counts)) - np.repeat(base[:-1], np.diff(base))
            likely = np.unique(np.searchsorted(base, np.flatnonzero((counts >= needed(lag, least)) & (lag > 0)), "right") - 1)
            runs: dict[int, list[tuple[int, int, int]]] = {}
            for k in likely.tolist():
                t = int(texts[k])
                if found := runs_of(own[starts[k] : starts[k + 1]], counts[base[k] : base[k + 1]], least):
                    runs[t] = found
                    for start, length, period in found:
                        keep[first[t] + start + period : first[t] + start + length] = False
            flat = [r for t in sorted(runs) for r in runs[t]]
            sizes = np.zeros(b.num_rows, np.int64)
            sizes[sorted(runs)] = [len(runs[t]) for t in sorted(runs)]
            fields = [pa.array([r[c] for r in flat], pa.int64()) for c in range(3)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
            left = np.concatenate([[0], np.cumsum(keep)])[first]
            collapsed = _joined(words.filter(pa.array(keep)) if not keep.all() else words, left)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(first)), lists, collapsed], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of docs (doc_id, text).

    runs are by start, then period. collapsed has the words, one space between, without those that any run holds after its first period.
    """
    return texts_of(docs).mapInArrow(_found(least), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared as whole numbers; then the smallest start, then period. Null without runs."""

    def before(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        less = (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))
        return F.when((x > y) | ((x == y) & less), F.lit(-1)).when((x == y) & (a["start"] == b["start"]) & (a["period"] == b["period"]), F.lit(0)).otherwise(F.lit(1))

    return F.get(F.array_sort(runs, before), F.lit(0))


@F.arrow_udf(StringType())
def planted(doc_id: pa.Array, text: pa.Array) -> pa.Array:
    """Texts that repeat themselves from a word on, by the checksum of the id; the rule of ``op13_lag_runs``."""
    words, first = _words(text)
    pick = []
    lengths = np.diff(first)
    for i, at, n in zip(doc_id.to_pylist(), first.tolist(), lengths.tolist(), strict=False):
        order = np.arange(n)
        if n:
            g = zlib.crc32(b"" if i is None else str(i).encode()) // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            order[a:] = a + (order[a:] - a) % p
        pick.append(order + at)
    taken = words.take(pa.array(np.concatenate(pick) if pick else np.zeros(0, np.int64)))
    return _joined(taken, first)


def op13_lag_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, of which a tenth are made to repeat themselves."""
    bound_batches(spark)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeats = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    made = docs.select("doc_id", F.when(repeats, planted("doc_id", F.when(repeats, F.col("text")))).otherwise(F.col("text")).alias("text"))
    out = periodic_runs(made).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Matches by an equality join of a document's words; islands by the places less their rank. Fit for small tables only.
ORACLE = rf"""
with t as materialized (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i)) as crc
), d as materialized (
  select doc_id, {CRC.format("coalesce(cast(doc_id as varchar), '')")} as h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents, t
), r as materialized (
  select doc_id, ws, len(ws) as n, h, cast(floor(h / 10) as bigint) as g, case when len(ws) > 0 then cast(floor(h / 10) as bigint) % len(ws) end as a from d
), m as materialized (
  select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: ws[case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end + 1]) else ws end as ws from r
), w as materialized (
  select doc_id, n, unnest(ws) as w, unnest(range(n)) as i from m where n > 0
), pairs as (
  select x.doc_id, y.i - x.i as q, x.i from w x join w y on x.doc_id = y.doc_id and x.w = y.w and y.i > x.i where 3 * (y.i - x.i) <= x.n
), placed as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from pairs
), stretches as materialized (
  select doc_id, q, min(i) as start, count(*) + q as length from placed group by doc_id, q, island having count(*) >= greatest(24 - q, 2 * q)
), runs as materialized (
  select doc_id, start, length, min(q) as period from stretches group by doc_id, start, length
), facts as (
  select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from runs group by doc_id
), best as (
  select doc_id, start, length, period from runs a where not exists (
    select 1 from runs b where b.doc_id = a.doc_id and (b.length * a.period > a.length * b.period or (b.length * a.period = a.length * b.period and (b.start < a.start or (b.start = a.start and b.period < a.period)))))
), gone as (
  select distinct w.doc_id, w.i from w join runs r on r.doc_id = w.doc_id and w.i >= r.start + r.period and w.i < r.start + r.length
), kept as (
  select w.doc_id, string_agg(w.w, ' ' order by w.i) as text from w left join gone on gone.doc_id = w.doc_id and gone.i = w.i where gone.i is null group by w.doc_id
)
select d.doc_id, coalesce(f.n_runs, 0) as n_runs, b.start, cast(b.length as bigint) as length, cast(b.period as bigint) as period, cast(1000 * b.length // b.period as bigint) as exponent_milli,
  sha256(coalesce(f.lines, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
from d left join facts f on f.doc_id = d.doc_id left join best b on b.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id
"""
