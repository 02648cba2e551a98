"""Best-fit packing of token sequences by bin completion.

A plan needs only how many pieces there are of each length: at most ``capacity``
numbers, whatever the corpus. Bin completion (after Korf, 2003) works on these counts:

* Around the largest remaining length, the undominated fillings of the rest are
  enumerated lazily (a filling is dominated if a remaining longer piece can take the
  place of some of its pieces). None is dropped but by the waste bound.
* A branch is (filling, times): how often the filling is used, most often first. A
  branch is cut when sequences used plus the rest's tokens over the capacity reach the
  incumbent's, or when the same counts were met with as few sequences.
* Incumbents are best-fit decreasing, the fullest filling at every step, and plans that take
  the longest pieces among fillings with at most a given waste (``WASTES``). The best of
  these is the search's first descent too. A search ends at the lower bound (dual feasible
  functions), when all is searched, or after ``SEARCH_STEPS`` steps, at every size of input.

Pieces are ranked within their length (``rank_within``: no task holds a length) and the
rank's place in the plan gives sequence and offset. Documents longer than the capacity
are cut; the first piece takes the remainder, so that all others are full.

Cases: a null text is empty and has the end id alone; null ids sort first; repeated rows
are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import pre_tokenizer
from .common import cut, rank_within, read, texts_of

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: Steps of the search after the incumbents (branches, and places looked at to enumerate fillings).
SEARCH_STEPS = 2_000_000
#: Waste of one sequence that the incumbents' fillings may have, in tokens.
WASTES = (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# --- tokens -----------------------------------------------------------------------


class Tokens:
    """Ids of whole texts by a byte-level BPE vocabulary file of the tokenizers library.

    Merges that were learned in the order of their ids, lowest first, are the same thing as
    ranks: at the rank of a token t, the bytes of t that stand between two token borders
    have been merged as t alone would be by the lower ranks, that is, to t's own pair; so
    no other pair of tokens can stand for t. Such a file is run by rank, which is several
    times as fast. Any other file, and any text with an added token's string (which is
    cut out before pre-tokens are made), goes to the tokenizer itself.
    """

    def __init__(self, path: str):
        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        self.ranks = None
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model["type"] == "BPE"
        plain = plain and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "ignore_merges"))
        if plain and (ranks := self._ranks(model)):
            self.ranks = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ranks(self, model: dict) -> dict[bytes, int] | None:
        """Bytes of each token and its id, if the merges are in the order of the ids."""
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [model["vocab"].get(x) for x in merged]
        if None in ids or ids != sorted(ids) or len(set(ids)) != len(ids):
            return None
        return {bytes(byte[c] for c in x): i for x, i in model["vocab"].items() if x not in self.added}

    def ids(self, text: str) -> np.ndarray:
        if self.ranks is None or any(x in text for x in self.added):
            return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4")
        try:
            return self.ranks.encode_to_numpy(text).astype("<u4", copy=False)
        except ValueError:  # its regular expressions give up on very long white space
            pieces = pre_tokenizer().findall(text)
            return np.fromiter((i for x in pieces for i in self.ranks._encode_single_piece(x)), "<u4")


@cache
def tokens(path: str) -> Tokens:
    """One vocabulary for each Python worker and file."""
    return Tokens(path)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs (doc_id, text)."""
    path = path or public_tokenizers.path(VOCABULARY)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = tokens(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = known.ids(text.as_py() or "").tobytes() + end
                n, at, k = len(raw) // 4, 0, 0
                while at < n:
                    size = n % capacity if k == 0 and n % capacity else min(capacity, n - at)
                    for column, x in zip(out, (doc_id, k, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])), strict=True):
                        column.append(x)
                    at, k = at + size, k + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = texts_of(docs)
    return texts.mapInArrow(cut_up, PIECES)


# --- the plan ---------------------------------------------------------------------

Plan = list[tuple[tuple[tuple[int, int], ...], int]]  # (((length, how many), ...), sequences)


class Spent(Exception):
    """The search has had its steps."""


class Steps:
    def __init__(self, most: int | None):
        self.left = most

    def take(self) -> None:
        if self.left is not None:
            self.left -= 1
            if self.left < 0:
                raise Spent


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that no plan can go below: the largest of bounds by dual feasible functions (Fekete and Schepers, 2001; Carlier, Clautiaux and Moukrim, 2007)."""
    x, n = np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64)
    best = -(-int((x * n).sum()) // capacity)
    for k in range(1, capacity // 2 + 1):
        whole = capacity // k
        stepped = np.where(2 * x > capacity, 2 * (whole - (capacity - x) // k), np.where(2 * x == capacity, whole, 2 * (x // k)))
        short = np.where(x > capacity - k, capacity, np.where(x < k, 0, x))
        best = max(best, -(-int((stepped * n).sum()) // (2 * whole)), -(-int((short * n).sum()) // capacity))
    return best


def fillings(room: int, have: dict[int, int], waste: int, steps: Steps, allowed: Callable[[], int]) -> Iterator[tuple[tuple[int, int], ...]]:
    """Every undominated filling of room from the counts ``have``, as ((length, how many), ...).

    Those that leave at most ``waste`` (or the least that can be left) come before the others; longer
    pieces come first. Fillings that leave more than ``allowed()`` are no use and left out.
    """
    lengths = sorted((x for x, n in have.items() if n and x <= room), reverse=True)
    if not lengths:
        yield ()
        return
    if lengths[0] == room:  # one piece dominates all else
        yield ((room, 1),)
        return
    most = [min(have[x], room // x) for x in lengths]
    reach = [1] * (len(lengths) + 1)  # sums that lengths[i:] can make, as bits
    mask = (1 << (room + 1)) - 1
    for i in range(len(lengths) - 1, -1, -1):
        bits, n, take = reach[i + 1], most[i], 1
        while n > 0:
            k = min(take, n)
            bits |= (bits << (lengths[i] * k)) & mask
            n, take = n - k, take * 2
        reach[i] = bits
    least = room - (reach[0].bit_length() - 1)
    every = sum(1 << x for x in lengths)
    near = max(waste, least)
    for low, high in ((0, near), (near + 1, room)):
        # (lengths seen, room left, own, sums of own pieces, sums of two own pieces or more, lengths that remain)
        todo = [(0, room, (), 1, 0, every)]
        while todo:
            steps.take()
            i, need, own, sums, several, rest = todo.pop()
            if i == len(lengths):
                if need <= allowed() and not _dominated(need, own, several, rest):
                    yield own
                continue
            if low > allowed():
                break
            x = lengths[i]
            for k in range(min(need // x, most[i]) + 1):
                if k:
                    several |= (several << x) | ((sums & ~1) << x)
                    sums |= sums << x
                left = need - k * x
                from_, to = max(0, left - high), left - low
                if several & rest:  # a longer piece does as well as some of these
                    break
                if to >= 0 and (reach[i + 1] >> from_) & ((1 << (to - from_ + 1)) - 1):
                    todo.append((i + 1, left, (*own, (x, k)) if k else own, sums, several, rest & ~(1 << x) if k == have[x] else rest))


def _dominated(left: int, own: tuple[tuple[int, int], ...], several: int, rest: int) -> bool:
    """Whether one remaining length can take the place of some pieces (or none) of own, with ``left`` of room to spare."""
    if several & rest or rest & ((1 << (left + 1)) - 2):
        return True
    spread, done = several, 0
    for x, _ in own:
        spread |= 1 << x
    while done < left - 1:
        k = min(done + 1, left - 1 - done)
        spread |= spread << k
        done += k
    return left > 0 and bool((spread << 1) & rest)  # sums and 1 to ``left`` more


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """Each piece, longest first, into the fullest sequence that has room; sequences that are filled alike are one entry with a count."""
    open_: dict[int, Counter] = {}  # room -> fillings that leave it

    def put(own: tuple[tuple[int, int], ...], x: int, k: int, times: int) -> None:
        filled = (*own, (x, k)) if not own or own[-1][0] != x else (*own[:-1], (x, own[-1][1] + k))
        open_.setdefault(capacity - sum(y * n for y, n in filled), Counter())[filled] += times

    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            room = min((r for r in open_ if r >= x), default=None)
            if room is None:
                k = capacity // x
                if left // k:
                    put((), x, k, left // k)
                if left % k:
                    put((), x, left % k, 1)
                break
            # The fullest stays the fullest: it takes as many as have room before the next one gets any.
            own, there = open_[room].popitem()
            k = min(left, room // x)
            times = min(there, left // k)
            if there > times:
                open_[room][own] = there - times
            if not open_[room]:
                del open_[room]
            put(own, x, k, times)
            left -= k * times
    return [(own, times) for fillings_ in open_.values() for own, times in fillings_.items()]


def descent(counts: dict[int, int], capacity: int, waste: int) -> Plan:
    """The first undominated filling of the largest length, as often as the counts allow, until all are placed."""
    left, out, free = dict(counts), [], Steps(None)
    while left:
        x = max(left)
        own = _with(x, next(fillings(capacity - x, left | {x: left[x] - 1}, waste, free, lambda: capacity)))
        times = min(left[y] // k for y, k in own)
        out.append((own, times))
        for y, k in own:
            left[y] -= k * times
            if not left[y]:
                del left[y]
    return out


def _with(x: int, filling: tuple[tuple[int, int], ...]) -> tuple[tuple[int, int], ...]:
    """A filling and its largest piece."""
    if filling and filling[0][0] == x:
        return ((x, filling[0][1] + 1), *filling[1:])
    return ((x, 1), *filling)


def size(plan: Plan) -> int:
    return sum(n for _, n in plan)


def search(counts: dict[int, int], capacity: int, below: int, bound: int, waste: int, steps: Steps) -> Plan | None:
    """A plan of fewer than ``below`` sequences, the best that the steps allow; None if there is none, or none was found."""
    left = np.zeros(capacity + 1, np.int64)
    for x, n in counts.items():
        left[x] = n
    tokens, used = sum(x * n for x, n in counts.items()), 0
    done: Plan = []
    best: Plan | None = None
    seen: dict[bytes, int] = {}

    def branches() -> Iterator[tuple[tuple[tuple[int, int], ...], int]]:
        lengths = np.flatnonzero(left)
        x = int(lengths[-1])
        have = {int(y): int(left[y]) for y in lengths if y <= capacity - x}
        if x in have:
            have[x] -= 1
        forced = have.get(capacity - x, 0) > 0 or not any(have.values())
        for f in fillings(capacity - x, have, waste, steps, lambda: (below - 1 - used) * capacity - tokens):
            own = _with(x, f)
            most = min(int(left[y]) // k for y, k in own)
            for times in (most,) if forced else range(most, 0, -1):
                yield own, times

    def turn(own: tuple[tuple[int, int], ...], times: int) -> None:
        nonlocal tokens, used
        for y, k in own:
            left[y] -= k * times
        tokens -= times * sum(y * k for y, k in own)
        used += times

    todo = [branches()]
    try:
        while todo and below > bound:
            step = next(todo[-1], None)
            if step is None:
                todo.pop()
                if done:
                    turn(done[-1][0], -done.pop()[1])
                continue
            steps.take()
            turn(*step)
            if not tokens and used < below:
                best, below = [*done, step], used
            if tokens and used + -(-tokens // capacity) < below:
                key = hashlib.blake2b(left.tobytes(), digest_size=16).digest()
                if used < seen.get(key, below):
                    seen[key] = used
                    done.append(step)
                    todo.append(branches())
                    continue
            turn(step[0], -step[1])
    except Spent:
        pass
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY, steps: int = SEARCH_STEPS) -> Plan:
    """How often each filling is used, so that every piece has a place."""
    counts = {x: n for x, n in counts.items() if n}
    if not counts:
        return []
    bound = lower_bound(counts, capacity)
    best, waste = None, 0
    for w in WASTES:
        own = descent(counts, capacity, w)
        if best is None or size(own) < size(best):
            best, waste = own, w
        if size(best) == bound:
            return best
    best = min(best, best_fit_decreasing(counts, capacity), key=size)
    return search(counts, capacity, size(best), bound, waste, Steps(steps)) or best


def placed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (doc_id, piece, length, ...) with sequence_id and offset; only counts of lengths come to the driver."""
    counts = {int(r["length"]): int(r["n"]) for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    first = 0
    for filling, times in plan(counts, capacity):
        offset = 0
        for length, k in filling:
            runs.setdefault(length, []).append((used[length], k, first, offset))
            used[length] += k * times
            offset += k * length
        first += times
    table = {x: np.array(r, np.int64) for x, r in runs.items()}
    shared = rows.sparkSession.sparkContext.broadcast(table)  # grows with the plan's fillings, which the lengths bound, not the corpus

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for x in np.unique(n):
            own = np.flatnonzero(n == x)
            run = shared.value[int(x)]
            at = run[np.searchsorted(run[:, 0], r[own], "right") - 1]
            since = r[own] - at[:, 0]
            sequence[own] = at[:, 2] + since // at[:, 1]
            offset[own] = at[:, 3] + since % at[:, 1] * x
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    buckets = max(64, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranked = rank_within(rows, ["length"], ["doc_id", "piece", "ids_crc32"], "__rank", buckets)
    return ranked.withColumn("__at", place("length", "__rank")).select(*rows.columns, "__at.sequence_id", "__at.offset")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of docs (doc_id, text) and its place in a sequence of at most ``capacity`` tokens."""
    return placed(cut(pieces(docs, path, capacity, end_id), "pieces"), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack(read(spark, sf_dir, "documents"))
