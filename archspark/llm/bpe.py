r"""Byte-level BPE by a global shuffle of distinct pre-tokens, and decoding.

1. Each task cuts its texts into pre-tokens, once, and gathers them into blocks of about
   ``BLOCK_BYTES``. A block has its distinct pre-tokens, dealt to hash buckets, and for every
   position of its texts a code: the pre-token's rank by frequency in the block. Blocks are a
   table in the shared folder, bucketed by block.
2. The lists of distinct pre-tokens are exploded and shuffled by bucket. All copies of a
   pre-token meet in one bucket, where it is encoded once. A frequent pre-token comes once from
   each block and not once from each position, so that no bucket is hot.
3. The ids are joined back to their blocks, whose bucketed table is not shuffled again, and
   each text's ids are put together by position, by array look-ups.
4. Decoding joins ids with the token-byte table by position in that table (it is
   dense and as large as the vocabulary) and concatenates the bytes.

Positions and pre-tokens travel as arrays of a block, since a row for each (block, pre-token) would take
more disk than the texts do. Blocks are named at random, written once and read from there by
both branches; a block whose lists do not have the expected sizes raises an error. Nothing but the
vocabulary (fixed size) is broadcast, and a task remembers at most ``KNOWN_WORDS`` encoded pre-tokens.

Cases: a null text is empty and has no ids; null and repeated doc_ids are carried as they
are; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, bucketed, read, texts_of

RANKS = "byte_bpe_multi_50k.tiktoken"
BLOCK_BYTES = 16 << 20
#: Encoded pre-tokens that a task remembers; beyond that it begins anew.
KNOWN_WORDS = 500_000
#: Texts with more characters give their pre-tokens one by one and not as a list.
LONG_TEXT = 4 << 20
#: White space as the tokenizers' regular expressions have it; Python's \s also takes U+001C to U+001F.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

BLOCKS = "block string, doc_ids array<long>, lengths array<int>, codes binary, dealt binary, buckets array<int>, words array<binary>"
LISTS = "block string, bucket int, words binary"


def pre_tokenizer(pattern: str = public_tokenizers.PATTERN) -> regex.Pattern:
    """The pattern with white space spelled out; its matches cover a text from end to end."""
    spelled = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    return regex.compile(spelled)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pack(parts: list[bytes]) -> bytes:
    """Byte strings as one: their number, their lengths, their bytes; deflated."""
    sizes = np.fromiter(map(len, parts), np.uint32, len(parts))
    return zlib.compress(np.uint32(len(parts)).tobytes() + sizes.tobytes() + b"".join(parts), 1)


def unpack(raw: bytes) -> tuple[np.ndarray, bytes]:
    raw = zlib.decompress(raw)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    return np.frombuffer(raw, np.uint32, n, 4).astype(np.int64), raw[4 + 4 * n :]


class _Block:
    """Texts of a task until they are enough for a block."""

    def __init__(self):
        self.code: dict[str, int] = defaultdict(count().__next__)
        self.doc_ids, self.parts, self.size = [], [], 0

    def add(self, doc_id: int | None, text: str, found: regex.Pattern) -> None:
        pieces = found.findall(text) if len(text) <= LONG_TEXT else (m.group() for m in found.finditer(text))
        self.parts.append(np.fromiter(map(self.code.__getitem__, pieces), np.uint32))
        self.doc_ids.append(doc_id)
        self.size += len(text) + 1

    def row(self, buckets: int) -> pa.RecordBatch:
        """A BLOCKS row. Codes are ranks by frequency; ``dealt`` is the bucket of each rank."""
        words = [w.encode() for w in self.code]
        codes = np.concatenate(self.parts)
        order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        bucket = np.fromiter((zlib.crc32(words[i]) % buckets for i in order.tolist()), np.uint32, len(words))
        by_bucket = np.argsort(bucket, kind="stable")
        some, sizes = np.unique(bucket, return_counts=True)
        ends = np.cumsum(sizes)
        lists = [pack([words[i] for i in order[by_bucket[z - n : z]].tolist()]) for z, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        lengths = np.fromiter(map(len, self.parts), np.int32, len(self.parts))
        columns = [[uuid.uuid4().hex], [self.doc_ids], [lengths], [_wide(rank[codes])], [_wide(bucket)], [some.astype(np.int32)], [lists]]
        kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["block", "doc_ids", "lengths", "codes", "dealt", "buckets", "words"])


def _blocks(buckets: int, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, block = pre_tokenizer(pattern), _Block()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                block.add(doc_id, text.as_py() or "", found)
                if block.size >= BLOCK_BYTES:
                    yield block.row(buckets)
                    block = _Block()
        if block.doc_ids:
            yield block.row(buckets)

    return run


def _wide(codes: np.ndarray) -> bytes:
    """Codes as two or four byte planes, which deflate better than whole numbers."""
    planes = 2 if not len(codes) or codes.max() < 1 << 16 else 4
    return bytes([planes]) + zlib.compress(np.ascontiguousarray(codes.astype(f"<u{planes}").view(np.uint8).reshape(-1, planes).T).tobytes(), 1)


def _narrow(raw: bytes) -> np.ndarray:
    planes = raw[0]
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw[1:]), np.uint8).reshape(planes, -1).T).view(f"<u{planes}").ravel().astype(np.int64)


def gather(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each place, one after the other."""
    total = int(sizes.sum())
    if not total:
        return flat[:0]
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return flat[shift + np.arange(total)]


def _once(shared, pattern: str):
    """Lists of pre-tokens as lists of their ids; a task encodes each pre-token once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        known: dict[bytes, bytes] = {}
        for b in batches:
            out = []
            for raw in b.column(2).to_pylist():
                sizes, flat = unpack(raw)
                ids, at = [], 0
                for size in sizes.tolist():
                    word, at = flat[at : at + size], at + size
                    if (found := known.get(word)) is None:
                        if len(known) >= KNOWN_WORDS:
                            known.clear()
                        found = known[word] = np.array(bpe._encode_single_piece(word), np.uint32).tobytes()
                    ids.append(found)
                out.append(pack(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["block", "bucket", "words"])

    return run


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's ids, by looking up its block's codes."""
    for b in batches:
        for row in range(b.num_rows):
            doc_ids, lengths, codes, dealt, lists = (b.column(k)[row].as_py() for k in range(1, 6))
            codes, dealt = _narrow(codes), _narrow(dealt)
            have = {x["bucket"]: unpack(x["words"]) for x in lists or []}
            some, expected = np.unique(dealt, return_counts=True)
            if sorted(have) != some.tolist() or [len(have[i][0]) for i in some.tolist()] != expected.tolist():
                raise ValueError("a block's lists do not fit its codes")
            by_bucket = np.argsort(dealt, kind="stable")
            own = [have[i] for i in some.tolist()]
            sizes = np.zeros(len(dealt), np.int64)
            starts = sizes.copy()
            sizes[by_bucket] = np.concatenate([x[0] for x in own]) // 4 if own else sizes
            starts[by_bucket] = np.concatenate([[0], np.cumsum(sizes[by_bucket])])[:-1]
            flat = np.frombuffer(b"".join(x[1] for x in own), "<u4")
            first, done = 0, ([], [], [])
            held = 0
            for doc_id, n in zip(doc_ids, lengths, strict=True):
                ids = gather(starts[codes[first : first + n]], sizes[codes[first : first + n]], flat)
                for column, x in zip(done, (doc_id, len(ids), ids.tobytes()), strict=True):
                    column.append(x)
                first, held = first + n, held + 4 * len(ids)
                if held >= BATCH_BYTES:
                    yield _ids(done)
                    done, held = ([], [], []), 0
            yield _ids(done)


def _ids(columns: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "n_tokens", "ids"])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids) of docs (doc_id, text); ids are little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast(ranks)  # as large as the vocabulary
    blocks = bucketed(texts_of(docs).mapInArrow(_blocks(buckets, pattern), BLOCKS), "block", buckets)
    lists = blocks.select("block", F.explode(F.arrays_zip("buckets", "words")).alias("e")).select("block", F.col("e.buckets").alias("bucket"), "e.words")
    encoded = lists.repartition(buckets, "bucket").mapInArrow(_once(shared, pattern), LISTS)
    back = encoded.groupBy("block").agg(F.collect_list(F.struct("bucket", "words")).alias("ids"))  # a list for each bucket
    joined = blocks.select("block", "doc_ids", "lengths", "codes", "dealt").join(back, "block", "left")
    return joined.mapInArrow(_together, "doc_id long, n_tokens long, ids binary")


def decode(tokens: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """tokens with a column ``ids`` and, added, ``decoded``: the bytes of the ids by the token-byte table."""
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b""] * (max(shared.value.values(), default=-1) + 1)
        for word, i in shared.value.items():
            table[i] = word
        sizes = np.fromiter(map(len, table), np.int64, len(table))
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        flat = np.frombuffer(b"".join(table), np.uint8)
        for b in batches:
            column = b.column(b.schema.get_field_index("ids"))
            out = []
            for raw in column:
                ids = np.frombuffer(raw.as_buffer(), "<u4") if raw.is_valid else np.zeros(0, "<u4")
                out.append(gather(starts[ids], sizes[ids], flat).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(join, f"{kinds}, decoded binary")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    ranks = load_ranks(public_tokenizers.path(RANKS))
    out = decode(encode(read(spark, sf_dir, "documents"), ranks), ranks)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
