"""WARC records in ZIP packages: written, located by their directories, range-read.

A package is a ZIP file whose members are stored, not deflated: ``archive/*.warc.gz``
(one gzip member a record) and ``indexes/index.jsonl`` (a line a record: its member,
offset and length there). The reader never extracts a package. It reads the end of
the file (end-of-central-directory record and, where a field overflows, the ZIP64
record), then the central directory, then the index, and last the records' own
byte ranges, many neighbouring ones by one read.

Packages are closed at ``ARCHIVE_BYTES``; a larger corpus makes more of them. A task
that is run again writes packages under new names; only names that a finished task
returned are in the manifest, so a lost executor leaves unlisted files at worst.

Cases: null payloads are empty ones; null urls have no target header, line ends in urls are
percent-encoded; null page ids
take part, but never as the record that others refer to unless every id of their group
is null. Rows that repeat the smallest page id of a group are responses, all of them.
An empty table makes no package and no row.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, fresh_path, read, salted

ARCHIVE_BYTES = 48 << 20
MEMBER_BYTES = 12 << 20
RANGE_BYTES = 4 << 20
#: Bytes of records that a task reads back at most, on average.
TASK_BYTES = 64 << 20
INDEX = "indexes/index.jsonl"
_URN = "urn:archspark:page:"
_OTHER = "urn:archspark:record:"

MANIFEST = "archive string, records long, bytes long"
MEMBERS = "archive string, member string, data_offset long, size long, compressed boolean"
RANGES = "archive string, member string, start long, offsets array<long>, lengths array<long>"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC 1.1 record: a response, or where refers_to is given a revisit without payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = f"{_URN}{page_id}" if page_id is not None else f"{_OTHER}{uuid.uuid4()}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class _Package:
    """A package as it is written, from first to last byte."""

    def __init__(self, folder: str, archive_bytes: int, member_bytes: int):
        self.path, self.limit, self.member_limit = f"{folder}/{uuid.uuid4().hex}.wacz", archive_bytes, member_bytes
        store, place = fs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        self.out = store.open_output_stream(f"{place}/{self.path.rsplit('/', 1)[1]}")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member, self.name, self.at, self.total, self.members, self.index = None, "", 0, 0, 0, []

    def _turn(self) -> None:
        if self.member:
            self.member.close()
        self.name, self.at = f"archive/data-{self.members:05d}.warc.gz", 0
        self.member, self.members = self.zip.open(self.name, "w", force_zip64=True), self.members + 1

    def add(self, page_id: int | None, raw: bytes) -> None:
        if self.member is None or self.at >= self.member_limit:
            self._turn()
        packed = _gzip(raw)
        self.member.write(packed)
        self.index.append(json.dumps({"filename": self.name, "offset": self.at, "length": len(packed), "page_id": page_id}))
        self.at, self.total = self.at + len(packed), self.total + len(packed)

    @property
    def full(self) -> bool:
        return self.total >= self.limit

    def close(self) -> tuple[str, int, int]:
        if self.member:
            self.member.close()
        self.zip.writestr(INDEX, "\n".join(self.index))
        self.zip.close()
        self.out.close()
        return self.path, len(self.index), self.total


def write_packages(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, member_bytes: int = MEMBER_BYTES) -> DataFrame:
    """pages (page_id, url, payload binary, refers_to) into packages below folder; the manifest of what was written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, package = [], None
        for b in batches:
            for i in range(b.num_rows):
                page_id, url, payload, refers_to = (b.column(k)[i].as_py() for k in range(4))
                package = package or _Package(folder, archive_bytes, member_bytes)
                package.add(page_id, record(page_id, url, payload or b"", refers_to))
                if package.full:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        a, n, size = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(n, pa.int64()), pa.array(size, pa.int64())], names=["archive", "records", "bytes"])

    return cut(pages.select("page_id", "url", "payload", "refers_to").mapInArrow(write, MANIFEST), "manifest")


# --- reading ----------------------------------------------------------------------


def _open(path: str) -> pa.NativeFile:
    store, place = fs.FileSystem.from_uri(path)
    return store.open_input_file(place)


def directory(f: pa.NativeFile) -> list[tuple[str, int, int, bool]]:
    """(name, first data byte, size, compressed) of a ZIP file's members, from its directories."""
    size = f.size()
    tail = f.read_at(min(size, 65_557), size - min(size, 65_557))
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    _, _, _, count, length, start = struct.unpack("<HHHHII", tail[at + 4 : at + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        eocd = size - len(tail) + at
        magic, _, where, _ = struct.unpack("<4sIQI", f.read_at(20, eocd - 20))
        if magic != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        wide = f.read_at(56, where)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", wide[32:56])
    raw, p, out = f.read_at(length, start), 0, []
    for _ in range(count):
        if raw[p : p + 4] != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        flags, method = struct.unpack("<HH", raw[p + 8 : p + 12])
        packed, plain, n, m, k = struct.unpack("<IIHHH", raw[p + 20 : p + 34])
        (local,) = struct.unpack("<I", raw[p + 42 : p + 46])
        name = raw[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = raw[p + 46 + n : p + 46 + n + m], 0
        while q + 4 <= len(extra):
            tag, width = struct.unpack("<HH", extra[q : q + 4])
            if tag == 1:
                r = q + 4
                if plain == 0xFFFFFFFF:
                    (plain,), r = struct.unpack("<Q", extra[r : r + 8]), r + 8
                if packed == 0xFFFFFFFF:
                    (packed,), r = struct.unpack("<Q", extra[r : r + 8]), r + 8
                if local == 0xFFFFFFFF:
                    (local,) = struct.unpack("<Q", extra[r : r + 8])
            q += 4 + width
        head = f.read_at(30, local)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("a broken local header")
        n_local, m_local = struct.unpack("<HH", head[26:30])
        out.append((name, local + 30 + n_local + m_local, packed, method != 0))
        p += 46 + n + m + k
    return out


def members(archives: DataFrame) -> DataFrame:
    """The members of each package (column archive), from its central directory."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path in b.column("archive").to_pylist():
                with _open(path) as f:
                    rows += [(path, *m) for m in directory(f)]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["archive", "member", "data_offset", "size", "compressed"])

    return archives.select("archive").mapInArrow(look, MEMBERS)


def ranges(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Runs of records that lie side by side, from the packages' indexes; offsets are the file's own."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("archive").to_pylist():
                with _open(path) as f:
                    found = {m[0]: m for m in directory(f)}
                    if INDEX not in found:
                        raise ValueError(f"{path} has no index")
                    if any(m[3] for m in found.values() if m[0].startswith(("archive/", "indexes/"))):
                        raise ValueError(f"{path}: archive members must be stored")
                    _, at, size, _ = found[INDEX]
                    lines = f.read_at(size, at).decode().splitlines()
                rows, run = [], None
                for x in map(json.loads, lines):
                    begin = found[x["filename"]][1] + x["offset"]
                    if run is None or run[1] != x["filename"] or begin + x["length"] - run[2] > range_bytes:
                        run = (path, x["filename"], begin, [], [])
                        rows.append(run)
                    run[3].append(begin)
                    run[4].append(x["length"])
                kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["archive", "member", "start", "offsets", "lengths"])

    return archives.select("archive").mapInArrow(plan, RANGES)


def parse(raw: bytes) -> tuple[int | None, str | None, bytes, int, str, str, int | None]:
    """A RECORDS row from a record's own gzip member."""
    text = zlib.decompress(raw, 31)
    head, _, block = text.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = dict(x.split(": ", 1) for x in lines)
    block = block[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = named["WARC-Payload-Digest"].removeprefix("sha1:"), named["WARC-Type"]
    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"record {named['WARC-Record-ID']} does not have the payload that its header states")
    number = lambda name: int(x) if (x := named.get(name, "").strip("<>").removeprefix(_URN)).lstrip("-").isdigit() else None
    return number("WARC-Record-ID"), named.get("WARC-Target-URI"), payload, length, digest, kind, number("WARC-Refers-To")


def read_records(archives: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """Every record of the packages (column archive), read by its byte range.

    A revisit has no payload of its own; its length and digest are those in its headers. Ranges are dealt to at
    least one task for each TASK_BYTES, where archives state their bytes as a manifest does.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for b in batches:
            for i in range(b.num_rows):
                path, _, start, offsets, lengths = (b.column(k)[i].as_py() for k in range(5))
                with _open(path) as f:
                    raw = f.read_at(offsets[-1] + lengths[-1] - start, start)
                rows = [parse(raw[o - start : o - start + n]) for o, n in zip(offsets, lengths, strict=True)]
                columns = [pa.array([r[k] if k != 2 or payloads else None for r in rows], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    runs = ranges(archives, range_bytes)
    total = archives.agg(F.sum("bytes")).first()[0] or 0 if "bytes" in archives.columns else 0
    tasks = max(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    return runs.repartition(tasks, "archive", "start").mapInArrow(fetch, RECORDS)


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads, that with the smallest page id is the one referred to.

    Payloads are equal if their SHA-256 and lengths are. A payload that most pages have is no hot key (``salted``).
    """
    bound_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("__same", F.concat(F.sha2("payload", 256), F.octet_length("payload").cast("string")))
    first = rows.groupBy("__same").agg(F.min("page_id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    known = salted(rows.withColumn("__place", F.xxhash64("page_id", "url")), first, "__same", "__n", pages.count(), "__place")
    return known.select("page_id", "url", "payload", F.expr("case when __first is not null and not (page_id <=> __first) then __first end").alias("refers_to"))


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record in ZIP packages, read back by byte ranges."""
    manifest = write_packages(with_revisits(read(spark, sf_dir, "pages")), fresh_path(spark, "packages"))
    return read_records(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE = f"""
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as hex from pages
), chunks as (
  select page_id, payload_bytes, hex, g, cast('0x' || substr(hex, 1 + 5 * g, 5) as bigint) as v
  from p cross join (select unnest(range(8)) as g)
), coded as (
  select page_id, payload_bytes, hex, string_agg(
    substr('{_DIGITS}', cast(v // 32768 as int) + 1, 1) || substr('{_DIGITS}', cast(v // 1024 % 32 as int) + 1, 1)
    || substr('{_DIGITS}', cast(v // 32 % 32 as int) + 1, 1) || substr('{_DIGITS}', cast(v % 32 as int) + 1, 1), '' order by g) as payload_digest
  from chunks group by page_id, payload_bytes, hex
), firsts as (select *, min(page_id) over (partition by hex) as f from coded)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when page_id = f then 'response' else 'revisit' end as record_type,
  case when page_id <> f then f end as refers_to
from firsts
"""
