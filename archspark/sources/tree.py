"""Source trees as a table: a Python data source that walks directories.

Spark's own file source leaves out names that begin with ``_`` or ``.`` and empty
files, which are part of a source tree. The driver lists directories from the top until there are
``parts`` of them (or none is left); what is below each of the last is a partition, walked and read in a task. The files of a
listed directory are cut into partitions by ranges of names, of at most ``SPLIT_FILES`` files and about ``SPLIT_BYTES`` bytes.
Directories that are never looked at are pruned before the walk goes into them, and contents are read only
for files whose language is known or whose name configures something. What cannot be listed or read is
an entry with an ``error``.

Filters on names, paths, kinds and sizes are given to ``read_tree`` (as ``pyspark.sql.datasource`` has them): what they leave out is not
read, and a repository or a prefix of paths that they ask for bounds the walk. They are options and not taken over from Spark's plans
(``pushFilters``), since Spark 4.1.2 keeps what one query has pushed for later ones on the same DataFrame. Rows leave in Arrow batches of about ``BATCH_BYTES``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith,
)

from .. import values as V

SCHEMA = "repo string, path string, dir string, name string, is_dir boolean, size long, content binary, error string"

ARROW = pa.schema([("repo", pa.string()), ("path", pa.string()), ("dir", pa.string()), ("name", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])

#: Partitions of a repository that the driver's listing is to give; more where the session has more cores.
PARTS = 64
#: A partition of files of one directory.
SPLIT_FILES, SPLIT_BYTES = 2000, 64 << 20
#: A batch of rows.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
_NAMED = {m for m, _, _ in V.MARKERS} | {n for _, names in V.DOC_FILES for n in names} | {"Rakefile", "config.ru"}
_TEXTS = (".md", ".txt", ".rst")


def skips_dir(name: str) -> bool:
    return name in V.SKIP_DIRS or name.startswith(".") or name.endswith(V.SKIP_DIR_SUFFIXES)


def looks_vendored(entries: list[os.DirEntry]) -> bool:
    """A whole foreign project: its own build, a licence, and at least five directories."""
    names = {e.name for e in entries}
    return bool(names & V.BUILD_FILES) and bool(names & V.LICENSE_FILES) and sum(e.is_dir() and not skips_dir(e.name) for e in entries) >= V.VENDORED_DIRS


def extension(name: str) -> str:
    """The suffix in lower case, '' for names like ``.env`` and ``x.``."""
    at = name.rfind(".")
    return name[at:].lower() if 0 < at < len(name) - 1 else ""


def is_wanted(name: str, size: int, max_size: int) -> bool:
    """Whether a file's content is read."""
    ext = extension(name)
    return name in _NAMED or (ext in V.LANGUAGES and size <= max_size) or ext in _TEXTS


class _Part(InputPartition):
    """A directory of a repository with all below it, or alone, of its entries those with names from first to last."""

    def __init__(self, repo: str, root: str, rel: str, deep: bool, first: str | None = None, last: str | None = None):
        super().__init__(None)
        self.repo, self.root, self.rel, self.deep, self.first, self.last = repo, root, rel, deep, first, last

    def has(self, name: str) -> bool:
        return (self.first is None or name >= self.first) and (self.last is None or name <= self.last)


def _size(entry: os.DirEntry) -> int:
    try:
        return 0 if entry.is_dir() else entry.stat().st_size
    except OSError:
        return 0


def name_ranges(sizes: list[tuple[str, int]]) -> list[tuple[str | None, str | None]]:
    """(first, last) names of runs of a directory's entries (name, bytes), which are in order of names; None is open."""
    starts, files, total = [], 0, 0
    for name, size in sizes:
        if files == SPLIT_FILES or (files and total + size > SPLIT_BYTES):
            starts.append(name)
            files = total = 0
        files, total = files + 1, total + size
    if not starts:
        return [(None, None)]
    names = [n for n, _ in sizes]
    ends = [names[names.index(s) - 1] for s in starts]
    return list(zip([None, *starts], [*ends, None], strict=True))


#: What a filter says of a value that is not null; null satisfies none.
_TESTS = {
    EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, StringStartsWith: lambda v, x: v.startswith(x), StringEndsWith: lambda v, x: v.endswith(x), StringContains: lambda v, x: x in v,
    GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x,
}
#: Columns that are known before a file is read.
_KNOWN = ("repo", "path", "dir", "name", "is_dir", "size")


def is_handled(f: Filter) -> bool:
    """Whether a filter can be decided by the reader: columns known before reading, and no order of texts."""
    inner = f.child if isinstance(f, Not) else f
    if isinstance(inner, IsNotNull):
        return not isinstance(f, Not) and inner.attribute in {(c,) for c in _KNOWN}
    ordered = isinstance(inner, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))
    return type(inner) in _TESTS and len(inner.attribute) == 1 and inner.attribute[0] in (("size",) if ordered else _KNOWN)


def holds(f: Filter, row: dict) -> bool:
    inner = f.child if isinstance(f, Not) else f
    value = row[inner.attribute[0]]
    if value is None:
        return False
    return isinstance(inner, IsNotNull) or _TESTS[type(inner)](value, inner.value) != isinstance(f, Not)


def _listed(root: str, rel: str) -> tuple[list[os.DirEntry], str | None]:
    """(entries by name, error)."""
    try:
        with os.scandir(os.path.join(root, rel) if rel else root) as entries:
            return sorted(entries, key=lambda e: e.name), None
    except OSError as e:
        return [], str(e)


def _walked(rel: str, entries: list[os.DirEntry]) -> list[str]:
    """Directories below rel that a walk goes into: none in a foreign project, no links."""
    if rel and looks_vendored(entries):
        return []
    return [f"{rel}/{e.name}" if rel else e.name for e in entries if e.is_dir() and not skips_dir(e.name) and not e.is_symlink()]


_NAMES = {k.__name__: k for k in (*_TESTS, IsNotNull)}


def as_text(filters: Iterable[Filter]) -> str:
    """Filters as an option's value."""
    out = []
    for f in filters:
        if not is_handled(f):
            raise ValueError(f"a tree is not filtered by {f}")
        inner = f.child if isinstance(f, Not) else f
        out.append({"kind": type(inner).__name__, "column": inner.attribute[0], "value": list(inner.value) if isinstance(inner, In) else getattr(inner, "value", None), "negated": isinstance(f, Not)})
    return json.dumps(out)


def from_text(value: str) -> list[Filter]:
    made = []
    for x in json.loads(value):
        kind, at = _NAMES[x["kind"]], (x["column"],)
        inner = kind(at) if kind is IsNotNull else kind(at, tuple(x["value"]) if kind is In else x["value"])
        made.append(Not(inner) if x["negated"] else inner)
    return made


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        names, roots = options["names"].split("\n"), options["roots"].split("\n")
        self.roots = list(zip(names, roots, strict=True))
        self.max_size, self.parts = int(options.get("maxfilesize", V.MAX_FILE_SIZE)), int(options.get("parts", PARTS))
        self.filters = from_text(options.get("filters", "[]"))

    def _asked(self, repo: str) -> bool:
        return all(holds(f, {"repo": repo}) for f in self.filters if (f.child if isinstance(f, Not) else f).attribute == ("repo",))

    def _may_have(self, rel: str) -> bool:
        """Whether entries in or below a directory can be asked for, by what paths must begin with."""
        heads = [f.value for f in self.filters if isinstance(f, StringStartsWith) and f.attribute == ("path",)] + [f.value for f in self.filters if isinstance(f, EqualTo) and f.attribute in (("path",), ("dir",))]
        return all(not rel or f"{rel}/".startswith(h) or h.startswith(f"{rel}/") or h == rel for h in heads)

    def partitions(self) -> list[InputPartition]:
        roots = [(repo, root, "") for repo, root in self.roots if self._asked(repo)]
        wave, done = roots, []
        while wave and len(wave) + len(done) < self.parts * len(roots):
            below = []
            for repo, root, rel in wave:
                entries, _ = _listed(root, rel)
                done += [_Part(repo, root, rel, False, *names) for names in name_ranges([(e.name, _size(e)) for e in entries])]
                below += [(repo, root, x) for x in _walked(rel, entries) if self._may_have(x)]
            wave = below
        return done + [_Part(*at, True) for at in wave]

    def _content(self, path: str, name: str, size: int) -> bytes | None:
        if not is_wanted(name, size, self.max_size):
            return None
        with open(path, "rb") as f:
            return f.read()

    def _wants(self, *known) -> bool:
        row = dict(zip(_KNOWN, known, strict=True))
        return all(holds(f, row) for f in self.filters)

    def _entries(self, part: _Part, rel: str) -> Iterator[tuple]:
        entries, _ = _listed(part.root, rel)
        for e in entries:
            if not (part.deep or part.has(e.name)):
                continue
            path = f"{rel}/{e.name}" if rel else e.name
            if e.is_dir():
                if not skips_dir(e.name) and self._wants(part.repo, path, rel, e.name, True, None):
                    yield part.repo, path, rel, e.name, True, None, None, _listed(part.root, path)[1]
                continue
            size = content = error = None
            try:
                size = e.stat().st_size
                if not self._wants(part.repo, path, rel, e.name, False, size):
                    continue
                content = self._content(e.path, e.name, size)
            except OSError as x:
                error = str(x)
                if not self._wants(part.repo, path, rel, e.name, False, size):
                    continue
            yield part.repo, path, rel, e.name, False, size, content, error
        for below in _walked(rel, entries) if part.deep else ():
            if self._may_have(below):
                yield from self._entries(part, below)

    def _rows(self, partition: _Part) -> Iterator[tuple]:
        yield from self._entries(partition, partition.rel)
        git = os.path.join(partition.root, ".git", "config")
        if not partition.rel and partition.first is None and os.path.isfile(git):
            with open(git, "rb") as f:
                raw = f.read()
            if self._wants(partition.repo, ".git/config", ".git", "config", False, len(raw)):
                yield partition.repo, ".git/config", ".git", "config", False, len(raw), raw, None

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return batched(self._rows(partition))


def batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA in Arrow batches."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[6] or b"")
        if len(held) == BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), ARROW.types, strict=True)], schema=ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), ARROW.types, strict=True)], schema=ARROW)


class SourceTree(DataSource):
    """``spark.read.format("source_tree")`` with options names, roots (lines), maxFileSize, parts and filters."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_tree(spark: SparkSession, roots: dict[str, str], max_file_size: int = V.MAX_FILE_SIZE, filters: Iterable[Filter] = ()) -> DataFrame:
    """Entries of source trees that satisfy all filters. roots: repository name -> directory."""
    if not roots:
        raise ValueError("no repositories given")
    for name, root in roots.items():
        if not os.path.isdir(root):
            raise ValueError(f"{name}: {root} is not a directory")
    spark.dataSource.register(SourceTree)
    parts = max(PARTS, 4 * spark.sparkContext.defaultParallelism)
    return spark.read.format("source_tree").option("parts", str(parts)).option("filters", as_text(filters)).option("names", "\n".join(roots)).option("roots", "\n".join(map(os.path.abspath, roots.values()))).option("maxFileSize", str(max_file_size)).load()


def with_text(entries: DataFrame) -> DataFrame:
    """``content`` as text: invalid UTF-8 replaced, line ends as line feeds."""
    return entries.withColumn("content", F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n"))
