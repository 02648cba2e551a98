"""Repositories by url as a table: a Python data source with a partition for each repository.

A task makes a bare, shallow clone in the folder that the cluster shares, reads the tree and the contents that are wanted
from its object store, and removes it; nothing is checked out, and no folder of the driver takes part. Directories are pruned
as in walks of trees on disk (``sources.tree``), with the same columns. A repository that can't be fetched is one row, of its root, with an ``error``;
symbolic links are entries with one. A task that runs again clones again.

Executors need ``git``. A token for a host is taken from the environment of the executor and
passed on in git's own environment, never in an argument.
"""

from __future__ import annotations

import base64
import os
import shutil
import subprocess
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import values as V
from .storage import fresh_path
from .tree import SCHEMA, batched, is_wanted, looks_vendored, skips_dir

_HOST = "https://github.com/"


class Remote(InputPartition):
    """A repository to fetch; ref is a branch or tag, or HEAD."""

    def __init__(self, name: str, url: str, ref: str):
        super().__init__(None)
        self.name, self.url, self.ref = name, url, ref or "HEAD"


@dataclass
class _Entry:
    """An entry of a tree object, in the shape of a directory entry."""

    name: str
    kind: str
    object_id: str
    size: int

    def is_dir(self) -> bool:
        return self.kind in ("tree", "commit")


def environment(url: str) -> dict[str, str]:
    """git's environment for a url: it never asks, and knows the host's token if there is one."""
    env = dict(os.environ) | {"GIT_TERMINAL_PROMPT": "0"}
    if (token := env.get("GITHUB_TOKEN")) and url.startswith(_HOST):  # by the environment, which other users can't read
        known = base64.b64encode(f"x-access-token:{token}".encode()).decode()
        env |= {"GIT_CONFIG_COUNT": "1", "GIT_CONFIG_KEY_0": f"http.{_HOST}.extraHeader", "GIT_CONFIG_VALUE_0": f"Authorization: Basic {known}"}
    return env


def _listed(store: str) -> dict[str, list[_Entry]]:
    """Directory -> its entries by name, of the whole tree."""
    raw = subprocess.run(["git", "--git-dir", store, "ls-tree", "-r", "-t", "-z", "--long", "HEAD"], capture_output=True, check=True).stdout
    found: dict[str, list[_Entry]] = {}
    for line in raw.split(b"\0")[:-1]:
        facts, path = line.split(b"\t", 1)
        mode, kind, object_id, size = facts.decode().split()
        folder, _, name = path.decode("utf-8", "replace").rpartition("/")
        found.setdefault(folder, []).append(_Entry(name, "link" if mode == "120000" else kind, object_id, int(size) if size != "-" else 0))
    for entries in found.values():
        entries.sort(key=lambda e: e.name)
    return found


class _Contents:
    """Contents by object id, from one process."""

    def __init__(self, store: str):
        self.process = subprocess.Popen(["git", "--git-dir", store, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def __enter__(self) -> _Contents:
        return self

    def __exit__(self, *_) -> None:
        self.process.stdin.close()
        self.process.stdout.close()
        self.process.wait()

    def of(self, object_id: str) -> bytes:
        self.process.stdin.write(f"{object_id}\n".encode())
        self.process.stdin.flush()
        size = int(self.process.stdout.readline().split()[2])
        raw = self.process.stdout.read(size)
        self.process.stdout.read(1)
        return raw


def _rows(repo: str, store: str, max_size: int) -> Iterator[tuple]:
    tree, todo = _listed(store), [""]
    with _Contents(store) as contents:
        while todo:
            rel = todo.pop()
            entries = tree.get(rel, [])
            for e in entries:
                path = f"{rel}/{e.name}" if rel else e.name
                if e.is_dir():
                    if not skips_dir(e.name):
                        yield repo, path, rel, e.name, True, None, None, None
                elif e.kind == "link":
                    yield repo, path, rel, e.name, False, e.size, None, "a symbolic link"
                else:
                    yield repo, path, rel, e.name, False, e.size, contents.of(e.object_id) if is_wanted(e.name, e.size, max_size) else None, None
            if not (rel and looks_vendored(entries)):
                todo += [f"{rel}/{e.name}" if rel else e.name for e in entries if e.kind == "tree" and not skips_dir(e.name)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        lines = lambda key: options[key].split("\n")
        self.remotes = [Remote(*r) for r in zip(lines("names"), lines("urls"), lines("refs"), strict=True)]
        self.folder, self.max_size = options["folder"], int(options.get("maxfilesize", V.MAX_FILE_SIZE))

    def partitions(self) -> list[InputPartition]:
        return self.remotes

    def read(self, partition: Remote) -> Iterator[pa.RecordBatch]:
        return batched(self._entries(partition))

    def _entries(self, partition: Remote) -> Iterator[tuple]:
        store = os.path.join(self.folder, uuid.uuid4().hex)
        branch = [] if partition.ref == "HEAD" else ["--branch", partition.ref]
        try:
            os.makedirs(self.folder, exist_ok=True)
            done = subprocess.run(["git", "clone", "--quiet", "--bare", "--depth", "1", *branch, "--", partition.url, store], capture_output=True, text=True, env=environment(partition.url))
            if done.returncode:
                yield partition.name, "", "", "", True, None, None, f"{partition.name} could not be cloned: {done.stderr.strip()[-500:]}"
                return
            yield from _rows(partition.name, store, self.max_size)
            raw = f'[remote "origin"]\n\turl = {partition.url}\n'.encode()
            yield partition.name, ".git/config", ".git", "config", False, len(raw), raw, None
        except (OSError, subprocess.CalledProcessError) as e:
            yield partition.name, "", "", "", True, None, None, f"{partition.name} could not be read: {e}"
        finally:
            shutil.rmtree(store, ignore_errors=True)


class Repositories(DataSource):
    """``spark.read.format("git_repositories")`` with options names, urls, refs (lines), folder and maxFileSize."""

    @classmethod
    def name(cls) -> str:
        return "git_repositories"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_repositories(spark: SparkSession, remotes: list[tuple[str, str, str | None]], max_file_size: int = V.MAX_FILE_SIZE) -> DataFrame:
    """Entries of the repositories (name, url, ref), each fetched and read by a task."""
    if not remotes:
        raise ValueError("no repositories given")
    folder = fresh_path(spark, "fetched")
    if not folder.startswith(("file:", "/")):
        raise ValueError("repositories are fetched into a mounted folder; spark.checkpoint.dir names none")
    spark.dataSource.register(Repositories)
    lines = ["\n".join(x or "" for x in column) for column in zip(*remotes, strict=True)]
    reader = spark.read.format("git_repositories").option("folder", folder.removeprefix("file:").replace("//", "/")).option("maxFileSize", str(max_file_size))
    for key, value in zip(("names", "urls", "refs"), lines, strict=True):
        reader = reader.option(key, value)
    return reader.load()
