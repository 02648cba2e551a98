"""Merkle manifests against plain recursion."""

import random
import zlib
from hashlib import sha256

import pytest

from archspark.llm import merkle


def h(*parts):
    return sha256("".join("-" if p is None else p for p in parts).encode()).hexdigest()


def framed(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """Levels of a tree, the leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def way(levels, at):
    out = []
    for nodes in levels[:-1]:
        first = at // 8 * 8
        run = nodes[first : first + 8]
        out.append((run[: at - first], run[at - first + 1 :]))
        at //= 8
    return out


def fold(x, path):
    for left, right in path:
        x = h(*left, x, *right)
    return x


def plain(rows):
    """The query's rows from (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for doc_id, source, lang, n_chars, text in rows:
        low = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        crc = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        leaf = framed(doc_id, source, lang, n_chars, text)
        other = framed(doc_id, source, lang, n_chars, low) if crc % 3 == 0 else leaf
        groups.setdefault(lang, []).append((doc_id is not None, doc_id, leaf, other))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0], r[1] or 0, r[2]))
    trees = {g: tree([r[2] for r in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for t, g in enumerate(names):
        for k, (_, doc_id, leaf, other) in enumerate(groups[g]):
            path = [*way(trees[g], k), *way(top, t)]
            end = fold(other, path)
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], h(*[x for pair in path for side in pair for x in side]), end, end == top[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, at long, leaf string, part long"


def proven(spark, rows, part_rows):
    df = spark.createDataFrame([(*r, "x", 3, "y", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in merkle.proofs(merkle.leaves_of(df), part_rows).collect()), key=repr)


@pytest.mark.parametrize("part_rows", [7, 50, 100_000])
def test_proofs(spark, monkeypatch, part_rows):
    """Unlike languages, one with most rows; nulls in each column, empty and long texts, repeated ids and rows."""
    rng = random.Random(part_rows)
    rows = [(i, "s", "en", i, f"Text {i} ÄÖ") for i in rng.sample(range(10_000), 333)]
    rows += [(i, None, "de", None, rng.choice(["", "A", "b", None])) for i in range(65)]
    rows += [(3, "s", "fr", 1, "ABC" * 100_000), (None, "s", None, 1, "X"), (None, "s", None, 1, "Y"), (7, "s", None, 1, None), (5, "s", "", 1, "one"), (6, "s", "é", 0, "One")]
    rows += [(9, "s", "en", 1, "Again")] * 40 + [(9, "s", "en", 1, f"Other {i}") for i in range(5)]
    rng.shuffle(rows)
    assert proven(spark, rows, part_rows) == plain(rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_one_language(spark, n):
    rows = [(i, "s", "en", 1, "T") for i in range(n)]
    assert proven(spark, rows, 5) == plain(rows)


def test_many_languages(spark):
    rows = [(i, "s", f"l{i}", 1, "T") for i in range(70)]
    assert proven(spark, rows, 9) == plain(rows)


def test_no_rows(spark):
    assert merkle.proofs(merkle.leaves_of(spark.createDataFrame([], SCHEMA))).count() == 0


def test_nodes_are_those_of_the_tree_once(spark):
    rows = [(i, "s", "en" if i % 5 else "de", 1, f"T{i}") for i in range(700)]
    df = spark.createDataFrame([(*r, "x", 3, "y", 1) for r in rows], SCHEMA)
    made = merkle.manifest(merkle.leaves_of(df), ["doc_id"], part_rows=30)
    got = {}
    for r in made.nodes.collect():
        assert got.setdefault((r.grp, r.level, r.at), r.digest.hex()) and (r.grp, r.level, r.at)
    assert made.nodes.count() == len(got)
    want = {}
    for lang in ("en", "de"):
        levels = tree([framed(*r) for r in rows if r[2] == lang])
        want |= {(f"={lang}", k, i): x for k, nodes in enumerate(levels) if k for i, x in enumerate(nodes)}
    assert got == want


@pytest.mark.parametrize("first", [0, 3, 8, 61])
@pytest.mark.parametrize("cuts", [[1] * 90, [7, 40, 43], [90]])
def test_mountains_carry(first, cuts):
    """However leaves arrive, complete aligned nodes and the peaks are the same."""
    leaves = [sha256(bytes([k])).digest() for k in range(90)]
    range_, at = merkle.Mountains(first), 0
    for c in cuts:
        range_.add(leaves[at : at + c])
        at += c
    got = sorted(range_.end())
    whole = merkle.Mountains(first)
    whole.add(leaves)
    assert got == sorted(whole.end())
    want, level, nodes = set(), 0, dict(enumerate(leaves, first))
    while nodes:
        up = {}
        for k in {i // 8 for i in nodes}:
            run = [nodes.get(8 * k + j) for j in range(8)]
            if None not in run:
                up[k] = merkle.joined(run)
        want |= {(level, k, d, k // 8 not in up) for k, d in nodes.items() if level or k // 8 not in up}
        nodes, level = up, level + 1
    assert set(got) == want
    assert max(sum(1 for r in got if r[3] and r[0] == k) for k in range(level)) <= 14
