"""Periodic runs against a plain search."""

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from archspark.llm import periodic


def plain_runs(w, least=24):
    """Every maximal stretch with its smallest period, by the definition."""
    n, found = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((a, z - a, q) for (a, z), q in found.items())


def own_runs(w, least=24):
    w = np.array(w, np.int64)
    counts, _ = periodic.lag_counts(w, np.array([0, len(w)]))
    return periodic.runs_of(w, counts, least)


def made(rng, n, letters, period, times):
    out = []
    while len(out) < n:
        out += [rng.randrange(letters) for _ in range(rng.randrange(40))]
        block = [rng.randrange(letters) for _ in range(rng.randrange(1, period))]
        out += block * rng.randrange(1, times) + block[: rng.randrange(len(block))]
    return out[:n]


@pytest.mark.parametrize("letters", [1, 2, 3, 30])
@pytest.mark.parametrize("n", [23, 24, 100, 700])
def test_runs(letters, n):
    rng = random.Random(n + letters)
    for _ in range(6):
        w = made(rng, n, letters, 30, 8)
        assert own_runs(w) == plain_runs(w)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9)), max_size=8), st.integers(4, 24))
def test_runs_inside_runs(parts, least):
    w = [x for block, times in parts for x in block * times]
    assert own_runs(w, least) == plain_runs(w, least)


@pytest.mark.parametrize("pair_cost", [0.0, 2.0, 1e9])
def test_counts_of_frequent_and_rare_words(monkeypatch, pair_cost):
    """Transforms and pairs count the same matches, text by text."""
    monkeypatch.setattr(periodic, "PAIR_COST", pair_cost)
    monkeypatch.setattr(periodic, "LOT", 50)
    monkeypatch.setattr(periodic, "PLACES", 300)
    rng = random.Random(4)
    texts = [[rng.choice([0, 0, 0, 1, 2, rng.randrange(50)]) for _ in range(n)] for n in (0, 1, 90, 400, 2, 133, 0)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    counts, base = periodic.lag_counts(np.array([x for t in texts for x in t], np.int64), first)
    for t, w in enumerate(texts):
        for q in range(1, len(w) // 3 + 1):
            assert counts[base[t] + q] == sum(a == b for a, b in zip(w, w[q:], strict=False))


def test_one_word_many_times():
    """As many lags match everywhere as a third of the text has; only the first is scanned."""
    assert own_runs([5] * 300_000) == [(0, 300_000, 1)]
    block = list(range(1000))
    assert own_runs(block * 100) == [(0, 100_000, 1000)]


def plain_planted(doc_id, w):
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text):
    w = plain_planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    of = lambda x: sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best if best else (None,) * 3), 1000 * best[1] // best[2] if best else None, of("".join(f"{s},{length},{q}\n" for s, length, q in runs)), of(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_by_plain_search(spark, tmp_path):
    rng = random.Random(9)
    texts = [" ".join(f"w{x}é" for x in made(rng, n, k, 25, 7)) for n in (10, 30, 200, 600) for k in (2, 5, 60) for _ in range(4)]
    texts += ["", " \t\n", "one", "A a " * 40, "\x0b".join(["Ab"] * 24), "x y " * 30, "\x1cz\x00 " * 30, "a " * 23, "  lead" + " b" * 30 + "\n"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "n " * 30), (3, "again " * 50), (3, texts[5]), (700, None)]
    docs = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id long, text string, runs string, collapsed long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in periodic.op13_lag_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((plain_row(i, t) for i, t in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 20


def test_spans_of_the_operator(spark):
    docs = spark.createDataFrame([(1, "x y " + "a b c " * 9 + "end"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    assert [tuple(x) for x in got[1].runs] == [(2, 27, 3)] and got[1].collapsed == "x y a b c end" and got[1].n_words == 30
    assert (got[2].runs, got[2].collapsed, got[2].n_words) == ([], "", 0)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    rng = random.Random(3)
    text = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(300_000)) + " q r" * 1000
    got = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert got.n_words == 302_000 and tuple(got.runs[-1]) == (300_000, 2000, 2)
