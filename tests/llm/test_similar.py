"""Near-duplicates, vectors and components, against brute force on small fixtures."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from archspark.llm import ann_forest, common, graph, lattice, minhash


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


# --- words and shingles ---------------------------------------------------------------

TEXTS = ["", " \t\n", "One", "one", "one two", "Two  one", "ONE\x0btwo\r\nthree", "a b a b a b", "É é", "x" * 5000 + " y", "nul\x00byte two\u00a0words", "tail "]


def plain_shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize("k", [1, 2, 5])
@pytest.mark.parametrize("run", [1 << 21, 7])
def test_shingle_sets(k, run, monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", run)
    raw = [t.encode() for t in TEXTS]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    sets = common.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), offsets, k)
    known = {}
    for t, s in zip(TEXTS, sets, strict=True):
        assert len(s) == len(plain_shingles(t, k)) and (np.diff(s.astype(object)) > 0).all()
        assert known.setdefault(frozenset(plain_shingles(t, k)), s.tobytes()) == s.tobytes()
    assert len(set(known.values())) == len(known)


def hashes_of(texts):
    raw = [t.encode() for t in texts]
    return common.words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))[0].tolist()


def test_words_that_collide_modulo_powers_of_two():
    """Thue-Morse words: any polynomial modulo 2^64 with an odd base takes these for one."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    assert len({*hashes_of([a, b])}) == 2 and hashes_of([a.upper()]) == hashes_of([a])


def test_long_words_are_hashed_in_pieces(monkeypatch):
    word = "".join(chr(97 + i * i % 23) for i in range(5000))
    whole = hashes_of(["x " + word + " y " + word])
    monkeypatch.setattr(common, "SLICE_BYTES", 64)
    assert hashes_of(["x " + word + " y " + word]) == whole and whole[1] == whole[3] != whole[0]
    assert [int(x) for x in common._times(np.array([common._PRIME - 1, 0, 5], np.uint64), common._PRIME - 2)] == [(common._PRIME - 1) * (common._PRIME - 2) % common._PRIME, 0, 5 * (common._PRIME - 2) % common._PRIME]


def test_documents_of_unlike_words_are_not_linked(spark):
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, a), (2, a.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 2).collect()} == {(1, 1, True), (2, 2, True)}


@pytest.mark.parametrize("hot", [2, 1000])
def test_salted_join(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(90)], "k long, x long")
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m > 1 or k > 50")
    got = sorted(map(tuple, common.salted(rows, sizes, "k", "m", 90, "x").select("k", "x", "m").collect()))
    assert got == sorted((k, i, 60 if k == 1 else 1) for i in range(90) for k in [1 if i % 3 else i] if k == 1 or k > 50)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = np.unique(base[:3000]), np.unique(base[1000:])
    s = minhash.signatures([a, b, a[:1]])
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.12
    assert (s[2][: minhash.PERMUTATIONS] == s[2][minhash.PERMUTATIONS :]).all()
    assert (minhash.band_keys(s)[0] == minhash.band_keys(s[:1])[0]).all()


# --- near-duplicate documents ----------------------------------------------------------


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(5000)
    texts = [" ".join(word() for _ in range(rng.randrange(1, 200))) for _ in range(n)]
    for _ in range(n):
        copy = rng.choice(texts).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    hub = [word() for _ in range(120)]
    for _ in range(60):  # many that resemble the hub and not each other
        copy = list(hub)
        for _ in range(5):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(hub)] * 5 + ["", None, " \n", "Single", "single", "other"]
    rng.shuffle(texts)
    return texts


def plain_components(texts, k, percent=80):
    sets = [plain_shingles(t, k) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return sets, roots(range(len(sets)), links)


@pytest.mark.parametrize("k, block, few", [(2, 512, 0), (5, 512, 10**6), (2, 16, 10**6)])
def test_near_duplicates(spark, monkeypatch, k, block, few):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(graph, "FEW", few)
    monkeypatch.setattr(common, "HOT", 10 if few else 1000)
    if block == 16:
        monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 900)
    texts = corpus(k, 120)
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, rep string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, k).collect()}
    sets, want = plain_components(texts, k)
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in range(len(texts))}


def test_duplicates_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "A  b c"), (3, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 2).collect())
    assert got == Counter({(1, 2, 1, True): 2, (None, 2, None, False): 1, (2, 2, 1, False): 1, (3, 0, 3, True): 1})
    assert minhash.near_duplicates(docs.limit(0), 2).count() == 0


def test_each_text_of_a_repeated_id_links(spark):
    """Ids 2, 4, ... have a far and a near text; near copies of both have ids of their own."""
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(0, 40, 4):
        far, near = ([f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(2))
        rows += [(i + 1, " ".join(far)), (i + 1, " ".join(near)), (i + 2, " ".join([*far, "x"])), (i + 3, " ".join([*near, "y"]))]
        want |= {i + 1: i + 1, i + 2: i + 1, i + 3: i + 1}
    rng.shuffle(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert len(got) == len(rows) and all(r.component_id == want[r.doc_id] for r in got)


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(2000, 2050)] + [(7, 7)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    used = {x for a, b in links if a != b for x in (a, b)}
    assert got == roots(used, [p for p in links if p[0] != p[1]])
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- vectors ----------------------------------------------------------------------------


def clusters(seed, n, dim=64, noise=0.017):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x[rng.integers(0, n // 8, n)] + noise * rng.standard_normal((n, dim))
    return np.concatenate([x, y * rng.uniform(0.1, 9, (n, 1)), x[:20]]).astype(np.float32)


ODD = [(None, 1), ([], 1), ([0.0] * 64, 1), ([float("nan")] + [1.0] * 63, 1), ([float("inf")] + [1.0] * 63, 1), ([None] + [1.0] * 63, 1), ([1.0] * 64, None), ([1.0] * 3, 1), ([2.0] * 3, 1)]


@pytest.mark.parametrize("block", [512, 32])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    x = clusters(3, 300)
    labels = [i % 2 for i in range(len(x))]
    rows = [(i, v.tolist(), lab, 1) for i, (v, lab) in enumerate(zip(x, labels, strict=True))] + [(10_000 + i, v, lab, 1) for i, (v, lab) in enumerate(ODD)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, size int")).collect()}
    cos = ann_forest.cosines(x, x)
    near = (cos >= 0.98) & (np.equal.outer(labels, labels)) & ~np.eye(len(x), dtype=bool)
    links = [*np.argwhere(near).tolist(), (10_007, 10_008)]
    want = roots([r[0] for r in rows], links)
    counts = Counter(dict(enumerate(near.sum(axis=1)))) + Counter({10_007: 1, 10_008: 1})
    assert near.sum() > 1000
    assert got == {i: (counts[i], want[i], want[i] == i) for i in want}


def test_vectors_of_a_repeated_id_stay_apart(spark):
    """Rows that repeat an id are vectors like others, in one label and in two."""
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near_x, near_y = [1.0, 0.01, 0.0], [0.01, 1.0, 0.0]
    schema = "vec_id long, embedding array<float>, label int, id long, rep long"
    got = lattice.near_vectors(spark.createDataFrame([(1, x, 0, 5, 5), (1, y, 0, 5, 5), (2, near_x, 0, 5, 5), (3, near_y, 0, 5, 5)], schema)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
    got = lattice.near_vectors(spark.createDataFrame([(1, x, 0, 5, 5), (1, y, 1, 5, 5), (2, near_x, 0, 5, 5), (3, near_y, 0, 5, 5)], schema)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    got = lattice.near_vectors(spark.createDataFrame([(1, x, 0, 5, 5)] * 3 + [(4, x, 0, 5, 5)], schema)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 3, 1)] * 3 + [(4, 3, 1)]


def test_cells_are_joined_with_salt(spark, monkeypatch):
    """A cell with most rows is dealt to all partitions where it meets its size; results stay."""
    monkeypatch.setattr(lattice, "BLOCK", 16)
    monkeypatch.setattr(common, "HOT", 4)
    rng = np.random.default_rng(2)
    x = np.array([1.0] * 8) + 0.01 * rng.standard_normal((150, 8))
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    assert {(r.n_links, r.component_id) for r in lattice.near_vectors(rows).collect()} == {(149, 0)}


def test_near_vectors_none(spark):
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    got = lattice.near_vectors(spark.createDataFrame([(None, [1.0], 1), (4, [1.0], 1)], "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got) == [("4", 0, 4, True), ("None", 0, None, False)]


@pytest.mark.parametrize("dim", [2, 8, 16, 64])
def test_few_near_pairs_share_no_cell(dim):
    rng = np.random.default_rng(dim)
    a = ann_forest.unit(rng.standard_normal((4000, dim)))
    d = rng.standard_normal(a.shape)
    d = ann_forest.unit(d - (d * a).sum(axis=1)[:, None] * a)
    here, there = (lattice.cells(x, np.zeros(len(a), np.uint64)) for x in (a, 0.98 * a + (1 - 0.98**2) ** 0.5 * d))
    met = ((here == there[:, :, :1]).any(axis=2) | (there == here[:, :, :1]).any(axis=2)).any(axis=1)
    assert (~met).sum() <= 3


def test_lattice_points_are_nearest():
    x = np.random.default_rng(2).normal(0, 1.5, (200, 8))
    point = lattice.e8(x)
    doubled = np.rint(2 * point).astype(int)
    assert ((doubled % 2).min(axis=1) == (doubled % 2).max(axis=1)).all() and (point.sum(axis=1) % 2 == 0).all()
    for step in lattice.shortest():
        assert (((x - point) ** 2).sum(axis=1) <= ((x - point - step) ** 2).sum(axis=1) + 1e-9).all()
    assert lattice.shortest().shape == (240, 8) and np.allclose((lattice.shortest() ** 2).sum(axis=1), 2)


def brute_nearest(ids, x, query_id, query, k):
    own = [(-s, i) for s, i in zip(ann_forest.cosines(query[None], x)[0], ids, strict=True) if i != query_id]
    return sorted(own)[:k]


def test_forest_recall(spark):
    x = clusters(4, 1500)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(90_000 + 50 * i, v, 1) for i, (v, _) in enumerate(ODD)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = ann_forest.nearest(table, table.where("vec_id % 50 = 0"), 5, block_rows=900, query_bytes=20 * 64 * 8).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((-r.score, r.vec_id, r.rank))
    hit = total = 0
    for q in range(0, len(x), 50):
        want = brute_nearest(range(len(x)), x, q, x[q], 5)
        assert [r for _, _, r in by[q]] == [1, 2, 3, 4, 5] and by[q] == sorted(by[q])
        for score, i, _ in by[q]:
            assert abs(-score - ann_forest.cosines(x[q][None], x[i][None])[0, 0]) < 1e-12
        hit, total = hit + len({i for _, i in want} & {i for _, i, _ in by[q]}), total + 5
    assert hit / total >= 0.9
    assert {q: [i for _, i, _ in v] for q, v in by.items() if q >= 90_000} == {90_350: [90_400], 90_400: [90_350], 90_300: by[90_300] and [i for _, i, _ in by[90_300]]}


def test_forest_recall_on_the_registered_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding is not null").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows])
    got = {}
    for r in ann_forest.op2_hash_prefix_forest(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = {q: {i for _, i in brute_nearest(ids, x, q, x[ids.index(q)], 5)} for q in ids if q % 50 == 0}
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len(got[q] & want[q]) for q in want) / (5 * len(want)) >= 0.9


def test_cosines_of_huge_and_tiny_vectors():
    x = np.array([[1e200, 1e200], [1e-200, 0.0], [3.0, 4.0]])
    assert np.allclose(ann_forest.cosines(x, x), [[1, 2**-0.5, 7 / 50**0.5], [2**-0.5, 1, 0.6], [7 / 50**0.5, 0.6, 1]])


def test_repeated_rows_are_dealt_to_blocks(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0])] * 3000 + [(2, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert ann_forest.index(table, block_rows=500).selectExpr("max(octet_length(ids) / 8)").first()[0] < 700
    got = ann_forest.nearest(table, table.where("vec_id = 2"), 5, block_rows=500).collect()
    assert [(r.rank, r.vec_id) for r in got] == [(i, 1) for i in range(1, 6)]


def test_long_vectors(spark):
    rng = np.random.default_rng(5)
    table = spark.createDataFrame([(i, rng.standard_normal(3000).tolist()) for i in range(20)], "vec_id long, embedding array<double>")
    assert ann_forest.nearest(table, table.where("vec_id = 3"), 4).count() == 4


def test_forest_ties_and_few(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (9, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (7, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann_forest.nearest(table, table.where("vec_id = 0"), 5).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 9)) for r in got] == [(3, 1.0), (7, 1.0), (9, 1.0), (4, 0.0)]
    assert ann_forest.nearest(table.limit(0), table, 5).count() == 0 and ann_forest.nearest(table, table.limit(0), 5).count() == 0


def test_equal_vectors_tie_over_blocks(spark):
    """Forty vectors, a hundred rows each, over many blocks and two groups of queries: nearest first, then by id."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((40, 24)).astype(np.float32)
    order = rng.permutation(4000)
    rows = [(int(i), x[k % 40].tolist(), 7, "q") for k, i in enumerate(order)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, query_id string")
    got = ann_forest.nearest(table, table.where("vec_id % 100 = 0"), 5, block_rows=300, query_bytes=20 * 200).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
    equal = {}
    for k, i in enumerate(order.tolist()):
        equal.setdefault(k % 40, []).append(i)
    of = {i: k for k, v in equal.items() for i in v}
    assert set(by) == set(range(0, 4000, 100))
    for q, found in by.items():
        assert [r.vec_id for r in found] == [i for i in sorted(equal[of[q]]) if i != q][:5]
        assert len({r.score for r in found}) == 1


def test_a_score_does_not_depend_on_what_stands_beside():
    rng = np.random.default_rng(9)
    a, b = rng.standard_normal((2, 500, 67))
    whole = ann_forest.pair_cosines(a, b)
    for k in range(0, 500, 7):
        assert whole[k] == ann_forest.pair_cosines(a[k : k + 1], b[k : k + 1])[0] == ann_forest.pair_cosines(b[k - 1 : k + 2], a[k - 1 : k + 2])[min(k, 1) if k else 0] if k else True
