"""Classifiers and the pipeline: held-out accuracy, odd rows, and what a stage keeps."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from archspark.llm import langid, minhash, packing, quality
from archspark.llm.common import fold

SF = "/root/testdata/sf0.01"


def test_fold(spark):
    got = spark.createDataFrame([(i,) for i in [0, 7, -3, 10**12]], "doc_id long").select("doc_id", fold(F.col("doc_id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)


def offsets_of(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def test_measures():
    texts = ["", "Ab cd. Ab\nxy!\nxy!", "12 ü", "\n\n", "a a a a"]
    x = quality.measures(*offsets_of(texts))
    at = {n: x[:, i] for i, n in enumerate(quality.FEATURES)}
    assert x.shape == (5, len(quality.FEATURES)) and not x[0].any() and np.isfinite(x).all()
    assert at["distinct_words"][1] == 3 / 5 and at["distinct_lines"][1] == 2 / 3 and at["capital_words"][1] == 2 / 5 and at["lines_closed"][1] == 2 / 3
    assert at["digit"][2] == 2 / 5 and at["non_ascii"][2] == 2 / 5 and at["repeated_words"][4] == 3 / 4 and at["top_word"][4] == 1
    alone = np.concatenate([quality.measures(*offsets_of([t])) for t in texts])
    assert np.allclose(alone, x)


def test_additive_model_learns_main_effects_and_a_pair():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(6000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    gam = quality.fit(x[:4000], y[:4000])
    assert ((gam.score(x[4000:]) > 0.5) == y[4000:]).mean() > 0.95 and (0, 1) in gam.pairs
    y = (x[:, 2] > 0.3).astype(float)
    assert ((quality.fit(x[:4000], y[:4000]).score(x[4000:]) > 0.5) == y[4000:]).mean() > 0.97
    assert quality.fit(x[:0], y[:0]).score(x[:1])[0] == 0.5
    assert quality.fit(x[:8], np.ones(8)).score(x[:1])[0] == pytest.approx(0.9)


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r.score for r in quality.scored(docs, quality.train(docs, labels)).collect()}
    held = [(got[r.doc_id] >= quality.THRESHOLD, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(got) == 1000 and sum(bool(p) == bool(q) for p, q in held) / len(held) > 0.95


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "x", 0.5), (None, "long " * 50_000, 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.scored(docs, quality.train(docs, none)).collect()
    assert [r.score for r in out] == [0.5] * 4
    assert quality.scored(docs.limit(0), quality.Gam()).count() == 0
    some = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert quality.train(docs, some).score(np.zeros((1, len(quality.FEATURES)))).shape == (1,)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in langid.identified(docs, langid.train(docs)).collect()}
    rows = [r for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_odd_rows(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de", "x") for i in range(60)]
    rows += [(100, None, "en", "x"), (101, "", "en", "x"), (102, "12 34 !?", "de", "x"), (103, "katze und hund", None, "x"), (None, "THE DOG", None, "x"), (104, "die katze " * 30_000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.identified(docs, model).collect()}
    assert [(got[i].lang_pred, got[i].score) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert [got[i].lang_pred for i in (103, None, 104)] == ["de", "en", "de"]
    assert (model.weights == 0).mean() > 0.5 and model.names == ["de", "en"]
    nothing = langid.train(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in langid.identified(docs, nothing).collect()} == {("und", 0.0)}
    assert langid.identified(docs.limit(0), model).count() == 0


def plain_grams(text):
    c = "".join(x if x.isalpha() else " " for x in (text.lower() + "\0"))
    while "  " in c:
        c = c.replace("  ", " ")
    return sum(x != " " for x in c) + max(len(c) - 1, 0) + max(len(c) - 2, 0)


def test_grams():
    texts = ["", "a", "Ab 12  c", "ΣΑΣ", "x" * 300]
    rows, features = langid.grams(texts)
    assert [int((rows == i).sum()) for i in range(len(texts))] == [plain_grams(t) for t in texts]
    assert features.min() >= 0 and features.max() < langid.DIMS
    counts = langid.counted(["ab ab", "ab"])
    assert counts.sum(axis=1).tolist() == [plain_grams("ab ab"), plain_grams("ab")]


@pytest.mark.parametrize("cut", [3, 7, 50])
def test_long_texts_are_counted_in_pieces(cut, monkeypatch):
    rng = random.Random(cut)
    for text in ["ab 1 2  cd", "x" * 99, " 1 " * 40, "".join(rng.choice("aé 1.Σ") for _ in range(400))]:
        whole = langid.counted([text, None])[:1]
        monkeypatch.setattr(langid, "SLICE", cut)
        assert (langid._counted_long(text) == whole).all()
        monkeypatch.undo()


def test_temperature_sharpens_and_flattens():
    rng = np.random.default_rng(1)
    true = rng.normal(size=(4000, 3)) * 2
    y = np.array([rng.choice(3, p=p) for p in langid.softmax(true)])
    assert abs(langid.temperature(true * 4, y) - 4) < 0.6 and abs(langid.temperature(true / 3, y) - 1 / 3) < 0.06


# --- the pipeline -----------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["language ID", "quality classifier", "MinHash near-dedup", "best-fit packing"]
    kept = docs
    for _, stage in p.STAGES[:3]:
        out = stage(spark, kept, "/root/testdata/sf0.001").cache()
        assert out.schema.names == docs.schema.names and out.count() <= kept.count()
        assert out.exceptAll(kept).count() == 0
        kept = out
    packed = p.run(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept.select("doc_id").collect()}


def test_stages_take_odd_tables(spark):
    import corpus_pipeline as p

    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(["and", "the", "house", "river", "tree", "stone"]) for _ in range(60)) + "."
    rows = [(i, text(), "en", "s", 9, "kept") for i in range(30)] + [(40, None, None, None, None, "__kept_id"), (None, text(), "en", "s", 1, None), (3, text(), "en", "s", 1, "again")]
    rows += [(50 + i, rows[0][1], "en", "s", 1, "copy") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ok string")
    kept = p.language_id(spark, docs, "/root/testdata/sf0.001")
    assert kept.schema.names == docs.schema.names and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[1])
    deduped = p.near_dedup(spark, kept, "/root/testdata/sf0.001").collect()
    assert {0, 1, 2}.issubset({r.doc_id for r in deduped}) and not any(r.ok == "copy" for r in deduped)
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
    assert packing.pieces(docs).count() >= len(rows) and minhash.near_duplicates(docs).count() == len(rows)


def test_stages_judge_rows(spark):
    """Null and repeated ids: one row of each group stays, and no row is judged by another's text."""
    import corpus_pipeline as p

    rng = random.Random(6)
    text = lambda: " ".join(rng.choice(["and", "the", "house", "river", "tree", "stone"]) for _ in range(60)) + "."
    a, b, c, d = text(), text(), text(), text()
    rows = [(None, a, "null, unique"), (None, b, "null, copy"), (7, b, "7"), (8, c, "8"), (8, c, "8 again"), (9, d, "9"), (9, text(), "9, other"), (None, "12 34", "no letter"), (9, "56 78", "9, no letter")]
    rows += [(20 + i, text(), "rest") for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", n) for i, t, n in rows], "doc_id long, text string, lang string, name string")
    got = [r.name for r in p.near_dedup(spark, docs, "/root/testdata/sf0.001").collect()]
    assert got.count("8") + got.count("8 again") == 1
    assert {"null, unique", "7", "9", "9, other"}.issubset(got) and "null, copy" not in got
    got = [r.name for r in p.language_id(spark, docs, "/root/testdata/sf0.001").collect()]
    assert {"null, unique", "null, copy", "9"}.issubset(got) and not {"no letter", "9, no letter"} & set(got)


def test_stages_carry_columns_of_any_name(spark):
    """Columns named like inner ones come through; keys of rows are stored, so their order of reading does not matter."""
    import corpus_pipeline as p

    rng = random.Random(7)
    text = lambda: " ".join(rng.choice(["and", "the", "house", "river", "tree", "stone"]) for _ in range(60)) + "."
    rows = [(i, text(), "en", f"r{i}", i, i, "c", 0.1, "und") for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", f"s{i}", 0, 0, "c", 0.9, "x") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `__row` string, `__ROW_` long, salt int, component_id string, score double, lang_pred string")
    for _, stage in p.STAGES[:2]:
        got = stage(spark, docs, "/root/testdata/sf0.001")
        assert got.columns == docs.columns and got.exceptAll(docs).isEmpty()
        kept = [r.doc_id % 100 for r in got.collect()]
        assert len(kept) > 60 and {kept.count(i) for i in kept} == {2}
    got = p.near_dedup(spark, docs, "/root/testdata/sf0.001")
    assert got.columns == docs.columns
    want = sorted(tuple(r) for r in rows[:40])
    assert sorted(tuple(r) for r in got.collect()) == want
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # other splits from here on
    try:
        assert sorted(tuple(r) for r in got.repartition(3).collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
