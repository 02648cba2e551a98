"""The registered queries: by their SQL where there is one, else by plain computations on the same rows."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from archspark import llm
from archspark.llm import bpe, langid, packing, quality, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def documents(duck):
    return duck.sql("select doc_id, text, lang from documents").fetchall()


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_rows_are_those_of_the_sql(spark, duck, name):
    df, want = llm.QUERIES[name](spark, SF), duck.sql(llm.ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_shards_of_the_query(spark, documents):
    from tests.llm.test_records import jump_one

    got = {r.doc_id: r for r in llm.QUERIES["op3_jump_shards"](spark, SF).collect()}
    assert len(got) == len(documents)
    slots = defaultdict(list)
    for i, text, _ in documents:
        r, key = got[i], int(sharding.mix(np.array([(i + 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
        raw = (text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "key", jump_one(key, 8), jump_one(key, 9))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_tokens_of_the_query(spark, documents):
    import hashlib

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in llm.QUERIES["op4_byte_bpe"](spark, SF).collect()}
    want = {}
    for i, text, _ in documents:
        ids = own.encode_ordinary(text or "")
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert got == want


def test_packing_of_the_query(spark, documents):
    own = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want, lengths = {}, Counter()
    for i, text, _ in documents:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k] = (a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes()))
            lengths[z - a] += 1
    got = llm.QUERIES["op9_best_fit_packing"](spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own_places in places.values():
        at = 0
        for offset, length in sorted(own_places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.lower_bound(lengths, 1024) <= len(places) <= packing.size(packing.best_fit_decreasing(lengths, 1024))


def plain_measures(text):
    """Each measure by a loop of its own."""
    raw = text.encode()
    size, gaps = max(len(raw), 1), b" \t\n\r\v\f"
    words = bytes(c if c not in gaps else 32 for c in raw).split()
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    lines = [x for x in raw.split(b"\n") if x]
    low_lines = {bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in lines}
    n, share = max(len(words), 1), lambda chars: sum(c in chars for c in raw) / size
    spaces = sum(c in gaps for c in raw)
    closed = sum(c in b".!?\"'):" and (k + 1 == len(raw) or raw[k + 1] == 10) for k, c in enumerate(raw))
    return {
        "log_bytes": math.log1p(len(raw)), "log_words": math.log1p(len(words)), "word_length": (len(raw) - spaces) / n, "longest_word": math.log1p(max(map(len, words), default=0)), "upper": share(range(65, 91)), "digit": share(range(48, 58)),
        "punctuation": share(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), "space": spaces / size, "non_ascii": share(range(128, 256)), "control": share([*range(9), *range(14, 32), 127]), "distinct_words": len(set(low)) / n if words else 0,
        "repeated_words": sum(a == b for a, b in zip(low, low[1:], strict=False)) / n, "distinct_pairs": len(set(zip(low, low[1:], strict=False))) / (len(low) - 1) if len(low) > 1 else 0, "top_word": max(Counter(low).values(), default=0) / n,
        "line_length": math.log1p(len(raw) / max(len(lines), 1)), "distinct_lines": len(low_lines) / len(lines) if lines else 0, "lines_closed": closed / max(len(lines), 1), "sentence_marks": sum(c in b".!?" for c in raw) / n,
        "bars": share([ord("|"), ord(">"), ord("»")]), "braces": share(b"{}<>=;"), "slashes": share(b"/@"), "capital_words": sum(65 <= w[0] <= 90 for w in words) / n,
    }


def test_measures_by_plain_loops(documents):
    texts = ["", "Ab cd. Ab\nxy!\nxy!", "12 ü | » {x}", "\n\n", "a a a a", "\x00\x1f no.\n", *[(t or "")[:4000] for _, t, _ in documents[:60]]]
    raw = [t.encode() for t in texts]
    x = quality.measures(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    for row, text in zip(x, texts, strict=True):
        want = plain_measures(text)
        assert list(want) == quality.FEATURES
        np.testing.assert_allclose(row, list(want.values()), rtol=1e-9, atol=1e-12, err_msg=repr(text[:50]))


def test_scores_by_plain_look_ups():
    rng = np.random.default_rng(4)
    x = rng.uniform(size=(500, 5))
    gam = quality.fit(x, ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.4)).astype(float))
    for row, score in zip(x, gam.score(x), strict=True):
        total = gam.intercept
        for k, (edges, table) in enumerate(zip(gam.edges, gam.tables, strict=True)):
            total += table[sum(e <= row[k] for e in edges)]
        for (a, b), table in zip(gam.pairs, gam.pair_tables, strict=True):
            total += table[sum(e <= row[a] for e in gam.pair_edges[a]), sum(e <= row[b] for e in gam.pair_edges[b])]
        assert score == pytest.approx(1 / (1 + math.exp(-total)))
    assert gam.pairs


def test_quality_of_the_query(spark, documents, duck):
    got = {r.doc_id: r for r in llm.QUERIES["op7_additive_quality"](spark, SF).collect()}
    gam = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    for i, text, _ in documents:
        score = gam.score(np.array([list(plain_measures(text or "").values())]))[0]
        assert got[i].score == pytest.approx(score, abs=1e-6) or len(text or "") > 10**6
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].predicted == (got[i].score >= 0.3)


def test_ftrl_by_plain_loops():
    """The weights after two rows, one coordinate at a time."""
    rows = [(np.array([1, 3]), np.array([0.6, 0.8])), (np.array([3, 7]), np.array([0.8, 0.6])), (np.array([1, 7]), np.array([1.0, 0.1]))]
    y, classes = np.array([0, 1, 0]), 2
    z, n = defaultdict(float), defaultdict(float)
    bias = langid.DIMS

    def weight(i, c):
        l1, l2 = (0.0, 0.0) if i == bias else (langid.L1, langid.L2)
        if abs(z[i, c]) <= l1:
            return 0.0
        return -(z[i, c] - math.copysign(l1, z[i, c])) / ((langid.BETA + math.sqrt(n[i, c])) / langid.ALPHA + l2)

    rng = np.random.default_rng(3)
    for _ in range(2):
        for r in rng.permutation(len(rows)):
            own = [*zip(*rows[r], strict=True), (bias, 1.0)]
            w = {(i, c): weight(i, c) for i, _ in own for c in range(classes)}
            s = [sum(v * w[i, c] for i, v in own) for c in range(classes)]
            p = [math.exp(x) / sum(map(math.exp, s)) for x in s]
            for i, v in own:
                for c in range(classes):
                    g = v * (p[c] - (c == y[r]))
                    z[i, c] += g - (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / langid.ALPHA * w[i, c]
                    n[i, c] += g * g
    weights, b = langid.ftrl(rows, y, classes, 2)
    want = np.array([[weight(i, c) for c in range(classes)] for i in (1, 3, 7)])
    np.testing.assert_allclose(weights[[1, 3, 7]], want, atol=1e-12)
    np.testing.assert_allclose(b, [weight(bias, c) for c in range(classes)], atol=1e-12)


def test_languages_of_the_query(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    learned = [t for i, t, lang in documents if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 5]
    seen = Counter()
    for t in learned:
        seen.update(set(np.flatnonzero(langid.counted([t])[0]).tolist()))
    want = [math.log((1 + len(learned)) / (1 + seen[k])) + 1 for k in range(langid.DIMS)]
    np.testing.assert_allclose(model.idf, want)
    got = {r.doc_id: r for r in llm.QUERIES["op10_ftrl_language"](spark, SF).collect()}
    for i, text, _ in documents[:80]:
        tf = langid.counted([text])[0]
        at = np.flatnonzero(tf)
        if not len(at):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        x = [tf[k] * want[k] for k in at]
        length = math.sqrt(sum(v * v for v in x))
        logits = [sum(v * model.weights[k, c] for v, k in zip(x, at, strict=True)) / length + model.bias[c] for c in range(len(model.names))]
        e = [math.exp((v - max(logits)) / model.temperature) for v in logits]
        assert got[i].lang_pred == model.names[int(np.argmax(e))] and got[i].score == pytest.approx(max(e) / sum(e), abs=1e-4)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_very_long_texts_and_urls(spark):
    from archspark.llm import urlfilter

    long = "word " * 400_000
    docs = spark.createDataFrame([(1, long), (2, "x" * 2_000_000), (3, " " * 1_000_000)], "doc_id long, text string")
    assert {r.doc_id: r.size for r in sharding.sharded(docs).collect()} == {1: 2_000_001, 2: 2_000_001, 3: 1_000_001}
    pieces = packing.pieces(docs).groupBy("doc_id").sum("length").collect()
    own = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    assert {r[0]: r[1] for r in pieces} == {1: len(own.encode(long).ids) + 1, 2: len(own.encode("x" * 2_000_000).ids) + 1, 3: len(own.encode(" " * 1_000_000).ids) + 1}
    pages = spark.createDataFrame([(1, "http://a.com/en/" + "y" * 500_000), (2, "http://" + "a." * 100_000 + "com/en/")], "page_id long, url string")
    assert {r.verdict for r in urlfilter.judged(pages, urlfilter.rule_table(spark, urlfilter.RULES)).collect()} == {"block"}
