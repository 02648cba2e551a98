"""Archives, shards, tokens, rules and packing, against plain computations on small fixtures."""

import base64
import hashlib
import io
import itertools
import json
import random
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from archspark.llm import bpe, common, packing, sharding, urlfilter, warc_zip

# --- WARC ---------------------------------------------------------------------------

PAGES = [
    (5, "http://a.example/x", "<p>one</p>"),
    (2, "http://a.example/y\r\nWARC-Type: no", "<p>one</p>"),
    (9, None, "<p>one</p>"),
    (1, "http://ü.example/100%25", "ü\r\n\r\nbody"),
    (3, "http://b.example", None),
    (4, "http://c.example", ""),
    (7, "http://long.example", "long " * 60_000),
    (2, "http://a.example/again", "<p>one</p>"),
    (None, "http://none.example", "<p>one</p>"),
    (None, "http://none.example", "only here"),
]


def pages_table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("archive_bytes, member_bytes", [(1 << 20, 1 << 20), (300, 100)])
def test_records_come_back(spark, archive_bytes, member_bytes):
    pages = warc_zip.with_revisits(pages_table(spark, PAGES))
    manifest = warc_zip.write_packages(pages, common.fresh_path(spark, "t"), archive_bytes, member_bytes)
    got = sorted(map(tuple, warc_zip.read_records(manifest, range_bytes=200).collect()), key=str)
    first = {}
    for i, _, html in PAGES:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, url, html in PAGES:
        raw = (html or "").encode()
        refers = first.get(html or "") if first.get(html or "") != i else None
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((i, url and url.replace("\r\n", "%0D%0A"), bytearray(raw) if refers is None else bytearray(), len(raw), digest, "response" if refers is None else "revisit", refers))
    assert got == sorted(want, key=str)
    assert manifest.agg({"records": "sum"}).first()[0] == len(PAGES)
    kinds = warc_zip.members(manifest).select("member", "compressed").collect()
    assert {r.member.split("/")[0] for r in kinds} == {"archive", "indexes"} and not any(r.compressed for r in kinds)


def test_no_pages(spark):
    pages = warc_zip.with_revisits(pages_table(spark, []))
    assert warc_zip.read_records(warc_zip.write_packages(pages, common.fresh_path(spark, "t"))).count() == 0


def test_zip64_directory():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for i in range(66_000):
            z.writestr(f"archive/{i}", b"" if i % 1000 else str(i))
        z.writestr("deep", b"x" * 100, zipfile.ZIP_DEFLATED)
    f = pa.PythonFile(io.BytesIO(raw.getvalue()), "r")
    found = warc_zip.directory(f)
    assert len(found) == 66_001 and found[-1][3] and not found[0][3]
    name, at, size, _ = found[5000]
    assert (name, f.read_at(size, at)) == ("archive/5000", b"5000")
    with pytest.raises(ValueError, match="not a ZIP"):
        warc_zip.directory(pa.PythonFile(io.BytesIO(b"no zip" * 9), "r"))


# --- shards -------------------------------------------------------------------------


def jump_one(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=30), st.integers(1, 300))
def test_jump_is_the_published_function(keys, shards):
    assert sharding.jump(np.array(keys, np.uint64), shards).tolist() == [jump_one(k, shards) for k in keys]


def test_shards(spark):
    rows = [(i, f"text {i % 7}", "c") for i in range(4000)] + [(None, None, "c"), (5, "ü", "c"), (5, "ü", "c"), (6, "", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.sharded(docs, buckets=5).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r.grown_shard == 8 for r in got) / len(got)
    assert abs(moved - 1 / 9) < 0.03 and max(map(len, slots.values())) < 1.25 * len(got) / 8
    assert len({(r.shard, r.grown_shard) for r in got if r.doc_id == 5}) == 1
    assert sharding.sharded(docs.limit(0)).count() == 0


def test_slots_follow_the_checksum_with_any_buckets(spark):
    rows = [(i % 900, f"text {i % 7}") for i in range(2000)] + [(None, None), (None, "x"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = defaultdict(list)
    for r in sharding.sharded(docs, buckets=7).collect():
        parts = [str(v) for v in (r.doc_id, r.text_crc32, r.size) if v is not None]
        order[r.shard].append((r.slot, (zlib.crc32(":".join(parts).encode()), r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size)))
    assert all([k for _, k in sorted(s)] == sorted(k for _, k in s) for s in order.values())
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.slot)
    assert sorted(sharding.sharded(docs, buckets=1).collect(), key=key) == sorted(sharding.sharded(docs, buckets=500).collect(), key=key)


# --- tokens -------------------------------------------------------------------------

TEXTS = ["", None, "Hello  world\n\n it's 12345 ok\t \x1c\x1d x\x85y\xa0z", "naïve ÜBER 日本語 😀\u200d👩 \u2003end ", " " * 50, "a" * 3000 + " b", "<|endoftext|> x", "don't DON'T we'll\r\n\r\n  \r\n", "word " * 20_000]


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path(bpe.RANKS))


def test_encoding_is_tiktokens(spark, ranks, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(bpe, "LONG_TEXT", 2000)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "same id", "x"), (None, "no id", "x")]
    out = bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), ranks), ranks).collect()
    got = sorted((str(r.doc_id), np.frombuffer(bytes(r.ids), "<u4").tolist(), r.n_tokens, bytes(r.decoded)) for r in out)
    want = sorted((str(i), own.encode_ordinary(t or ""), len(own.encode_ordinary(t or "")), (t or "").encode()) for i, t, _ in rows)
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \t\n\r'sdmtrevl0a\x1c\x85\xa0\u2028\u3000"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_pieces_cover_any_text(text):
    found = bpe.pre_tokenizer().findall(text)
    assert "".join(found) == text
    known = packing.tokens(public_tokenizers.path(packing.VOCABULARY))
    assert known.ranks is not None and known.ids(text).tolist() == known.own.encode(text, add_special_tokens=False).ids
    other = packing.tokens(public_tokenizers.path("word_bpe_49k.json"))
    assert other.ranks is None


def test_no_texts(spark, ranks):
    assert bpe.decode(bpe.encode(spark.createDataFrame([], "doc_id long, text string"), ranks), ranks).count() == 0


@given(st.lists(st.binary(max_size=20), max_size=20))
def test_packed_bytes(parts):
    sizes, flat = bpe.unpack(bpe.pack(parts))
    assert sizes.tolist() == [len(p) for p in parts] and flat == b"".join(parts)


@given(st.lists(st.integers(0, 1 << 20), max_size=50))
def test_planes(codes):
    assert bpe._narrow(bpe._wide(np.array(codes, np.uint32))).tolist() == codes


# --- packing ------------------------------------------------------------------------


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 64), max_size=80), st.sampled_from([64, 100]))
def test_plan_places_every_piece(lengths, capacity):
    plan = packing.plan(Counter(lengths), capacity)
    used = Counter()
    for filling, times in plan:
        assert sum(x * k for x, k in filling) <= capacity
        for x, k in filling:
            used[x] += k * times
    assert used == Counter(lengths)
    assert packing.size(plan) <= packing.size(packing.best_fit_decreasing(Counter(lengths), capacity))


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(1, 40), max_size=80), st.sampled_from([40, 64, 100]))
def test_best_fit_from_counts(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= x
        else:
            rooms.append(capacity - x)
    plan = packing.best_fit_decreasing(Counter(lengths), capacity)
    placed = Counter()
    for own, times in plan:
        for x, k in own:
            placed[x] += k * times
    assert placed == Counter(lengths) and packing.size(plan) == len(rooms)
    assert Counter(rooms) == sum((Counter({capacity - sum(x * k for x, k in own): times}) for own, times in plan), Counter())


def test_plans_do_not_grow_with_the_corpus():
    """A thousand million pieces: the plan is made of counts, and its fillings are no more than for few pieces."""
    rng = random.Random(3)
    counts = {x: rng.randrange(10**5, 10**7) for x in range(1, 400)}
    assert sum(counts.values()) > 10**9
    plan = packing.plan(counts, 1024, steps=1000)
    used = Counter()
    for own, times in plan:
        for x, k in own:
            used[x] += k * times
    assert used == counts and len(plan) < 5000
    assert packing.size(plan) <= packing.size(packing.best_fit_decreasing(counts, 1024)) and packing.size(plan) >= packing.lower_bound(counts, 1024)


def test_plan_of_a_case_where_fullest_first_is_worse():
    counts = {56: 100, 55: 20, 22: 50, 25: 50, 61: 1000, 15: 20, 30: 1000, 16: 100}
    assert packing.size(packing.plan(counts, 100)) <= packing.size(packing.best_fit_decreasing(counts, 100))
    assert packing.size(packing.plan(counts, 100)) == packing.lower_bound(counts, 100)


def fewest(lengths: list[int], capacity: int) -> int:
    """Exact, over all assignments."""
    best = len(lengths)

    def walk(i: int, rooms: tuple[int, ...]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {rooms.index(r) for r in rooms if r >= lengths[i]}:
            walk(i + 1, tuple(sorted((*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]))))
        walk(i + 1, tuple(sorted((*rooms, capacity - lengths[i]))))

    walk(0, ())
    return best


def test_few_pieces_are_packed_best():
    rng = random.Random(4)
    for _ in range(25):
        lengths = sorted((rng.randint(5, 60) for _ in range(9)), reverse=True)
        assert sum(t for _, t in packing.plan(Counter(lengths), 100)) == fewest(lengths, 100)


def test_many_pieces_are_searched():
    """Sequences cut in three, of 180 pieces: no greedy pass and no best fit finds them all."""
    for seed in range(6):
        rng, lengths = random.Random(seed), []
        for _ in range(60):
            a = rng.randint(26, 49)
            b = rng.randint(max(25, 51 - a), min(49, 75 - a))
            lengths += [a, b, 100 - a - b]
        assert sum(t for _, t in packing.plan(Counter(lengths), 100)) == packing.lower_bound(Counter(lengths), 100) == 60


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 3), min_size=1, max_size=5), st.integers(1, 24), st.integers(0, 5))
def test_undominated_fillings(have, room, waste):
    lengths = sorted((x for x in have if x <= room), reverse=True)
    want = set()
    for ks in itertools.product(*(range(have[x] + 1) for x in lengths)):
        own = [x for x, k in zip(lengths, ks, strict=True) for _ in range(k)]
        spare = room - sum(own)
        parts = [p for n in range(len(own) + 1) for p in itertools.combinations(own, n)]
        if spare >= 0 and not any(have[c] > own.count(c) and sum(p) <= c <= sum(p) + spare and p != (c,) for c in lengths for p in parts):
            want.add(tuple((x, k) for x, k in zip(lengths, ks, strict=True) if k))
    got = list(packing.fillings(room, have, waste, packing.Steps(None), lambda: room))
    assert len(got) == len(set(got)) and set(got) == want


def test_packed_documents(spark):
    rng = random.Random(5)
    texts = [None, "", "x", "<|endoftext|> y", *(" ".join(rng.choice(["alpha", "beta,", "Gamma", "12"]) for _ in range(rng.choice([3, 50, 300, 900, 3000]))) for _ in range(120))]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(5, texts[5], 0), (None, "q", 0)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, piece int")).collect()
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t, _ in rows:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)] if first else [*range(0, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 1024) + 2
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- urls ---------------------------------------------------------------------------


def plain_verdict(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = rest[: min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))]
    path = rest[len(host) :]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None, key=lambda f: (f[0], f[1], f[3], f[2]))
    return host, path, best and best[3], best[2] if best else "allow"


def judge(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = urlfilter.judged(pages, urlfilter.rule_table(spark, rules), salts=3).collect()
    return [(r.host, r.path, r.rule, r.verdict) for r in sorted(out, key=lambda r: r.page_id)]


def test_rules_of_the_query(spark):
    urls = [
        None, "", "no scheme", "http://", "http://com/en/", "HTTP://A.B.Example.COM/en/7#x", "http://example.com/en/6?y", "http://example.com/EN/7", "x://notexample.com/en/7", "http://example.net/de/8/z",
        "http://www.example.net/de/9", "http://example.org?/es/", "http://example.org/es/", "http://a.org#/es/", "http://.com/en/", "http://com./en/", "http://example.com:80/en/7", "http://Ünet.net/de/", "a://b://c.net/de/",
    ]
    assert judge(spark, urls, urlfilter.RULES) == [plain_verdict(u, urlfilter.RULES) for u in urls]


def test_nested_rules(spark):
    rng = random.Random(6)
    label = lambda: rng.choice(["a", "b", "ab", "a-b", "c"])
    host = lambda n: ".".join(label() for _ in range(rng.randint(1, n)))
    path = lambda: "/" + "/".join(label() for _ in range(rng.randint(0, 3)))
    rules = list({(h, p): (h, p, rng.choice(["block", "allow"])) for h, p in ((host(3), path()) for _ in range(120))}.values()) + [("it's", "/\\'", "block")]
    urls = [f"http://{host(5)}{path()}" for _ in range(600)] + ["http://x.it's/\\'q"]
    assert judge(spark, urls, rules) == [plain_verdict(u, rules) for u in urls]
    assert judge(spark, urls[:3], []) == [(*plain_verdict(u, [])[:2], None, "allow") for u in urls[:3]]
    assert judge(spark, [], rules) == []


def test_a_hundred_thousand_path_rules_of_one_host(spark):
    """A host's rules are rows of the sweep; nested ones carry their lengths only."""
    from pyspark.sql import functions as F

    n = 100_000
    i = F.col("id")
    rules = spark.range(n).select(F.lit("big.com").alias("host"), F.concat(F.lit("/p"), (i % (n // 2)).cast("string"), F.when(i < n // 2, F.lit("/")).otherwise(F.lit("/q"))).alias("path"), F.when(i % 3 == 0, "block").otherwise("allow").alias("verdict"))
    rules = rules.unionByName(spark.createDataFrame([("com", "/p1", "block"), ("big.com", "/" + "a" * 500, "block"), (None, "/", "block"), ("", "/", "block"), ("com", None, "block")] + [("big.com", "/" + "a" * k, "allow") for k in range(1, 60)], "host string, path string, verdict string"))
    rng = random.Random(11)
    urls = [f"http://x.big.com/p{rng.randrange(60_000)}{rng.choice(['', '/', '/q', '/r', '/qq'])}" for _ in range(400)] + ["http://big.com/" + "a" * k + "b" * (k % 2) for k in (0, 5, 59, 100, 500, 700)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judged(pages, rules, salts=4).collect()}
    known = {}
    for r in rules.where("host <> '' and path is not null").collect():
        known[r.host, r.path] = max(r.verdict, known.get((r.host, r.path), ""))
    for k, u in enumerate(urls):
        host, path = u[7:].split("/", 1)[0], "/" + u[7:].split("/", 1)[1]
        fits = [(len(h) + m, len(h), h, path[:m]) for h in ("com", "big.com") for m in range(len(path) + 1) if (h, path[:m]) in known and (host == h or host.endswith("." + h))]
        want = max(fits, default=None)
        assert got[k] == ((want[2] + want[3], known[want[2], want[3]]) if want else (None, "allow"))


def test_rules_stay_native(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    plan = urlfilter.judged(pages, urlfilter.rule_table(spark, urlfilter.RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_manifest_lines_are_json():
    raw = warc_zip.record(1, "http://x", b"abc", None)
    assert warc_zip.parse(warc_zip._gzip(raw))[2:6] == (b"abc", 3, warc_zip.base32_sha1(b"abc"), "response")
    with pytest.raises(ValueError, match="payload"):
        warc_zip.parse(warc_zip._gzip(raw.replace(b"abc", b"abd")))
    assert json.loads(json.dumps({"page_id": None}))["page_id"] is None


def test_blocks_with_equal_bytes_stay_apart(spark, ranks):
    """Partitions with the same ids and the same bytes, cut elsewhere into texts, don't mix."""
    rows = [(1, "hello wor"), (2, "ld zebra"), (1, "hello world z"), (2, "ebra"), (None, "hello wor"), (None, "ld zebra")]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string")
    out = bpe.decode(bpe.encode(docs, ranks), ranks).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in out) == sorted((str(i), t) for i, t in rows)


def test_a_forgetful_task_encodes_the_same(spark, ranks, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 3)
    docs = spark.createDataFrame([(i, "one two three four five six " * 3) for i in range(4)], "doc_id long, text string")
    assert len({bytes(r.ids) for r in bpe.encode(docs, ranks).collect()}) == 1


def test_texts_are_cut_into_pre_tokens_once(spark, ranks):
    """The blocks' table is read by both branches, and its big side is not shuffled."""
    plan = bpe.encode(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), ranks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and "Bucketed: true" in plan
