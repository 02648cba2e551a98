"""Search with errors in a stored index, against plain edit distances."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from archspark.operators import textsearch as S

from .test_companions import measured


def plain_distance(text, phrase):
    """Sellers' table: the least edits between the phrase and any part of the text."""
    row = list(range(len(phrase) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(phrase, 1):
            new.append(min(row[i - 1] + (c != p), row[i] + 1, new[i - 1] + 1))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=300, deadline=None)
@given(st.text("abé ", max_size=30), st.text("abé ", min_size=1, max_size=12))
def test_part_distance(text, phrase):
    assert S.part_distance(text, phrase) == plain_distance(text, phrase)


def test_long_phrases():
    rng = random.Random(1)
    text = "".join(rng.choice("abcd") for _ in range(300))
    phrase = text[50:90] + "x" + text[92:170]
    assert S.part_distance(text, phrase) == plain_distance(text, phrase)


def plain_search(rows, phrases, limit):
    out = []
    for phrase in sorted({p.strip().lower() for p in phrases if p is not None}):
        m, found = len(phrase), []
        k = max(0, min(int(m * 0.4), (m - 2) // 2))
        for kind, i, *fields in rows:
            scores = []
            for text, w in zip(fields, (1.0, 1.1, 1.2), strict=True):
                text = (text or "").lower()
                edits = plain_distance(text, phrase)
                if m >= 2 and text and edits <= k:
                    scores.append((edits / m + 0.1 * (1 - min(m / len(text), 1))) * w + w - 1)
            if scores:
                found.append((round(min(scores), 6), kind, i))
        out += [(phrase, r, kind, i, s) for r, (s, kind, i) in enumerate(sorted(found)[:limit], 1)]
    return out


ROWS = [
    ("component", "web", "Web Shop", "apps/web", "client"), ("file", "f1", "index.ts", "src/components/widget/index.ts", "typescript"), ("file", "f2", "Widget.tsx", "src/Widget.tsx", "typescript"),
    ("symbol", "s1", "renderWidget", "src/Widget.tsx", "function"), ("symbol", "s2", None, "", None), ("symbol", "s3", "é", "ünï/cödé", "x"), ("symbol", "s4", "aaaa", "aa", "a"), ("file", "f3", "user profile page.md", "docs/user profile page.md", "markdown"),
]
PHRASES = ["widget", "widgt", "wigdet", " Web Shop ", "user profil page", "usr profile", "cöde", "aa", "aaa", "a", "", None, "index.ts", "ts", "zzzzzz", "WIDGET"]
SCHEMA = "type string, id string, name string, path string, kind string, salt int, gram string"


@pytest.mark.parametrize("limit", [2, 50])
def test_search(spark, limit):
    rows = spark.createDataFrame([(*r, 1, "g") for r in ROWS], SCHEMA)
    index = S.build(rows, buckets=3)
    got = S.search(index, spark.createDataFrame([(p,) for p in PHRASES], "phrase string"), limit)
    assert sorted((r.phrase, r.rank, r.type, r.id, r.score) for r in got.collect()) == plain_search(ROWS, PHRASES, limit)


def test_random_rows(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc/") for _ in range(rng.randrange(n)))
    rows = [("file", f"i{k:03d}", word(9), word(20), word(4)) for k in range(150)]
    phrases = [word(12) for _ in range(40)]
    index = S.build(spark.createDataFrame([(*r, 1, "g") for r in rows], SCHEMA), buckets=4)
    got = S.search(index, spark.createDataFrame([(p,) for p in phrases], "phrase string"), 500)
    assert sorted((r.phrase, r.rank, r.type, r.id, r.score) for r in got.collect()) == plain_search(rows, phrases, 500)


def test_rows_with_too_few_pairs_are_not_compared(spark):
    rows = [("file", f"i{k}", "nothing alike", "at all", "x") for k in range(200)] + [("file", "w", "widgets", "src", "x")]
    index = S.build(spark.createDataFrame([(*r, 1, "g") for r in rows], SCHEMA), buckets=4)
    asked = spark.createDataFrame([("widget",)], "phrase string")
    assert S.candidates(index, asked).count() == 1
    shown = S.candidates(index, asked)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in shown and "Arrow" not in shown and "levenshtein" not in shown


def test_nothing_to_find(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert not S.search(S.build(rows, 2), spark.createDataFrame([("ab",)], "phrase string")).count()


def test_hits_are_kept_where_many_rows_have_one_text(spark):
    """Rows that share few texts: hits are those of the plain search, and a phrase meets no more places of a text than it may have hits."""
    rng = random.Random(7)
    names, paths, kinds = ["Widget", "Wodget", "Gadget"], ["src/widget", "src/gadget"], ["class", "widget"]
    rows = [(rng.choice(["file", "symbol"]), f"k{i:03}", rng.choice(names), rng.choice(paths), rng.choice(kinds)) for i in range(400)]
    phrases = ["widget", "gadget", "wdget", "src/widget", "class"]
    index = S.build(spark.createDataFrame(rows, "type string, id string, name string, path string, kind string"), buckets=3)
    found = S.search(index, spark.createDataFrame([(p,) for p in phrases], "phrase string"), limit=5)
    met = max(measured(found, "numOutputRows", "Join"))
    got = sorted((r["phrase"], r["rank"], r["type"], r["id"], r["score"]) for r in found.collect())
    want = sorted(plain_search(rows, phrases, 5))
    assert [g[:4] for g in got] == [w[:4] for w in want] and [g[4] for g in got] == pytest.approx([w[4] for w in want])
    assert met <= 700  # pairs of letters met before counting; places of texts are fewer
