"""Language identification by sparse multinomial logistic regression.

Character 1- to 3-grams of the lower-cased text (runs of other characters than letters
are one space) are hashed to ``DIMS`` features with TF-IDF weights and length 1. The
document frequencies are counted over all training rows. The weights are learned by
follow-the-regularised-leader, proximal form (McMahan et al., 2013), with an L1 penalty
that leaves most of them 0 and an L2 penalty, on a sample of ``SAMPLE_ROWS`` rows at
most, dealt evenly to the languages. A fifth of the sample is not learned from; on it a
temperature is fitted that calibrates the probabilities (Guo et al., 2017).

Cases: a null text, or one without a letter, is ``und`` with score 0; so is every text
when there is nothing to learn from; one language alone has score 1; null ids are
predicted like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, fold, read, row_slices, spread, texts_of

DIMS = 1 << 14
SAMPLE_ROWS = 4000
UNKNOWN = "und"
#: FTRL's learning rate and its two penalties.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.05, 0.01, 2
#: Texts are counted in slices of so many characters and rows.
SLICE, SLICE_ROWS = 1 << 19, 64


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, features) of every n-gram of the texts; a row for each place, repeats and all."""
    lowered = [(t or "").lower() + "\0" for t in texts]
    c = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lowered), np.int64, len(lowered)))
    c = np.where(_letters()[c], c, np.uint32(32))
    keep = np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32) | (row[1:] != row[:-1])]) if len(c) else np.zeros(0, bool)
    c, row = c[keep].astype(np.uint64), row[keep]
    rows, features = [row[c != 32]], [c[c != 32] + np.uint64(1)]
    key = c + np.uint64(1)
    for n in (2, 3):
        key = key[:-1] * np.uint64(0x100000001B3) + c[n - 1 :] if len(key) > 1 else key[:0]
        inside = row[: len(key)] == row[n - 1 :] if len(key) else np.zeros(0, bool)
        rows.append(row[: len(key)][inside])
        features.append(key[inside] + np.uint64(n << 60))
    flat = np.concatenate(features) * np.uint64(0x9E3779B97F4A7C15)
    return np.concatenate(rows), (flat >> np.uint64(64 - 14)).astype(np.int64)


def _counted_long(text: str) -> np.ndarray:
    """The counts of one text, piece by piece; a piece begins with the last two characters of what was kept before."""
    lowered, total, tail = text.lower() + "\0", np.zeros(DIMS, np.int64), ""
    for at in range(0, len(lowered), SLICE):
        c = np.frombuffer(lowered[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(_letters()[c], c, np.uint32(32))
        before = np.uint32(ord(tail[-1])) if tail else np.uint32(0)
        keep = (c != 32) | (np.concatenate([[before], c[:-1]]) != 32)
        new = c[keep]
        whole = np.concatenate([np.array([ord(x) for x in tail], np.uint32), new])
        for k, features in enumerate(_ngrams(whole.astype(np.uint64)), 1):
            total += np.bincount(features[max(0, len(tail) - k + 1) :] if k > 1 else _ngrams(new.astype(np.uint64))[0], minlength=DIMS)
        tail = "".join(map(chr, whole[-2:]))
    return total[None, :]


def _ngrams(c: np.ndarray) -> list[np.ndarray]:
    """Features of the 1-, 2- and 3-grams of one run of characters; single spaces have none."""
    out, key = [c[c != 32] + np.uint64(1)], c + np.uint64(1)
    for n in (2, 3):
        key = key[:-1] * np.uint64(0x100000001B3) + c[n - 1 :] if len(key) > 1 else key[:0]
        out.append(key + np.uint64(n << 60))
    return [(x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 14)).astype(np.int64) for x in out]


def counted(texts: list[str | None]) -> np.ndarray:
    if len(texts) == 1 and len(texts[0] or "") > SLICE:
        return _counted_long(texts[0])
    rows, features = grams(texts)
    return np.bincount(rows * DIMS + features, minlength=len(texts) * DIMS).reshape(len(texts), DIMS)


def _slices(column: pa.Array) -> Iterator[tuple[int, int, list[str | None]]]:
    texts = column.to_pylist()
    ends = np.concatenate([[0], np.cumsum([len(t or "") for t in texts])])
    for first, end in row_slices(ends, SLICE):
        for a in range(first, end, SLICE_ROWS):
            b = min(end, a + SLICE_ROWS)
            yield a, b, texts[a:b]


@dataclass
class Languages:
    names: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        x = counts.astype(np.float32) * self.idf.astype(np.float32)
        length = np.sqrt((x * x).sum(axis=1, keepdims=True, dtype=np.float64))
        return (x @ self.weights.astype(np.float32)) / np.maximum(length, 1e-12) + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        counts = counted(texts)
        known = counts.sum(axis=1) > 0
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        p = softmax(self.logits(counts) / self.temperature)
        best = p.argmax(axis=1)
        return [self.names[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], np.where(known, p.max(axis=1), 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) from sparse rows (features, values); the last line of z and n is the bias, without penalty."""
    z, n = np.zeros((DIMS + 1, classes)), np.zeros((DIMS + 1, classes))

    def weights(at: np.ndarray | slice, l1: float, l2: float) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + l2))

    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, value = rows[i]
            w, b = weights(at, L1, L2), weights(slice(DIMS, None), 0.0, 0.0)
            s = value @ w + b[0]
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            for where, g, old in ((at, value[:, None] * p[None, :], w), (slice(DIMS, None), p[None, :], b)):
                more = n[where] + g * g
                z[where] += g - (np.sqrt(more) - np.sqrt(n[where])) / ALPHA * old
                n[where] = more
    return weights(slice(0, DIMS), L1, L2), weights(slice(DIMS, None), 0.0, 0.0)[0]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log likelihood, by golden section on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    a, b, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(DIMS, np.int64), 0
    for b in batches:
        for _, _, texts in _slices(b.column(0)):
            total += (counted(texts) > 0).sum(axis=0)
            rows += len(texts)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*total[at].tolist(), rows], pa.int64())], names=["feature", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, end, texts in _slices(b.column(0)):
            counts = counted(texts)
            at = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [b.column(1)[first:end], pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()), pa.array([c[a].astype(np.float32).tobytes() for a, c in zip(at, counts, strict=True)], pa.binary())], names=["lang", "features", "counts"]
            )


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Languages:
    """Learns from docs (doc_id, text, lang) outside the held-out fold."""
    bound_batches(docs.sparkSession)
    usable = spread(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0)).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language, of which the model has a column each
    frequency = {r["feature"]: r["n"] for r in usable.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}  # DIMS rows at most
    total = frequency.pop(-1, 0)
    counts = np.zeros(DIMS)
    counts[list(frequency)] = list(frequency.values())
    idf = np.log((1 + total) / (1 + counts)) + 1
    names = sorted(sizes)
    if not names:
        return Languages([], idf, np.zeros((DIMS, 0)), np.zeros(0))
    each = max(1, rows // len(names))
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20))
    most = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int((1 << 20) * min(1.0, each / n)) + 1)])
    picked = usable.where(chance < F.element_at(most, F.col("lang"))).select("text", "lang").mapInArrow(_sparse, "lang string, features binary, counts binary")
    sample = picked.orderBy(F.xxhash64("features", "counts"), "lang").limit(2 * rows).toArrow()  # bounds rows that repeat
    found = sorted(zip(sample.column("lang").to_pylist(), sample.column("features").to_pylist(), sample.column("counts").to_pylist(), strict=True))
    table, y = [], []
    for lang, a, c in found:
        at = np.frombuffer(a, np.uint16).astype(np.int64)
        value = np.frombuffer(c, np.float32) * idf[at]
        if len(at):
            table.append((at, value / np.sqrt((value * value).sum())))
            y.append(names.index(lang))
    y = np.array(y, np.int64)
    check = np.arange(len(y)) % 5 == 4
    weights, bias = ftrl([r for r, c in zip(table, check, strict=True) if not c], y[~check], len(names))
    logits = np.array([v @ weights[a] + bias for (a, v), c in zip(table, check, strict=True) if c]).reshape(-1, len(names))
    return Languages(names, idf, weights, bias, temperature(logits, y[check]))


def identified(docs: DataFrame, model: Languages) -> DataFrame:
    """(doc_id, lang_pred, score) of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, texts in _slices(b.column(1)):
                names, score = shared.value.predict(texts)
                yield pa.RecordBatch.from_arrays([b.column(0)[first:end], pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return texts_of(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def recognises(spark: SparkSession, model: Languages, least: float):
    """A condition on texts: they have a letter, and their likeliest language has a score of at least ``least``."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # DIMS numbers a language

    @F.arrow_udf("boolean")
    def recognised(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0, bool)]
        for _, _, part in _slices(texts):
            names, score = shared.value.predict(part)
            out.append((np.array(names, object) != UNKNOWN) & (score >= least))
        return pa.array(np.concatenate(out))

    return recognised


def op10_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = read(spark, sf_dir, "documents")
    return identified(docs, train(docs)).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
