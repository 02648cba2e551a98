"""Text quality by a generalised additive model with pairwise interactions.

Features are measures of the text alone (``FEATURES``). Each is cut into quantile bins;
cyclic boosting visits the features in turn and adds to a feature's lookup table a small
step of a tree of at most ``LEAVES`` leaves on that feature's bins, fitted to the
remaining gradient of the logistic loss. Then pairs of features are ranked by how much a
two-way split lowers what is left, and the best pairs get tables in the same way, from
trees of one cut in each of the two. A text's score is the sigmoid of a sum of table
entries: for a batch, an addition of looked-up bins for each feature (Lou et al., 2013).

The model is fitted on the driver on at most ``SAMPLE_ROWS`` labelled rows (a sample by
hash of the id; labels are small and the sample is bounded, so it is broadcast to the
texts' scan and only features come back). All texts are scored, whole.

Cases: a null or empty text has all features 0 and the score that the model gives to
them; labels that are null are not learned from; without labelled rows, or with one
label value only, every score is the labels' smoothed mean (0.5 without any); null ids are
scored like others and count as held out if crc32 of the empty string says so; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, fold, read, row_slices, texts_of, utf8, words

SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
BINS, PAIR_BINS = 48, 12
LEAVES, ROUNDS, RATE = 3, 120, 0.1
PAIRS, PAIR_ROUNDS = 6, 60

FEATURES = [
    "log_bytes", "log_words", "word_length", "longest_word", "upper", "digit", "punctuation", "space", "non_ascii", "control", "distinct_words", "repeated_words",
    "distinct_pairs", "top_word", "line_length", "distinct_lines", "lines_closed", "sentence_marks", "bars", "braces", "slashes", "capital_words",
]


def _class(chars: str | range) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) if isinstance(c, str) else c for c in chars]] = True
    return table


_UPPER, _DIGIT, _SPACE = _class(range(65, 91)), _class(range(48, 58)), _class(" \t\n\r\v\f")
_PUNCTUATION = _class("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_CONTROL = _class([*range(0, 9), *range(14, 32), 127])
_MARKS, _BARS, _BRACES, _SLASHES, _LINE = _class(".!?"), _class("|>»"), _class("{}<>=;"), _class("/@"), _class("\n")


def measures(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)

    def share(table: np.ndarray) -> np.ndarray:
        if n == 1:  # a long text has a slice of its own: no running sums over it
            return np.array([np.count_nonzero(table[raw])]) / np.maximum(size, 1)
        total = np.concatenate([[0], np.cumsum(table[raw])])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1)

    h, doc, first = words(raw, offsets)
    count = np.diff(first).astype(np.float64)
    some = np.maximum(count, 1)
    out = np.zeros((n, len(FEATURES)))
    space = share(_SPACE)
    ascii_space = space * size
    # Starts of words: what follows a gap or begins a text.
    gap = _SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~gap & (np.concatenate([[True], gap[:-1]]) | edge[:-1])) if len(raw) else np.zeros(0, np.int64)
    start_doc = np.searchsorted(offsets, starts, "right") - 1
    capital = np.bincount(start_doc, weights=_UPPER[raw[starts]], minlength=n) if len(starts) else np.zeros(n)
    lines, line_doc, line_first = words(raw, offsets, _LINE)
    line_count = np.diff(line_first).astype(np.float64)
    before = np.zeros(len(raw), bool)
    if len(raw):
        before[:-1] = _LINE[raw[1:]]
        before[np.maximum(offsets[1:] - 1, 0)[size > 0]] = True
    ends_line = before & _class(".!?\"'):")[raw]
    closed = np.array([0, np.count_nonzero(ends_line)]) if n == 1 else np.concatenate([[0], np.cumsum(ends_line)])[offsets]
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(count)
    out[:, 2] = (size - ascii_space) / some
    for k, table in ((4, _UPPER), (5, _DIGIT), (6, _PUNCTUATION), (8, np.arange(256) > 127), (9, _CONTROL), (18, _BARS), (19, _BRACES), (20, _SLASHES)):
        out[:, k] = share(table)
    out[:, 7] = space
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] if len(h) > 1 else h[:0]
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])]) if len(h) else np.zeros(0, bool)
    out[:, 11] = np.bincount(doc, weights=again, minlength=n) / some if len(h) else 0
    ends = np.flatnonzero(~gap & (np.concatenate([gap[1:], [True]]) | edge[1:])) if len(raw) else starts
    if len(starts):
        longest = np.zeros(n)
        np.maximum.at(longest, start_doc, ends - starts + 1)
        out[:, 3] = np.log1p(longest)
    for i in range(n):
        a, b = int(first[i]), int(first[i + 1])
        if b > a:
            _, times = np.unique(h[a:b], return_counts=True)
            out[i, 10], out[i, 13] = len(times) / (b - a), times.max() / (b - a)
        if b - a > 1:
            out[i, 12] = len(np.unique(pair[a : b - 1])) / (b - a - 1)
        c, d = int(line_first[i]), int(line_first[i + 1])
        if d > c:
            out[i, 15] = len(np.unique(lines[c:d])) / (d - c)
    out[:, 14] = np.log1p(size / np.maximum(line_count, 1))
    out[:, 16] = np.diff(closed) / np.maximum(line_count, 1)
    out[:, 17] = share(_MARKS) * size / some
    out[:, 21] = capital / some
    return out


# --- the model --------------------------------------------------------------------


@dataclass
class Gam:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, k], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf values for each bin of a greedy tree on sums of gradients and curvatures."""
    spans, value = [(0, len(g))], np.zeros(len(g))
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    while len(spans) < leaves:
        best = (1e-9, None, None)
        for s, (a, b) in enumerate(spans):
            if b - a > 1:
                at = np.arange(a + 1, b)
                more = gain(a, at) + gain(at, b) - gain(a, b)
                if (k := int(more.argmax())) >= 0 and more[k] > best[0]:
                    best = (more[k], s, int(at[k]))
        if best[1] is None:
            break
        a, b = spans.pop(best[1])
        spans += [(a, best[2]), (best[2], b)]
    for a, b in spans:
        value[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return value


def _two_way(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, cell values) of the best cut in each of two features."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best, out = 0.0, np.zeros_like(g)
    if min(g.shape) < 2:
        return best, out
    r, c = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    quarter = lambda t: (t[r, c], t[r, -1] - t[r, c], t[-1, c] - t[r, c], t[-1, -1] - t[r, -1] - t[-1, c] + t[r, c])
    gs, hs = quarter(cg), quarter(ch)
    gains = sum(a**2 / (b + 1.0) for a, b in zip(gs, hs, strict=True))
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    best = float(gains[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + 1.0))
    values = [-a[i, j] / (b[i, j] + 1.0) for a, b in zip(gs, hs, strict=True)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """The model of rows x with labels y (0 or 1)."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Gam(intercept=float(np.log(p / (1 - p))))
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    gam = Gam(intercept=float(np.log(mean / (1 - mean))))
    total = np.full(len(y), gam.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
        return p - y, p * (1 - p)

    gam.edges = [_quantiles(x[:, k], BINS) for k in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(gam.edges)]
    gam.tables = [np.zeros(len(e) + 1) for e in gam.edges]
    for _ in range(ROUNDS):
        for k, own in enumerate(bins):
            g, h = slopes()
            step = RATE * _tree(np.bincount(own, g, len(gam.tables[k])), np.bincount(own, h, len(gam.tables[k])), LEAVES)
            gam.tables[k] += step
            total += step[own]
    gam.pair_edges = [_quantiles(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(gam.pair_edges)]
    shape = lambda a, b: (len(gam.pair_edges[a]) + 1, len(gam.pair_edges[b]) + 1)

    def sums(a: int, b: int, v: np.ndarray) -> np.ndarray:
        s = shape(a, b)
        return np.bincount(coarse[a] * s[1] + coarse[b], v, s[0] * s[1]).reshape(s)

    g, h = slopes()
    ranked = sorted(((_two_way(sums(a, b, g), sums(a, b, h))[0], a, b) for a in range(x.shape[1]) for b in range(a + 1, x.shape[1])), reverse=True)
    gam.pairs = [(a, b) for gain, a, b in ranked[:PAIRS] if gain > 0]
    gam.pair_tables = [np.zeros(shape(a, b)) for a, b in gam.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(gam.pairs):
            g, h = slopes()
            step = RATE * _two_way(sums(a, b, g), sums(a, b, h))[1]
            gam.pair_tables[k] += step
            total += step[coarse[a], coarse[b]]
    return gam


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, offsets = utf8(b.column(0))
        for first, end in row_slices(offsets):
            own = offsets[first : end + 1]
            x = measures(raw[own[0] : own[-1]], own - own[0])
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1)[first:end]], names=["x", "y"])


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = SAMPLE_ROWS) -> Gam:
    """Learns labels.target of docs outside the held-out fold, from about ``rows`` rows at most."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & (fold(F.col("doc_id")) != 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
    n = usable.count()
    if n > rows:
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < int((1 << 20) * rows / n))
    sample = usable.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "y").limit(rows + rows // 4)  # bounds ids that repeat
    texts = texts_of(docs)
    joined = texts.join(F.broadcast(sample), "doc_id").select("text", "y")
    table = joined.mapInArrow(_measured, "x array<double>, y int").orderBy(F.xxhash64("x"), "y").limit(2 * rows).toArrow()  # bounds texts that repeat an id
    y = table.column("y").to_numpy().astype(np.float64)
    x = np.array(table.column("x").to_pylist(), np.float64).reshape(len(y), len(FEATURES))
    order = np.lexsort((y, *x.T))  # the same model whatever the order of arrival
    return fit(x[order], (y[order] > 0).astype(np.float64))


def scored(docs: DataFrame, gam: Gam) -> DataFrame:
    """(doc_id, score) of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(gam)  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = utf8(b.column(1))
            for first, end in row_slices(offsets):
                own = offsets[first : end + 1]
                score = shared.value.score(measures(raw[own[0] : own[-1]], own - own[0]))
                yield pa.RecordBatch.from_arrays([b.column(0)[first:end], pa.array(score)], names=["doc_id", "score"])

    return texts_of(docs).mapInArrow(run, "doc_id long, score double")


def reaches(spark: SparkSession, gam: Gam, least: float):
    """A condition on texts: their score is at least ``least``."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(gam)  # some thousand numbers

    @F.arrow_udf("boolean")
    def reached(texts: pa.Array) -> pa.Array:
        raw, offsets = utf8(texts)
        out = [np.zeros(0, bool)]
        for first, end in row_slices(offsets):
            own = offsets[first : end + 1]
            out.append(shared.value.score(measures(raw[own[0] : own[-1]], own - own[0])) >= least)
        return pa.array(np.concatenate(out))

    return reached


def op7_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = read(spark, sf_dir, "documents")
    out = scored(docs, train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
