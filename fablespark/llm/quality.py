"""Quality by a generalised additive model with pairwise interactions, made of lookup tables.

A text is described by FEATURES numbers of its whole length: sizes, shares of kinds of characters and words,
repetition, and the longest runs of shouted, decorated, equal and bare-symbol words. Quantile edges turn
each number into one of BINS bins. Boosting goes round the features, each time fitting a tree of at most three
leaves to the gradient summed by bin and adding it, shrunk, to that feature's table; afterwards
pairs of features are ranked by how much one split in each direction explains of what is left, and the
best PAIRS get tables of their own in the same way. A score is the logistic function of
the sum of one entry a table, so scoring is bin lookups and additions over whole batches.

The model learns from a bounded sample (SAMPLE labels on average, no more than twice that); labels
whose crc32(doc_id as text) mod 5 is 0 are held out. Documents are read once for the sample, by a
broadcast of its ids, and once to be scored; no text is shuffled.

Edge cases: null and empty texts have all features 0 but are scored like others; a null doc_id is held out and matches no
label; labels other than 0 and 1 teach nothing, repeated and contradicting ones count as often
as they occur; documents that repeat a doc_id all learn from its label; without labels of both kinds every
score is the share of label 1, 0.5 without any; equal scores are no matter, as each row is decided alone; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import bounded, in_arrow

SAMPLE = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 10
ROUNDS = 150
PAIR_ROUNDS = 60
RATE = 0.1
RIDGE = 1.0
ACCEPT = 0.3
FEATURES = (
    "words",
    "word_bytes",
    "line_words",
    "upper",
    "digits",
    "symbols",
    "common_symbol",
    "shouted",
    "decorated",
    "bare",
    "same_as_last",
    "distinct_words",
    "distinct_pairs",
    "longest_word",
    "run_shouted",
    "run_decorated",
    "run_same",
    "run_marked",
)
KIND = np.zeros(256, np.int8)  # 0 lower-case or other letter, 1 space, 2 upper case, 3 digit, 4 symbol
KIND[:128] = 4
KIND[list(range(32)) + [32, 127]] = 1
KIND[97:123] = 0
KIND[65:91] = 2
KIND[48:58] = 3


def _longest(flag: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The longest run of set flags within each row."""
    out = np.zeros(rows)
    if len(flag):
        edge = np.flatnonzero(np.concatenate(([True], (flag[1:] != flag[:-1]) | (row[1:] != row[:-1]))))
        length = np.diff(np.append(edge, len(flag)))
        np.maximum.at(out, row[edge], np.where(flag[edge], length, 0))
    return out


def describe(column: pa.Array) -> np.ndarray:
    """FEATURES of every text, one row each."""
    parts = [_described(data, offsets) for _, _, data, offsets in tk.chunks(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _described(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows, size = len(offsets) - 1, np.diff(offsets)
    kind = KIND[data]
    if len(data) > 1:  # upper-case letters of the Latin-1 block take two bytes
        kind[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] = 2
    start, end, row = tk.word_spans(data, offsets)
    length = end - start
    words = np.bincount(row, minlength=rows)
    per_row = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[offsets])
    per_word = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.stack((start, end))], axis=0)[0] if len(start) else np.zeros(0, np.int64)
    upper, symbol = kind == 2, kind == 4
    capitals, marks, plain = per_word(upper), per_word(symbol), per_word(kind == 0)
    # Continuation bytes count as plain letters; a word of two-byte capitals has one of them a letter.
    two = per_word(data == 0xC3)
    shouted = (capitals >= 2) & (plain <= two)
    last = np.zeros(len(data) + 1, bool)
    last[1:] = symbol
    decorated = last[end] & last[np.maximum(end - 1, start)] & (length > 2) if len(start) else np.zeros(0, bool)
    bare = marks == length
    h = tk.span_hash(tk.prefix_hash(data), start, end)
    near = row[1:] == row[:-1]
    same, beside = np.zeros(len(h), bool), np.array(bare)
    same[1:] = (h[1:] == h[:-1]) & near
    beside[:-1] |= bare[1:] & near
    follows = np.flatnonzero(near)
    pair = tk.mix(h[follows] * tk.TERMS[0] + h[follows + 1] * tk.TERMS[1])

    def distinct(values: np.ndarray, where: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, where))
        v, w = values[order], where[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
        return np.bincount(w[new], minlength=rows)

    def share(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return x / np.maximum(n, 1)

    by_word = lambda flag: np.bincount(row[flag], minlength=rows)
    symbols = per_row(symbol)
    most = np.zeros(rows, np.int64)
    for c in b"!#$%&*+-/<=>@\\^_`|~":
        np.maximum(most, per_row(data == c), out=most)
    longest = np.zeros(rows)
    np.maximum.at(longest, row, length)
    lines = per_row(data == 10) + 1
    return np.stack(
        [
            np.log1p(words),
            share(np.bincount(row, length, rows), words),
            share(words, lines),
            share(per_row(upper), size),
            share(per_row(kind == 3), size),
            share(symbols, size),
            share(most, size),
            share(by_word(shouted), words),
            share(by_word(decorated), words),
            share(by_word(bare), words),
            share(by_word(same), words),
            share(distinct(h, row), words),
            share(distinct(pair, row[follows]), np.bincount(row[follows], minlength=rows)),
            longest,
            _longest(shouted, row, rows),
            _longest(decorated, row, rows),
            _longest(same, row, rows),
            # every second word a bare mark, as between the links of a menu
            _longest(beside, row, rows),
        ],
        axis=1,
    ).astype(np.float64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A step for each bin: the best split of the bins' order, then the best split of one side."""

    def split(a: int, b: int) -> tuple[float, int]:
        left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        if not len(left_g):
            return 0.0, -1
        all_g, all_h = g[a:b].sum(), h[a:b].sum()
        gain = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
        return float(gain.max()), a + 1 + int(gain.argmax())

    cuts, (_, first) = [0, len(g)], split(0, len(g))
    if first > 0:
        cuts.append(first)
        cuts.append(max(split(0, first), split(first, len(g)))[1])
    cuts = sorted({c for c in cuts if c >= 0})
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best single split in each direction of a table."""
    left_g, left_h = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    ll_g, ll_h = left_g[:-1, :-1], left_h[:-1, :-1]
    lr_g, lr_h = left_g[:-1, -1:] - ll_g, left_h[:-1, -1:] - ll_h
    rl_g, rl_h = left_g[-1:, :-1] - ll_g, left_h[-1:, :-1] - ll_h
    rr_g, rr_h = left_g[-1, -1] - ll_g - lr_g - rl_g, left_h[-1, -1] - ll_h - lr_h - rl_h
    gain = _gain(ll_g, ll_h) + _gain(lr_g, lr_h) + _gain(rl_g, rl_h) + _gain(rr_g, rr_h) - _gain(left_g[-1, -1], left_h[-1, -1])
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros(g.shape)
    for rows, columns, sg, sh in ((slice(0, i + 1), slice(0, j + 1), ll_g, ll_h), (slice(0, i + 1), slice(j + 1, None), lr_g, lr_h), (slice(i + 1, None), slice(0, j + 1), rl_g, rl_h), (slice(i + 1, None), slice(j + 1, None), rr_g, rr_h)):
        out[rows, columns] = -sg[i, j] / (sh[i, j] + RIDGE)
    return float(gain[i, j]), out


class Model:
    """Edges of the bins, one table a feature, one a chosen pair, and the intercept."""

    def __init__(self) -> None:
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.coarse: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.bias = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """x: features by row; y: labels 0 and 1. Rows in any order give the same model."""
        rate = (y.sum() + 1.0) / (len(y) + 2.0) if len(y) else 0.5
        if len(y) and y.min() == y.max():
            rate = float(y[0])
        self.bias = float(np.log(np.clip(rate, 1e-6, 1 - 1e-6) / (1 - np.clip(rate, 1e-6, 1 - 1e-6))))
        if not len(y) or y.min() == y.max():
            return
        cut = lambda v, n: np.unique(np.quantile(v, np.linspace(0, 1, n + 1)[1:-1], method="lower"))
        self.edges = [cut(x[:, f], BINS) for f in range(x.shape[1])]
        self.coarse = [cut(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        bins = [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)]
        score = np.full(len(y), self.bias)
        for _ in range(ROUNDS):
            for f, table in enumerate(self.tables):
                p = _sigmoid(score)
                step = RATE * _tree(np.bincount(bins[f], p - y, len(table)), np.bincount(bins[f], p * (1 - p), len(table)))
                table += step
                score += step[bins[f]]
        some = [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.coarse)]
        size = [len(e) + 1 for e in self.coarse]

        def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            p, at = _sigmoid(score), some[a] * size[b] + some[b]
            return tuple(np.bincount(at, w, size[a] * size[b]).reshape(size[a], size[b]) for w in (p - y, p * (1 - p)))

        wide = [f for f in range(x.shape[1]) if size[f] > 1]
        ranked = sorted(((-_quadrants(*sums(a, b))[0], a, b) for i, a in enumerate(wide) for b in wide[i + 1 :]))[:PAIRS]
        self.pairs = [(a, b, np.zeros((size[a], size[b]))) for _, a, b in ranked]
        for _ in range(PAIR_ROUNDS):
            for a, b, table in self.pairs:
                step = RATE * _quadrants(*sums(a, b))[1]
                table += step
                score += step[some[a], some[b]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], side="left")]
        some = [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.coarse)]
        for a, b, table in self.pairs:
            total += table[some[a], some[b]]
        return _sigmoid(total)


def _part(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0)).cast("int")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns labels.quality of the documents that are not held out."""
    taught = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).where((_part(F.col("doc_id")) != 0) & F.col("quality").isin(0, 1))
    n = taught.count()
    spread = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1_000_003))
    some = taught.where(spread < sample / max(n, 1) * 1_000_003).orderBy(spread, "doc_id", "quality").limit(2 * sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = describe(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["quality", "x"])

    texts = bounded(docs).select(F.col("doc_id").cast("long"), "text").join(F.broadcast(some), "doc_id")  # 2 * sample ids at most
    rows = texts.select("quality", "text").transform(in_arrow, run, "quality int, x array<double>").orderBy(F.xxhash64("x", "quality"), "x", "quality").limit(4 * sample).toArrow()
    model = Model()
    model.fit(np.array(rows["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES)), rows["quality"].to_numpy().astype(np.float64))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    sent = bounded(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = sent.value.score(describe(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= ACCEPT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), (_part(F.col("doc_id")) == 0).alias("held_out"), "text").transform(in_arrow, run, "doc_id long, held_out boolean, score double, predicted int")
