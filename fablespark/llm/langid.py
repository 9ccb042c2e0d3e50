"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become lower-cased letters with everything else a space; their 1- to 3-grams are hashed into
2^BITS features. Document frequencies come from all training documents (a fixed-size vector from
each partition, summed). The weights are trained on SAMPLE documents of each language, at most,
by follow-the-regularised-leader with an elastic net, which leaves most weights exactly zero;
documents whose key leaves 1 are kept out of that and set the temperature that calibrates scores.
Prediction is one pass over the texts with a weight table of 2^BITS rows.

Whatever crc32(doc_id as text) mod 5 leaves 0 is held out and never learned from.

Edge cases: null texts and texts without a letter are `und` with score 0; a null doc_id is held
out; a null lang or a text without a letter teaches nothing; with nothing to learn from, every document is `und`; repeated
rows count as often as they occur; an empty table gives no rows; other columns are ignored by
predict() and kept by accepted().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import bounded, in_arrow

BITS = 16
GRAMS = 3
SAMPLE = 500
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-4
EPOCHS = 4
SCALE = 30.0
ACCEPT = 0.5
_letters: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    """For each code point of the basic plane its lower-case letter, or a space."""
    if "table" not in _letters:
        low = [c if not (0xD800 <= c < 0xE000) else 32 for c in range(1 << 16)]
        _letters["table"] = np.array([ord(y) if (x := chr(c)).isalpha() and len(y := x.lower()) == 1 else ord(y[0]) if x.isalpha() else 32 for c in low], np.uint32)
    return _letters["table"]


def points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points of all texts, each followed by a space, runs of spaces as one; offsets of the rows."""
    offsets = np.concatenate(([0], np.cumsum([len(t or "") + 1 for t in texts])))
    raw = np.frombuffer(" ".join([*(t or "" for t in texts), ""]).encode("utf-32-le", "replace"), "<u4")
    high = raw >= 1 << 16
    out = letters()[np.where(high, 32, raw)]
    if high.any():
        other = np.unique(raw[high])
        own = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in other.tolist()], np.uint32)
        out[high] = own[np.searchsorted(other, raw[high])]
    kept = np.ones(len(out), bool)
    kept[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[kept], np.concatenate(([0], np.cumsum(kept)))[offsets]


def features(x: np.ndarray) -> Iterator[np.ndarray]:
    """For each n the feature of the n-gram that starts at each position."""
    h = x
    for n in range(1, GRAMS + 1):
        if n > 1:
            h = h[:-1] * np.uint32(0x01000193) + x[n - 1 :]
        yield ((h + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def bounds(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one start of the n-grams within each row, its closing space included."""
    return offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - n + 1)


def _batches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, _, _ in tk.chunks(column):
        yield a, b, *points(column.slice(a, b - a).to_pylist())


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of one partition; feature -1 counts the documents."""
    df, n, seen = np.zeros(1 << BITS, np.int64), 0, np.zeros(1 << BITS, bool)
    for batch in batches:
        for a, b, x, offsets in _batches(batch.column(0)):
            grams = list(features(x))
            ends = [bounds(offsets, k + 1)[1] for k in range(GRAMS)]
            for r in range(b - a):
                seen.fill(False)
                for g, end in zip(grams, ends, strict=True):
                    seen[g[offsets[r] : end[r]]] = True
                df[np.flatnonzero(seen)] += 1
            n += b - a
    used = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], used)).astype(np.int32)), pa.array(np.concatenate(([n], df[used])))], ["feature", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse counts of each row."""
    for batch in batches:
        ids, counts = [], []
        for a, b, x, offsets in _batches(batch.column(2)):
            grams = list(features(x))
            ends = [bounds(offsets, k + 1)[1] for k in range(GRAMS)]
            for r in range(b - a):
                f, n = np.unique(np.concatenate([g[offsets[r] : end[r]] for g, end in zip(grams, ends, strict=True)]), return_counts=True)
                ids.append(f.astype(np.int32))
                counts.append(n.astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f.tobytes() for f in ids], pa.binary()), pa.array([n.tobytes() for n in counts], pa.binary())], ["lang", "part", "ids", "counts"])


class Model:
    """Languages, weights by feature (idf included), biases and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray):
        self.langs, self.idf = langs, idf
        self.weights = np.zeros((1 << BITS, len(langs)), np.float32)
        self.bias = np.zeros(len(langs))
        self.temperature = 1.0

    def values(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return SCALE * counts / max(counts.sum(), 1) * self.idf[ids]

    def fit(self, rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> None:
        """rows: (language, part, ids, counts); part 1 sets the temperature, the others the weights."""
        k = len(self.langs)
        z, n = np.zeros(((1 << BITS) + 1, k)), np.zeros(((1 << BITS) + 1, k))

        def at(ids: np.ndarray) -> np.ndarray:
            zi = z[ids]
            w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[ids])) / ALPHA + L2)
            return np.where(np.abs(zi) <= L1, 0.0, w)

        data = [(y, part, np.append(ids, 1 << BITS), np.append(self.values(ids, counts), 1.0)) for y, part, ids, counts in rows]
        taught = [d for d in data if d[1] != 1] or data
        order = np.random.default_rng(7)
        for _ in range(EPOCHS):
            for i in order.permutation(len(taught)):
                y, _, ids, x = taught[i]
                w = at(ids)
                p = _softmax(x @ w)
                p[y] -= 1
                g = x[:, None] * p[None, :]
                sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / ALPHA
                z[ids] += g - sigma * w
                n[ids] += g * g
        every = at(np.arange((1 << BITS) + 1))
        self.bias = every[-1]
        self.weights = (every[:-1] * self.idf[:, None]).astype(np.float32)
        kept = [d for d in data if d[1] == 1] or data
        scores = np.array([x @ every[ids] for _, _, ids, x in kept])
        truth = np.array([y for y, *_ in kept])
        grid = np.geomspace(0.05, 20, 121)
        # Targets a little under 1, as for as many successes plus one failure: separable data stay finite.
        target = np.full(scores.shape, 1 / (len(truth) + 2) / max(1, len(self.langs) - 1))
        target[np.arange(len(truth)), truth] = (len(truth) + 1) / (len(truth) + 2)
        loss = [-(target * np.log(np.maximum(_softmax(scores / t), 1e-12))).sum() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        langs, best = [], []
        for a, b, x, offsets in _batches(column):
            rows, total, count = b - a, np.zeros((b - a, len(self.langs))), 0
            for n, g in enumerate(features(x), 1):
                starts, ends = bounds(offsets, n)
                sums = np.concatenate((np.zeros((1, len(self.langs))), np.cumsum(self.weights[g], axis=0, dtype=np.float64)))
                total += sums[np.minimum(ends, len(g))] - sums[np.minimum(starts, len(g))]
                count = count + ends - starts
            p = _softmax((SCALE * total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)
            solid = np.concatenate(([0], np.cumsum(x != 32)))
            some = (solid[offsets[1:]] - solid[offsets[:-1]] > 0) & bool(self.langs)
            top = p.argmax(axis=1) if self.langs else np.zeros(rows, int)
            langs += [self.langs[t] if s else "und" for t, s in zip(top, some, strict=True)]
            best.append(np.where(some, p[np.arange(rows), top] if self.langs else 0.0, 0.0))
        return langs, np.concatenate(best) if best else np.zeros(0)


def _softmax(x: np.ndarray) -> np.ndarray:
    if x.shape[-1] == 0:
        return x
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _part(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0)).cast("int")


def train(docs: DataFrame) -> Model:
    part = _part(F.col("doc_id"))
    bounded(docs)
    taught = docs.where((part != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r[0]: r[1] for r in taught.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    counts = taught.select("text").transform(in_arrow, _frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros((1 << BITS) + 1)
    df[counts["feature"].to_numpy() + 1] = counts["n"].to_numpy()
    model = Model(langs, np.log((1 + df[0]) / (1 + df[1:])) + 1)
    if not langs:
        return model
    # A row is sampled by its key and text, at a rate that gives SAMPLE rows of its language on average;
    # rows with the least keys come first, so that the bound on all of them falls alike in every run.
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003))
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, float(SAMPLE) / n)])
    sample = taught.where(spread < rate[F.col("lang")] * 1_000_003).select("lang", part.alias("part"), "text", spread.alias("spread")).orderBy("spread", "lang", "text").limit(2 * SAMPLE * len(langs)).drop("spread")
    at = {k: i for i, k in enumerate(langs)}
    rows = sample.transform(in_arrow, _counted, "lang string, part int, ids binary, counts binary").toArrow().to_pylist()
    rows = sorted(((at[r["lang"]], r["part"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in rows), key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes(), r[3].tobytes()))
    model.fit(rows)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    sent = bounded(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score = sent.value.predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", (_part(F.col("doc_id")) == 0).alias("held_out"), "text").transform(in_arrow, run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame) -> DataFrame:
    """docs whose language is told with a score of ACCEPT at least; a null lang takes the predicted one."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score = sent.value.predict(batch.column(text))
            langs, columns = pa.array(langs, pa.string()), batch.columns
            columns[lang] = pc.coalesce(columns[lang], langs.cast(columns[lang].type))
            told = pc.and_(pc.not_equal(langs, "und"), pa.array(score >= ACCEPT))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(told)

    return docs.transform(in_arrow, run, docs.schema)
