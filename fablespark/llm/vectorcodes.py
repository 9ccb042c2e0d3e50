"""Product codes of integer vectors, assigned through vantage-point trees of each part position.

Components become integers floor(SCALE * x); a vector is cut into PARTS equal parts, and each part is
coded as the nearest entry of its position's codebook. The entries of a position make a
vantage-point tree: a node holds one entry, the rest are split at the median of their distance from
it, and the node keeps the range of distances of both halves. A search first descends to the
nearest leaf, then visits every half whose range can hold an entry as near as the best so far.
Ranges and distances are square roots of exact integers rounded outwards, and a bound equal to the best is
visited, so rounding can only add visits and an equal entry of a lower index is found. What is
visited is measured in 64-bit integers. Trees of one size have one shape, so the searches of all
parts and vectors of a batch advance together, one level at a time.

Each round is one pass over the staged integers; a task hands on one row an entry (count and sums).
No vector is shuffled but for its label's error, whose sums are made before they are joined back.

Edge cases: a vector that is null, or holds null or non-finite components, is dropped; one that is
empty, of a length that PARTS does not divide or other than that of the smallest vec_id, or with a
component of MOST or more in size after scaling, stays without a code and with a null error; fewer
vectors than ENTRIES give fewer entries; vectors of one vec_id start an entry each, in the order of their components, null
ids last; equal entries code as the lowest index; a label without coded vectors has a null error; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .centroids import digest, matrix, moved, scaled, whole
from .common import in_arrow, staged

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Scaled components stay below this, so that a squared distance of up to 1,024 components and an index fit 64 bits.
MOST = 1 << 21
LEAF = 4
BLOCK = 1024


@dataclass
class Forest:
    """Vantage-point trees of all part positions, of one shape: rows are positions, columns are nodes."""

    books: np.ndarray  # (parts, entries, components)
    left: np.ndarray  # (nodes,) child of the nearer half, or -1 at a leaf
    right: np.ndarray  # (nodes,) child of the farther half
    members: np.ndarray  # (parts, nodes, LEAF): entries measured at a node, -1 for none
    low: np.ndarray  # (parts, nodes, 2): distances of the halves from the node's entry, rounded down
    high: np.ndarray  # the same, rounded up


def _root(squares: np.ndarray, up: bool) -> np.ndarray:
    """Square roots of exact integers, rounded outwards past every error of conversion and root."""
    r = np.sqrt(squares.astype(np.float64))
    return r * (1 + 2.0**-50) if up else r * (1 - 2.0**-50)


def forest(books: np.ndarray) -> Forest:
    """Trees over the entries of every position."""
    parts, entries, _ = books.shape
    shape: list[tuple[int, int]] = []

    def grow(n: int) -> int:
        node = len(shape)
        shape.append((-1, -1))
        if n > LEAF:
            left = grow((n - 1) // 2)
            shape[node] = (left, grow(n - 1 - (n - 1) // 2))
        return node

    grow(entries)
    left, right = np.array(shape).T
    members = np.full((parts, len(shape), LEAF), -1, np.int64)
    low, high = np.zeros((parts, len(shape), 2)), np.zeros((parts, len(shape), 2))

    def fill(p: int, node: int, own: np.ndarray) -> None:
        if left[node] < 0:
            members[p, node, : len(own)] = own
            return
        book = books[p]
        # The entry farthest from the first one lies at the rim, where distances spread most.
        vantage = int(own[((book[own] - book[own[0]]) ** 2).sum(axis=1).argmax()])
        members[p, node, 0] = vantage
        rest = own[own != vantage]
        squares = ((book[rest] - book[vantage]) ** 2).sum(axis=1)
        order = np.argsort(squares, kind="stable")
        half = (len(own) - 1) // 2
        for side, child, some in ((0, left[node], order[:half]), (1, right[node], order[half:])):
            low[p, node, side], high[p, node, side] = _root(squares[some].min(), False), _root(squares[some].max(), True)
            fill(p, child, rest[some])

    for p in range(parts):
        fill(p, 0, np.arange(entries))
    return Forest(books, left, right, members, low, high)


def search(trees: Forest, x: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of position part[i] to each x[i]; lowest index among equals."""
    entries = trees.books.shape[1]
    best = np.full(len(x), np.iinfo(np.int64).max)  # squared distance * entries + index

    def measure(q: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Squared distance to the entry of each node; the best of each query falls."""
        first = np.zeros(len(q), np.int64)
        for m in range(LEAF):
            own = trees.members[part[q], node, m]
            some = np.flatnonzero(own >= 0) if m else slice(None)
            if m and not len(some):
                break
            d = ((x[q[some]] - trees.books[part[q[some]], own[some]]) ** 2).sum(axis=1)
            np.minimum.at(best, q[some], d * entries + own[some])
            if not m:
                first = d
        return first

    def bounds(q: np.ndarray, node: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower bounds of the distance from each query to both halves of its node."""
        down, up = _root(squares, False)[:, None], _root(squares, True)[:, None]
        gap = np.maximum(np.maximum(down - trees.high[part[q], node], trees.low[part[q], node] - up), 0)
        return tuple((gap * (1 - 2.0**-50)).T)

    q, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    while len(q):  # down to the nearest leaf
        squares = measure(q, node)
        inner = trees.left[node] >= 0
        q, node, squares = q[inner], node[inner], squares[inner]
        a, b = bounds(q, node, squares)
        node = np.where(a <= b, trees.left[node], trees.right[node])
    q, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    while len(q):  # all that may be as near
        squares = measure(q, node)
        inner = trees.left[node] >= 0
        q, node, squares = q[inner], node[inner], squares[inner]
        reach = _root(best[q] // entries, True)
        a, b = bounds(q, node, squares)
        near, far = a <= reach, b <= reach
        q, node = np.concatenate((q[near], q[far])), np.concatenate((trees.left[node[near]], trees.right[node[far]]))
    return best % entries, best // entries


def _codes(trees: Forest, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of vectors their parts (rows by vector, then part), and codes and squared distances by vector and part."""
    parts, _, size = trees.books.shape
    for low in range(0, len(x), BLOCK):
        cut = x[low : low + BLOCK].reshape(-1, size)
        code, squares = search(trees, cut, np.tile(np.arange(parts), len(cut) // parts))
        yield slice(low, low + BLOCK), cut, code.reshape(-1, parts), squares.reshape(-1, parts)


def _sums(books: np.ndarray):
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each entry in use in this task."""
        trees = forest(books)
        count, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, size), np.int64)
        for batch in batches:
            x, _ = matrix(batch.column(0), parts * size)
            for _, cut, code, _ in _codes(trees, x):
                slot = (code + np.arange(parts) * entries).ravel()
                count += np.bincount(slot, minlength=len(count))
                np.add.at(total, slot, cut)
        used = np.flatnonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * size, pa.int32()), pa.array(total[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), lists], ["cluster", "n", "sums"])

    return run


def _coded(books: np.ndarray):
    parts, _, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = forest(books)
        for batch in batches:
            x, at = matrix(batch.column(2), parts * size)
            code, error = np.full(len(batch), None, object), np.zeros(len(batch), np.int64)
            for some, _, codes, squares in _codes(trees, x):
                code[at[some]] = [bytes(c).hex() for c in codes.astype(np.uint8)]
                error[at[some]] = squares.sum(axis=1)
            none = np.ones(len(batch), bool)
            none[at] = False
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, mask=none)], ["vec_id", "label", "code", "error"])

    return run


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every whole vector; at most 256 entries."""
    x = F.col("embedding")
    kept = vectors.select(F.col("vec_id").cast("long"), "label", "embedding").where(x.isNotNull() & whole(x))
    fits = (F.size(x) > 0) & (F.size(x) % parts == 0)
    kept = staged(kept.select("vec_id", "label", F.when(fits, scaled(x, scale, MOST)).alias("x")), "codes")
    first = [r["x"] for r in kept.where("x is not null").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()]
    if not first:
        none = F.lit(None)
        return kept.select("vec_id", none.cast("string").alias("code"), none.cast("long").alias("error"), none.cast("long").alias("label_error"), F.sha2(F.lit(""), 256).alias("codebooks_sha256"))
    dims = len(first[0])
    books = np.array([r for r in first if len(r) == dims], np.int64).reshape(-1, parts, dims // parts).transpose(1, 0, 2).copy()
    one = kept.withColumn("x", F.when(F.size("x") == dims, F.col("x")))
    for _ in range(rounds):
        sums = one.select("x").transform(in_arrow, _sums(books), "cluster long, n long, sums array<long>")
        books = moved(sums, books.reshape(-1, books.shape[2])).reshape(books.shape)
    label = kept.schema["label"].dataType.simpleString()
    done = staged(one.select("vec_id", "label", "x").transform(in_arrow, _coded(books), f"vec_id long, label {label}, code string, error long"), "coded")
    errors = staged(done.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "_label")
    return done.join(errors, F.col("label").eqNullSafe(F.col("_label")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
