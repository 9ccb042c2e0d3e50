"""N-gram Jaccard self-join of documents on a count-vector R-tree.

A document is the set of its distinct k-word shingles; two link when their Jaccard similarity
reaches a threshold. Shingles are hashed into groups and a document becomes the point of its group
counts: the sum of coordinate minima of two points bounds the overlap of their sets from above.

Distribution. Groups are organised in blocks. If |A and B| / |A or B| >= t, the sets differ in
D <= (1 - t) / (1 + t) * (|A| + |B|) shingles at most, so of K > D blocks at least K - D have equal
coordinates. Size bands keep D tight: a document of band b is indexed at levels b and b + 1, and a
level has K blocks for the largest D that its pairs can have. Each document enters only its D + 1
heaviest blocks, ordered by count: the heaviest block that both share is never among the K - D - 1
lightest of either, so no link is lost. Equal (level, block, coordinates) form a leaf cell.

Verification. Cells of up to SMALL points yield all pairs. In larger cells every point is tried
against the first point and its neighbour; what those links do not connect is searched again with
R-trees over count vectors: points are packed into leaves with bounding boxes, and for each query a
box, then a point, survives only if the sum of coordinate minima reaches the overlap needed. Large
cells with the same smallest node are searched together, so that a set travels once for all of
them; a task holds two parts of about PART_SHINGLES shingles each. Surviving pairs are verified on
their shingle sets inside the task, and only links between points that earlier links do not join
leave it: fewer rows than points, however alike a family of texts is. Only connectivity is asked,
so pairs of one component are not sought. Copies of one set are a single node throughout, known by
a 128-bit digest; a node is named by half of it, and by both where two sets share that half.

Edge cases: null or empty texts and texts without words have an empty set and link with nothing;
fewer than k words make one shingle; a null doc_id gives a row with a null component; rows that
repeat a doc_id with other texts link by their own texts, each in its own component of that text;
an empty table gives no rows; other columns, whatever their names, are ignored by components_of and
kept by one_of_each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import bit_table, bounded, components, in_arrow, maybe, staged

SLACK = 1.25
GROUPS = 128
TREE_GROUPS = 1024
MOST_COUNT = 65535
CELL_BITS = 12
SMALL = 16
PART_SHINGLES = 1 << 20
LEAF = 32


def most_differing(a: int, num: int, den: int) -> int:
    """Largest symmetric difference of two linked sets whose sizes sum to a."""
    return (den - num) * a // (den + num)


def sizes_of_bands(num: int, den: int, top: int = 1 << 26) -> np.ndarray:
    """Largest size of each band: linked sets lie in the same band or in neighbouring ones."""
    out, size = [], 1
    while size < top:
        out.append(size)
        size = max(size + 1, size * den // num + 1)
    return np.array([*out, size])


class Levels:
    """Bands and block counts for a threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.tops = sizes_of_bands(num, den)
        self.differing = np.array([most_differing(2 * int(t), num, den) for t in self.tops])
        self.blocks = np.array([math.ceil(SLACK * (d + 1)) for d in self.differing])

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.tops, n)

    def entered(self, n: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Blocks that a set of size n enters at a level; 0 where only equal sets can link."""
        most = np.minimum((self.den - self.num) * (n + self.tops[level]) // (self.den + self.num), (self.den - self.num) * n // self.num)
        return np.where(most > 0, most + 1, 0)


def cells(shingles: np.ndarray, offsets: np.ndarray, levels: Levels) -> tuple[np.ndarray, np.ndarray]:
    """Leaf cells of each set at both of its levels, end to end, and the offsets of the rows."""
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    h = tk.mix(shingles ^ tk.U(0x5851F42D4C957F2D))
    keys, owners = [], []
    for step in (0, 1):
        level = levels.of(n) + step
        k, enter = levels.blocks[level], np.where(n > 0, levels.entered(n, level), 0)
        if not enter.any():
            continue
        base = np.concatenate(([0], np.cumsum(k)))
        block = ((h >> tk.U(20)) % k[row].astype(np.uint64)).astype(np.int64)
        group = h & tk.U((1 << CELL_BITS) - 1)
        at = base[row] + block
        coordinates, count = np.zeros(base[-1], np.uint64), np.bincount(at, minlength=base[-1])
        np.add.at(coordinates, at, tk.mix(group + tk.U(0x1234567)))
        owner = np.repeat(np.arange(len(n)), k)
        number = np.arange(base[-1]) - base[owner]
        key = tk.mix(coordinates + (level[owner].astype(np.uint64) << tk.U(40)) + number.astype(np.uint64) * tk.U(0x9E3779B97F4A7C15))
        order = np.lexsort((coordinates, -count, owner))
        rank = np.arange(base[-1]) - base[owner[order]]
        kept = order[rank < enter[owner[order]]]
        keys.append(key[kept])
        owners.append(owner[kept])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return keys[order], np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=len(n)))))


def points(shingles: np.ndarray, offsets: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Count vector of each set over a power of two of groups; counts end at MOST_COUNT, see spare()."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    group = (tk.mix(shingles) >> tk.U(64 - groups.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(row * groups + group, minlength=n * groups), MOST_COUNT).reshape(n, groups)


def spare(vectors: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What a set holds beyond its clipped counts; the smaller spare of two sets widens their bound."""
    return sizes - vectors.sum(axis=1)


def needed(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Smallest overlap that links sets of sizes a and b."""
    return -((-num * (a + b)) // (num + den))


class RTree:
    """Points packed into leaves of LEAF, nearest sizes together, with the upper corner of each box."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        # Sort-tile-recursive packing on size, then on the two widest coordinates within runs of it.
        wide = np.argsort(-vectors.var(axis=0), kind="stable")[:2]
        run = np.empty(len(sizes), np.int64)
        run[np.argsort(sizes, kind="stable")] = np.arange(len(sizes)) // (LEAF * 8)
        self.order = np.lexsort((vectors[:, wide[1]], vectors[:, wide[0]], run))
        self.vectors, self.sizes = vectors[self.order], sizes[self.order]
        starts = np.arange(0, len(sizes), LEAF)
        self.high = np.maximum.reduceat(self.vectors, starts, axis=0)
        self.least = np.minimum.reduceat(self.sizes, starts)
        self.spare = spare(self.vectors, self.sizes)
        self.most_spare = np.maximum.reduceat(self.spare, starts)

    def search(self, vectors: np.ndarray, sizes: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each query the points whose bound reaches the overlap needed."""
        for i, (q, n, more) in enumerate(zip(vectors, sizes, spare(vectors, sizes), strict=True)):
            boxes = np.flatnonzero(np.minimum(self.high, q).sum(axis=1) + np.minimum(self.most_spare, more) >= needed(self.least, n, num, den))
            at = (boxes[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < len(self.sizes)]
            hit = at[np.minimum(self.vectors[at], q).sum(axis=1) + np.minimum(self.spare[at], more) >= needed(self.sizes[at], n, num, den)]
            yield i, self.order[hit]


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, data, offsets in tk.chunks(column):
        words, row = tk.word_hashes(data, offsets)
        values, where = tk.shingles(words, row, b - a, k)
        yield a, b, *tk.distinct_by_row(values, where, b - a)


def _row_sums(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _digests(sets: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit halves of a digest of each set."""
    n = np.diff(offsets).astype(np.uint64)
    return [tk.mix(_row_sums(tk.mix(sets ^ tk.U(salt)), offsets) + n) for salt in (0xA5A5A5A5, 0x3C3C3C3C00000000)]


FEATURES = "doc_id long, n_shingles long, d1 long, d2 long, cells array<long>, point binary"


def features(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(num, den)
        for batch in batches:
            for a, b, sets, offsets in _sets(batch.column(1), k):
                keys, bounds = cells(sets, offsets, levels)
                n = np.diff(offsets)
                digests = _digests(sets, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n), *map(tk.longs, digests), tk.lists(keys, bounds), pa.array([p.tobytes() for p in points(sets, offsets).astype("<u2")], pa.binary())],
                    ["doc_id", "n_shingles", "d1", "d2", "cells", "point"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").transform(in_arrow, run, FEATURES)


def _cell_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (cell, node) in order: pairs to verify, and the membership of large cells.

    Streams: a run is held only up to SMALL nodes. `a` is null in rows that say that b is in a large cell.
    """
    cell, first, last, held = None, None, None, []
    out: list[list] = [[], [], []]

    def pair(c, a, b):
        out[0].append(c)
        out[1].append(a)
        out[2].append(b)

    def batch_of():
        made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["cell", "a", "b"])
        for x in out:
            x.clear()
        return made

    for batch in batches:
        c, n = (x.to_numpy() for x in batch.columns)
        # Only runs of at least two distinct nodes matter, and most cells have one.
        same = np.concatenate(([False], (c[1:] == c[:-1]) & (n[1:] == n[:-1])))
        c, n = c[~same], n[~same]
        alone = np.concatenate(([False], c[1:] != c[:-1])) & np.concatenate((c[1:] != c[:-1], [False]))
        c, n = c[~alone], n[~alone]
        for key, node in zip(c.tolist(), n.tolist(), strict=True):
            if key != cell:
                cell, first, last, held = key, node, node, [node]
                continue
            if node == last:
                continue
            if held is not None and len(held) < SMALL:
                for other in held:
                    pair(None, other, node)
                held.append(node)
            else:
                if held is not None:
                    for other in held:
                        pair(cell, None, other)
                    held = None
                pair(cell, None, node)
                pair(None, first, node)
                pair(None, last, node)
            last = node
        if len(out[0]) >= 1 << 16:
            yield batch_of()
    yield batch_of()


def _overlaps(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets reach the threshold."""
    for batch in batches:
        a, b = [], []
        for x, y, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            s, t = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            if both and den * both >= num * (len(s) + len(t) - both):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _named_sets(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, set: the shingle sets of the wanted(node), read again from the texts of their documents."""
    owners = staged(wanted.distinct().join(nodes.select("node", "d1", "d2", "doc_id"), "node"), "owners")
    sent = docs.sparkSession.sparkContext.broadcast(bit_table(owners, "doc_id"))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.fill_null(pa.array(maybe(sent.value, pc.fill_null(batch.column(0), 0).to_numpy())), False))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values, offsets in _sets(batch.column(1), k):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        *map(tk.longs, _digests(values, offsets)),
                        pa.array([values[i:j].tobytes() for i, j in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary()),
                    ],
                    ["doc_id", "d1", "d2", "set"],
                )

    # Rows that repeat a doc_id may hold other texts: a set is known by its digest.
    some = docs.select(F.col("doc_id").cast("long"), "text").transform(in_arrow, held, "doc_id long, text string").join(owners.select("doc_id").distinct(), "doc_id", "left_semi")
    read = some.transform(in_arrow, sets, "doc_id long, d1 long, d2 long, set binary")
    return staged(read.join(owners, ["doc_id", "d1", "d2"]).dropDuplicates(["node"]).select("node", "set"), "sets")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of pairs(a, b) of nodes that link; first by the bound on their points, then on their sets."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, GROUPS).astype(np.int64) for c in (2, 3))
            n, m = (batch.column(c).to_numpy() for c in (4, 5))
            kept = pa.array(np.minimum(p, q).sum(axis=1) + np.minimum(spare(p, n), spare(q, m)) >= needed(n, m, num, den))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(kept)

    small = nodes.select("node", "n", "point")
    near = staged(
        pairs.join(small.toDF("a", "n", "p"), "a").join(small.toDF("b", "m", "q"), "b").select("a", "b", "p", "q", "n", "m").transform(in_arrow, bounded, "a long, b long"),
        "bounded",
    )
    held = _named_sets(near.select(F.explode(F.array("a", "b")).alias("node")), docs, nodes, k)
    return (
        near.join(held.toDF("a", "s"), "a")
        .join(held.toDF("b", "t"), "b")
        .select("a", "b", "s", "t")
        .transform(in_arrow, lambda batches: _overlaps(batches, num, den), "a long, b long")
    )


class Forest:
    """Union-find over positions."""

    def __init__(self, labels: np.ndarray):
        """Positions with equal labels are joined from the start."""
        _, first, at = np.unique(labels, return_index=True, return_inverse=True)
        self.root = first[at].tolist()

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i


def _tree_links(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Links that join components in each run of rows of one task (family, first, second)."""
    held: pa.Table | None = None

    def searched(rows: pa.Table) -> pa.RecordBatch:
        part, node, component = (rows[c].to_numpy() for c in ("part", "node", "component"))
        first, second = rows["first"][0].as_py(), rows["second"][0].as_py()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["set"].combine_chunks()]
        n = np.array([len(x) for x in sets])
        point = points(np.concatenate(sets), np.concatenate(([0], np.cumsum(n))), TREE_GROUPS).astype(np.int32)
        by_cell: dict[int, list[int]] = {}
        for i, cells_of in enumerate(rows["cells"].to_pylist()):
            for cell in cells_of:
                by_cell.setdefault(cell, []).append(i)
        forest, tried, a, b = Forest(component), set(), [], []
        for members in by_cell.values():
            members = np.array(members)
            left, right = members[part[members] == first], members[part[members] == second]
            if not len(left) or not len(right) or len({forest.find(i) for i in members.tolist()}) < 2:
                continue
            tree = RTree(point[left], n[left])
            for i, hits in tree.search(point[right], n[right], num, den):
                i = int(right[i])
                for j in left[hits].tolist():
                    x, y, pair = forest.find(i), forest.find(j), (min(i, j), max(i, j))
                    if x == y or pair in tried:
                        continue
                    tried.add(pair)
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                        forest.root[max(x, y)] = min(x, y)
                        a.append(int(node[i]))
                        b.append(int(node[j]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def runs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = [rows[c].to_numpy() for c in ("family", "first", "second")]
        cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1
        for low, high in zip([0, *cut.tolist()], [*cut.tolist(), len(rows)], strict=True):
            if high - low > 1:
                yield searched(rows.slice(low, high - low))

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        same = np.all([rows[c].to_numpy() == rows[c][-1].as_py() for c in ("family", "first", "second")], axis=0)
        whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        held = rows.slice(whole)
        if whole:
            yield from runs(rows.slice(0, whole))
    if held is not None and len(held):
        yield from runs(held)


def components_of(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of Jaccard num / den or more)."""
    made = staged(features(bounded(docs), k, num, den), "shingles")
    # Nodes are distinct sets, named by d1; where different sets share it, by a mix of both halves.
    sets = staged(
        made.where("n_shingles > 0 and doc_id is not null")
        .groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("point").alias("point")),
        "nodes",
    )
    clashes = staged(sets.groupBy(F.col("d1").alias("_d1")).count().where("count > 1").select("_d1"), "clashes")

    def with_node(df: DataFrame) -> DataFrame:
        if not clashes.limit(1).count():
            return df.withColumn("node", F.col("d1"))
        return df.join(clashes, F.col("d1") == F.col("_d1"), "left").withColumn("node", F.when(F.col("_d1").isNull(), F.col("d1")).otherwise(F.xxhash64("d1", "d2"))).drop("_d1")

    nodes = with_node(sets)
    named = with_node(made).withColumn("node", F.when(F.col("n_shingles") > 0, F.col("node")))
    listed = staged(
        named.where("node is not null and doc_id is not null")
        .select(F.explode("cells").alias("cell"), "node")
        .repartition("cell")
        .sortWithinPartitions("cell", "node")
        .transform(in_arrow, _cell_pairs, "cell long, a long, b long"),
        "cells",
    )
    pairs = staged(listed.where("cell is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    edges = staged(verified(pairs, docs, nodes, k, num, den), "links")
    crowded = listed.where("cell is not null").select("cell", F.col("b").alias("node"))
    labels = components(edges)
    if crowded.limit(1).count():
        further = _crowded_links(crowded, labels, docs, nodes, k, num, den)
        if further is not None:
            edges = staged(edges.union(further), "links")
            labels = components(edges)
    # The smallest doc_id of a component names it.
    owner = nodes.join(labels, "node", "left").withColumn("root", F.coalesce("component", "node"))
    names = staged(owner.groupBy("root").agg(F.min("doc_id").alias("component_id")), "names")
    linked = staged(owner.join(names, "root").where("component_id <> doc_id or component is not null").select(F.col("node").alias("_node"), "component_id"), "linked")
    copies = staged(named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("node").alias("_node"), F.col("first").alias("component_id")), "copies")
    return _named(named, linked, copies)


def _named(named: DataFrame, linked: DataFrame, copies: DataFrame) -> DataFrame:
    known = staged(linked.union(copies).groupBy("_node").agg(F.min("component_id").alias("component_id")), "known")
    return named.join(known, F.col("node") == F.col("_node"), "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def _crowded_links(crowded: DataFrame, labels: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, num: int, den: int) -> DataFrame | None:
    """Links between components that meet in a large cell, found by R-trees over the cells of a family."""
    members = staged(
        crowded.distinct().join(labels, "node", "left").select("cell", "node", F.coalesce("component", "node").alias("component")),
        "members",
    )
    # Cells whose smallest node is the same hold much the same nodes: they make a family.
    open_cells = staged(
        members.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("family")).where("low <> high").select("cell", "family"),
        "open",
    )
    if not open_cells.limit(1).count():
        return None
    kin = staged(members.join(open_cells, "cell").groupBy("family", "node", "component").agg(F.collect_list("cell").alias("cells")).join(nodes.select("node", "n"), "node"), "kin")
    sizes = staged(kin.groupBy("family").agg(F.ceil(F.sum("n") / PART_SHINGLES).cast("int").alias("parts")), "sizes")
    part = F.pmod(F.xxhash64("node", "family"), F.col("parts").cast("long")).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("part")).alias("first"), F.greatest(p, F.col("part")).alias("second")))
    return (
        kin.join(sizes, "family")
        .join(_named_sets(kin.select("node"), docs, nodes, k), "node")
        .withColumn("part", part)
        .withColumn("task", F.explode(tasks))
        .select("family", "task.first", "task.second", "part", "node", "component", "cells", "set")
        .repartition("family", "first", "second")
        .sortWithinPartitions("family", "first", "second")
        .transform(in_arrow, lambda batches: _tree_links(batches, num, den), "a long, b long")
    )


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the near copies: of each component the document with the smallest doc_id stays.

    Of rows that repeat that doc_id all stay, as do rows without a doc_id.
    """
    gone = staged(components_of(docs, k, num, den).where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return docs.alias("own").join(gone.alias("gone"), F.col("own.doc_id") == F.col("gone.doc_id"), "left_anti").select("own.*")
