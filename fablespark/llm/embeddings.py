"""Near-duplicate embeddings by spherical-cap filters with structured product codes.

A fixed random rotation spreads every vector over all dimensions, however uneven its components.
The dimensions are then split into BLOCKS; each block has CODES random unit vectors, and a filter
direction is one choice from every block, so CODES^BLOCKS directions need BLOCKS * CODES vectors.
A vector is list-decoded to every direction whose inner product exceeds TAU (a cap of the sphere)
and to its FEWEST best in any case: block scores are sorted, and for each code of the first block
those of the second that reach TAU with it are found by bisection. Vectors meet where label and
filter agree and are verified by cosine in double precision.

Equal vectors are one node with a multiplicity. Large buckets are dealt over pairs of parts of at
most PART nodes, and each pair of nodes counts only at its smallest common filter, so a task holds
two parts, no pair leaves it, and every link is counted once. Tasks emit link counts per node and a
spanning forest of the links.

Recall is a property of the filters; at cosine 0.93 it is measured in the tests against brute force.

Edge cases: a vector that is null, empty, zero or holds null or non-finite components, and one
with a null label, links with nothing and is its own component; vectors of different lengths never
link; rows that repeat a vec_id are nodes of their own that share the id; a null vec_id is kept
and its component is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, in_arrow, staged

LINK = 0.93
BLOCKS = 2
CODES = 512
FEWEST = 16
SIGMAS = 3.55
PART = 1024


def codes_of(dims: int) -> int:
    """Code vectors of a block; fewer in few dimensions, where caps as narrow would be too small."""
    return min(CODES, max(2, int(2 ** (dims / 4))))


def codes(dims: int) -> list[tuple[slice, np.ndarray]]:
    """Slices of the dimensions and the code vectors of each, the same in every task."""
    rng, out = np.random.default_rng([77, dims]), []
    edges = np.linspace(0, dims, min(BLOCKS, dims) + 1).astype(int)
    for a, b in zip(edges, edges[1:], strict=False):
        x = rng.normal(size=(codes_of(dims), b - a))
        out.append((slice(a, b), x / np.linalg.norm(x, axis=1, keepdims=True)))
    return out


@lru_cache(4)
def rotation(dims: int) -> np.ndarray:
    """An orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([78, dims]).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def decode(unit: np.ndarray) -> list[np.ndarray]:
    """For each unit vector the sorted filters it falls in: all that reach TAU, and its FEWEST best in any case.

    With scores sorted, any combination among the FEWEST best has its i-th and j-th code with
    (i + 1) * (j + 1) <= FEWEST.
    """
    dims = unit.shape[1]
    n, tau = codes_of(dims), SIGMAS / np.sqrt(dims)
    turned = unit @ rotation(dims)
    parts = [(turned[:, s] @ c.T) / np.sqrt(min(BLOCKS, dims)) for s, c in codes(dims)]
    tops = [np.argsort(-p, axis=1) for p in parts]
    scores = [np.take_along_axis(p, t, axis=1) for p, t in zip(parts, tops, strict=True)]
    if len(parts) == 1:
        few = np.clip((scores[0] >= tau).sum(axis=1), FEWEST, None)
        return [np.sort(t[:k]) for t, k in zip(tops[0], few, strict=True)]
    i, j = np.array([(i, j) for i in range(min(n, FEWEST)) for j in range(min(n, FEWEST)) if (i + 1) * (j + 1) <= FEWEST]).T
    out = []
    for first, second, left, right in zip(*tops, *scores, strict=True):
        far = int((left + right[0] >= tau).sum())
        reach = np.searchsorted(-right, left[:far] - tau, "right")
        if reach.sum() >= FEWEST:
            own = np.concatenate([first[k] * n + second[:m] for k, m in enumerate(reach.tolist())])
        else:
            best = np.argsort(-(left[i] + right[j]), kind="stable")[:FEWEST]
            own = first[i[best]] * n + second[j[best]]
        out.append(np.sort(own))
    return out


def _filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns node, label, embedding, copies and the filters of each vector."""
    for batch in batches:
        vectors = [np.array(v, np.float64) for v in batch.column(2).to_pylist()]
        out: list = [None] * len(vectors)
        for dims in {len(v) for v in vectors}:
            same = [i for i, v in enumerate(vectors) if len(v) == dims]
            for some in (same[k : k + 512] for k in range(0, len(same), 512)):
                for i, f in zip(some, decode(_unit(np.array([vectors[i] for i in some]))), strict=True):
                    out[i] = f
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "filters"])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _first_common(a: np.ndarray, b: np.ndarray, early: list[np.ndarray]) -> np.ndarray:
    """Of pairs (a, b), those without a common value in `early`, the filters below this bucket's."""
    if len(a) < 4096:
        sets = {i: frozenset(early[i].tolist()) for i in np.union1d(a, b).tolist()}
        return np.array([sets[i].isdisjoint(sets[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], bool)
    names, at = np.unique(np.concatenate(early), return_inverse=True)
    row = np.repeat(np.arange(len(early)), [len(e) for e in early])
    shared = np.zeros((len(early), len(early)), bool)
    for low in range(0, len(names), 2048):
        m = np.zeros((len(early), 2048), np.float32)
        here = (at >= low) & (at < low + 2048)
        m[row[here], at[here] - low] = 1
        shared |= m @ m.T > 0
    return ~shared[a, b]


def _linked(bucket: int, crossing: bool, side: np.ndarray, node: np.ndarray, copies: np.ndarray, vectors: list, filters: list) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Links between the two sides of a bucket's task, or within one: node, another node of its tree, links."""
    sizes = np.array([len(v) for v in vectors])
    a, b = [], []
    for dims in np.unique(sizes):
        at = np.flatnonzero(sizes == dims)
        x = _unit(np.array([vectors[i] for i in at], np.float64))
        i, j = np.nonzero(np.triu(x @ x.T >= LINK, 1))
        a.append(at[i])
        b.append(at[j])
    a, b = np.concatenate(a), np.concatenate(b)
    keep = node[a] != node[b]
    if crossing:
        keep &= side[a] != side[b]
    a, b = a[keep], b[keep]
    if len(a):
        own = _first_common(a, b, [f[f < bucket] for f in filters])
        a, b = a[own], b[own]
    if not len(a):
        return None
    links = np.bincount(a, copies[b], minlength=len(node)) + np.bincount(b, copies[a], minlength=len(node))
    root = list(range(len(node)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j)] = min(i, j)
    used = np.flatnonzero(links)
    return node[used], node[[find(i) for i in used.tolist()]], links[used].astype(np.int64)


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal task, at most two parts each, compared one run at a time."""
    held: pa.Table | None = None

    def compared(rows: pa.Table) -> pa.RecordBatch:
        keys = [rows[c].to_numpy() for c in ("bucket", "filter", "first", "second")]
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        runs = np.concatenate(([0], cut, [len(rows)]))
        part, node, copies = (rows[c].to_numpy() for c in ("part", "node", "copies"))
        vectors, filters = ([np.asarray(v) for v in rows[c].to_numpy()] for c in ("embedding", "filters"))
        out = [
            x
            for a, b in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True)
            if b - a > 1 and (x := _linked(keys[1][a], keys[2][a] != keys[3][a], part[a:b], node[a:b], copies[a:b], vectors[a:b], filters[a:b]))
        ]
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "other", "links"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        same = np.all([rows[c].to_numpy() == rows[c][-1].as_py() for c in ("bucket", "filter", "first", "second")], axis=0)
        whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        held = rows.slice(whole)
        if whole:
            yield compared(rows.slice(0, whole).combine_chunks())
    if held is not None and len(held):
        yield compared(held.combine_chunks())


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long"), "label", "embedding")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce((F.size("embedding") > 0) & finite, F.lit(False))
    keyed = staged(rows.withColumn("digest", F.when(usable, F.sha2(F.to_json(F.struct("label", "embedding")), 256))), "vectors")
    # A node is a distinct vector, named by its digest: rows that repeat a vec_id with other vectors are other nodes.
    groups = staged(
        keyed.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.xxhash64("digest")),
        "nodes",
    )
    first = keyed.join(groups, "digest").where("vec_id = first").dropDuplicates(["digest"])
    filtered = staged(
        first.select("node", F.xxhash64("label").alias("bucket"), "embedding", "copies").transform(in_arrow, _filtered, f"node long, bucket long, embedding {kind}, copies long, filters array<int>"),
        "filters",
    )
    entries = filtered.select("bucket", F.explode("filters").alias("filter"))
    sizes = staged(entries.groupBy("bucket", "filter").count().where("count > 1").select("bucket", "filter", F.ceil(F.col("count") / PART).cast("int").alias("parts")), "buckets")
    part = F.pmod(F.xxhash64("node", "filter"), F.col("parts").cast("long")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("part")).alias("first"), F.greatest(p, F.col("part")).alias("second")))
    found = staged(
        filtered.withColumn("filter", F.explode("filters"))
        .join(sizes, ["bucket", "filter"])
        .withColumn("part", part)
        .withColumn("pair", F.explode(pairs))
        .select("bucket", "filter", "pair.first", "pair.second", "part", "node", "copies", "embedding", "filters")
        .repartition("bucket", "filter", "first", "second")
        .sortWithinPartitions("bucket", "filter", "first", "second", "node")
        .transform(in_arrow, _tasks, "node long, other long, links long"),
        "links",
    )
    labels = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = staged(groups.join(counts, "node", "left").join(labels, "node", "left").withColumn("root", F.coalesce("component", "node")), "nodes")
    names = nodes.groupBy("root").agg(F.min("first").alias("name"))
    nodes = staged(nodes.join(names, "root").select("digest", "links", "copies", "name"), "nodes")
    return (
        keyed.select("vec_id", "digest")
        .join(nodes, "digest", "left")
        .select(
            "vec_id",
            (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
            F.coalesce("name", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
