"""Ordered scans: state carried along the rows of a key, whatever the tasks that hold them.

`folded` is the plain one: a task reads the sorted rows of its keys and carries the state from batch to batch,
so memory is that of one batch, and a key is one task. Where a state change composes (the change
of two rows after one another is one of the same kind), `prefixes` composes the changes of blocks
instead: within spans of SPAN blocks first, then over the spans, so that only one row a span of a key meets in a
task and a key that holds a third of all rows is still spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = 512

State = object
#: (state or None at a key's first row, rows of that key) -> (state, new columns by name)
Step = Callable[[State, pa.RecordBatch], tuple[State, dict[str, pa.Array]]]
#: (state after the row before, rows, which of them open a key) -> (state, new columns in order)
Fold = Callable[[State, pa.RecordBatch, np.ndarray], tuple[State, list[pa.Array]]]


def _changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Rows whose key differs from that of the row before; null equals null."""
    n = len(batch)
    out = np.zeros(max(n - 1, 0), bool)
    for k in keys:
        column = batch.column(k)
        a, b = column.slice(1), column.slice(0, n - 1)
        out |= pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
    return np.flatnonzero(out) + 1


def schema_of(rows: DataFrame, **more: str) -> str:
    """The columns of rows and further ones, as a schema string."""
    return ", ".join(f"`{n}` {t}" for n, t in [*((f.name, f.dataType.simpleString()) for f in rows.schema), *more.items()])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Runs of rows with equal keys, and whether a run opens its key."""
    last = None
    for batch in batches:
        edges = [0, *_changes(batch, keys).tolist(), len(batch)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a < b:
                part = batch.slice(a, b - a)
                key = tuple(part.column(k)[0].as_py() for k in keys)
                yield part, key != last
                last = key


def _sorted(rows: DataFrame, keys: list[str], order: list[str], descending: bool = False) -> DataFrame:
    by = [F.col(o).desc() if descending else F.col(o) for o in order]
    return rows.repartition(*keys).sortWithinPartitions(*keys, *by)


def folded(rows: DataFrame, keys: list[str], order: list[str], step: Step, descending: bool = False, **out: str) -> DataFrame:
    """rows with the columns that step gives for them, in order within each key; out: names and types of the new ones."""
    names = [*rows.columns, *out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for part, opens in _runs(batches, keys):
            state, new = step(None if opens else state, part)
            columns = dict(zip(part.schema.names, part.columns, strict=True)) | new
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return _sorted(rows, keys, order, descending).mapInArrow(run, schema_of(rows, **out))


def laid(rows: DataFrame, keys: list[str], order: str, fold: Fold | None = None, before: dict[str, str] | None = None, after: dict[str, str] | None = None, **out: str) -> DataFrame:
    """rows that lie by key and in order within a task, as a row generator leaves those of a text, with new columns, neither shuffled nor sorted.

    before, after: names of new columns, and of those whose value in the row before or after they take (null at the ends of a
    key); out: names and types of what fold gives. A row opens a key where its keys differ or its order is not greater than in the row
    before, so texts that share their keys stay apart. Memory is that of three batches.
    """
    before, after = before or {}, after or {}
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [*rows.columns, *before, *after, *out]

    def opening(earlier: pa.RecordBatch | None, batch: pa.RecordBatch) -> np.ndarray:
        both = batch.select([*keys, order])
        both = pa.concat_batches([(both if earlier is None else earlier.select([*keys, order]).slice(len(earlier) - 1)).slice(0, 1), both])
        at = both.column(order)
        out = pc.fill_null(pc.less_equal(at.slice(1), at.slice(0, len(batch))), True).to_numpy(zero_copy_only=False)
        out = np.array(out, bool)
        out[_changes(both, keys) - 1] = True
        out[0] |= earlier is None
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, earlier, held, opens = None, None, None, None
        for batch in chain((b for b in batches if len(b)), [None]):
            following = None if batch is None else opening(held, batch)
            if held is not None:
                n = len(held)
                last = np.append(opens[1:], True if following is None else following[0])
                first = held if earlier is None else earlier.slice(len(earlier) - 1)
                new = [pa.concat_arrays([first.column(c).slice(0, 1), held.column(c)]).take(pa.array(np.arange(n), mask=opens)) for c in before.values()]
                new += [pa.concat_arrays([held.column(c), (held if batch is None else batch).column(c).slice(0, 1)]).take(pa.array(np.arange(1, n + 1), mask=last)) for c in after.values()]
                if fold:
                    state, more = fold(state, held, opens)
                    new += more
                yield pa.RecordBatch.from_arrays([*held.columns, *new], names)
                earlier = held
            held, opens = batch, following

    return rows.mapInArrow(run, schema_of(rows, **{n: kinds[c] for n, c in (before | after).items()}, **out))


def reduced(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[State, pa.RecordBatch], State], out: str, kind: str) -> DataFrame:
    """keys and `out`, the state that step leaves after all rows of a key in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held = None, []
        for part, opens in _runs(batches, keys):
            if opens and held:
                yield whole(held, state)
            state = step(None if opens else state, part)
            held = [part.column(k).slice(0, 1) for k in keys]
        if held:
            yield whole(held, state)

    def whole(held: list[pa.Array], state: State) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*held, pa.array([state])], [*keys, out])

    return _sorted(rows, keys, order).mapInArrow(run, schema_of(rows.select(*keys), **{out: kind}))


def meet(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a with the other columns of b where all keys agree, nulls included."""
    renamed = b.select([F.col(c).alias(f"_b_{c}" if c in keys else c) for c in b.columns])
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys))
    joined = a.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_b_{k}" for k in keys])


def _doubles(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    values = np.concatenate(rows).astype(np.float64, copy=False) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column without nulls, as views of one array."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy().tolist()
    return [values[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def prefixes(changes: DataFrame, keys: list[str], block: str, compose: Callable[[np.ndarray, np.ndarray], np.ndarray], identity: list[float], span: int = SPAN, descending: bool = False) -> DataFrame:
    """keys, block, before: the change (array of doubles) of all blocks of the key before each one.

    changes: keys, block (a whole number), change; compose(a, b) is b after a.
    """

    def exclusive(state: State, part: pa.RecordBatch) -> tuple[State, dict[str, pa.Array]]:
        now = np.array(identity, np.float64) if state is None else state
        before, after = [], []
        for change in _arrays(part.column("change")):
            before.append(now)
            now = compose(now, change)
            after.append(now)
        return now, {"before": _doubles(before), "after": _doubles(after)}

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(_arrays(batch.column("earlier")), _arrays(batch.column("before")), strict=True)
            total = _doubles([compose(a, b) for a, b in both])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*keys, block)), total], [*keys, block, "before"])

    out = {"before": "array<double>", "after": "array<double>"}
    rows = changes.select(*keys, block, "change").withColumn("_span", F.floor(F.col(block) / span))
    within = folded(rows, [*keys, "_span"], [block], exclusive, descending, **out)
    last = F.min_by("after", block) if descending else F.max_by("after", block)
    spans = within.groupBy(*keys, "_span").agg(last.alias("change"))
    over = folded(spans, keys, ["_span"], exclusive, descending, **out).select(*keys, "_span", F.col("before").alias("earlier"))
    joined = meet(within.select(*keys, "_span", block, "before"), over, [*keys, "_span"]).select(*keys, block, "earlier", "before")
    return joined.mapInArrow(combined, schema_of(joined.select(*keys, block), before="array<double>"))
