"""Exact removal of repeated substrings by prefix-free parsing.

Parse. A rolling hash over GRAM bytes sets triggers: every window of PASSAGE bytes has one, its
leftmost gram of least hash, which the window's bytes alone decide. Consecutive windows with one
trigger make a phrase: the text from the first window's start to LENGTH bytes past the last one's.
Phrases are counted by trigger; a trigger that occurs once ends the matter for its phrase, and
where all phrases of a trigger are equal, all their windows repeat. Only triggers with differing
phrases are looked at further, once for each distinct phrase.

Suffix order. The part of a phrase before its trigger is a suffix of the dictionary's words, the
part from the trigger on is a suffix of the parse. Per trigger both are sorted, the left parts read
backwards, with the common prefixes of neighbours; from these follow the classes of each part at
every depth. The pair of a window's two classes is its place in corpus order, so windows with equal
pairs are equal, for any length up to LENGTH: one order answers for strings of LENGTH bytes, which
are removed, and for passages of PASSAGE bytes that another document has too, which are reported.
Deeper than LENGTH no order is made.

A trigger with more than CROWD distinct phrases (the edges of a passage that very many texts share)
would not fit one task. Its windows are told apart by counts of hashes, which Spark deals out evenly:
first of cells of CELL neighbouring windows, then, where cells at one distance from a trigger
differ, of their windows.

Windows never cross documents. Phrases are known by the 64-bit hashes of their trigger and of their
bytes, texts by two 64-bit hashes; equal texts share their spans. To spare shuffles, texts that a
bit table of a fixed size excludes are finished where they lie.

Edge cases: null text is empty, empty texts and texts under PASSAGE bytes lose nothing; a null
doc_id is kept; repeated rows repeat each other's bytes and all go; an empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import bit_table, bounded, in_arrow, maybe, staged

LENGTH = 400
PASSAGE = 272
GRAM = 32
CROWD = 2048
CELL = 16


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values: block-wise prefix and suffix minima."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def triggers(h: np.ndarray, size: int, length: int, gram: int) -> np.ndarray:
    """For every window of `length` bytes its trigger: the leftmost gram of least hash within it."""
    starts = np.arange(size - gram + 1)
    places = tk.U((1 << 31) - 1)  # a column of texts holds less than 2^31 bytes
    value = (tk.span_hash(h, starts, starts + gram) & ~places) | starts.astype(np.uint64)
    return (sliding_min(value, length - gram + 1) & places).astype(np.int64)


def phrases(data: np.ndarray, offsets: np.ndarray, length: int, passage: int, gram: int) -> tuple[np.ndarray, ...]:
    """Phrases of the rows: row, start, bytes, windows of `passage` bytes, distance of the trigger, hashes of trigger and phrase."""
    none = (np.zeros(0, np.int64),) * 5 + (np.zeros(0, np.uint64),) * 2
    if len(data) < passage:
        return none
    h = tk.prefix_hash(data)
    trigger = triggers(h, len(data), passage, gram)
    starts = np.arange(len(trigger))
    row = np.searchsorted(offsets, starts, side="right") - 1
    inside = starts + passage <= offsets[row + 1]
    starts, row, trigger = starts[inside], row[inside], trigger[inside]
    if not len(starts):
        return none
    new = np.concatenate(([True], (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(starts)])) - 1
    s0, s1, at, row = starts[first], starts[last], trigger[first], row[first]
    end = np.minimum(s1 + length, offsets[row + 1])
    return row, s0 - offsets[row], end - s0, s1 - s0 + 1, at - s0, tk.span_hash(h, at, at + gram), tk.span_hash(h, s0, end)


def classes(parts: np.ndarray, sizes: np.ndarray, depths: int) -> np.ndarray:
    """For each row and depth 0..depths the number of its prefix of that depth among all rows' prefixes."""
    m, width = parts.shape
    order = np.argsort(sizes, kind="stable")
    order = order[np.argsort(np.ascontiguousarray(parts[order]).view(f"S{width}").ravel(), kind="stable")]
    near = parts[order[1:]] != parts[order[:-1]]
    common = np.where(near.any(axis=1), near.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(sizes[order[1:]], sizes[order[:-1]]))
    out = np.zeros((m, depths + 1), np.int64)
    out[order[1:]] = np.cumsum(common[:, None] < np.arange(depths + 1)[None, :], axis=0)
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    unlike = a[:n] != b[:n]
    return int(unlike.argmax()) if unlike.any() else n


def repeated_windows(contents: list[bytes], before: np.ndarray, count: np.ndarray, texts: np.ndarray, shared: np.ndarray, length: int, passage: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of distinct phrases with one trigger, `before` bytes into each, two kinds of window starts.

    First those of windows of `length` bytes that two phrases hold; then those of windows of
    `passage` bytes that another text holds too: phrases come from different `texts`, or one of them
    is `shared` between texts.
    """
    m = len(contents)
    data = [np.frombuffer(c, np.uint8) for c in contents]
    sizes = np.array([len(c) for c in contents])
    if m == 2:
        # The sorted order of two parts is their common prefix.
        x, y = data
        left = _common(x[: before[0]][::-1], y[: before[1]][::-1])
        right = _common(x[before[0] :], y[before[1] :])
        across = texts[0] != texts[1] or shared.any()
        out = []
        for i in (0, 1):
            kinds = []
            for size, wanted in ((length, True), (passage, across)):
                low, high = before[i] - min(left, before[i]), min(before[i] + right - size, count[i] - 1)
                kinds.append(np.arange(low, high + 1) if wanted and high >= low else np.zeros(0, np.int64))
            out.append((kinds[0], kinds[1]))
        return out
    left = np.zeros((m, int(before.max()) or 1), np.uint8)
    right = np.zeros((m, int((sizes - before).max())), np.uint8)
    for i, c in enumerate(data):
        left[i, : before[i]] = c[: before[i]][::-1]
        right[i, : len(c) - before[i]] = c[before[i] :]
    deepest = int(before.max())
    lefts, rights = classes(left, before, deepest), classes(right, sizes - before, length)
    r = np.arange(deepest + 1)  # the distance from a window's start to its trigger
    start = before[:, None] - r[None, :]
    found = []
    for size, other_text in ((length, False), (passage, True)):
        valid = (start >= 0) & (start < count[:, None]) & (start + size <= sizes[:, None])
        key = np.where(valid, lefts[:, r] * m + rights[:, size - r], -1 - np.arange(m)[:, None])
        order = np.argsort(key, axis=0, kind="stable")
        ranked = np.take_along_axis(key, order, axis=0)
        equal = ranked[1:] == ranked[:-1]
        if other_text:
            # A class counts where neighbours in it differ in text or one is shared.
            place = np.vstack((np.zeros(deepest + 1, np.int64), np.cumsum(~equal, axis=0))) * (deepest + 1) + r
            across = equal & ((texts[order[1:]] != texts[order[:-1]]) | shared[order[1:]] | shared[order[:-1]])
            twice = (np.bincount(place[1:][across], minlength=m * (deepest + 1)) > 0)[place]
        else:
            twice = np.zeros((m, deepest + 1), bool)
            twice[1:] |= equal
            twice[:-1] |= equal
        hit = np.zeros_like(twice)
        np.put_along_axis(hit, order, twice, axis=0)
        found.append(hit & valid)
    return [(np.sort(start[i, found[0][i]]), np.sort(start[i, found[1][i]])) for i in range(m)]


def ranges(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Union of [s, s + length) over sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate(([0], cut + 1))].tolist(), (starts[np.concatenate((cut, [len(starts) - 1]))] + length).tolist(), strict=True))


SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("after", pa.int32())]))
SPAN_SQL = "array<struct<kind:int,start:int,after:int>>"


def _spans(starts: dict[int, np.ndarray]) -> list[dict[str, int]]:
    """Ranges covered by windows; the size of the windows is their kind."""
    return [{"kind": size, "start": a, "after": b} for size, s in starts.items() for a, b in ranges(s, size)]


def _grouped(batches: Iterator[pa.RecordBatch], length: int, passage: int) -> Iterator[pa.RecordBatch]:
    """Repeated ranges of the distinct phrases of each trigger; rows come sorted by trigger."""
    held: list[tuple] = []
    out: list[tuple] = []

    def close() -> None:
        if len(held) > 1:
            before, count, texts = (np.array([h[i] for h in held], np.int64) for i in (3, 4, 5))
            shared = np.array([h[2] for h in held], bool)
            for h, (removed, passages) in zip(held, repeated_windows([h[6] for h in held], before, count, texts, shared, length, passage), strict=True):
                if len(removed) or len(passages):
                    out.append((h[0], h[1], _spans({passage: passages, length: removed})))
        held.clear()

    def batch_of() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), SPAN))], ["trigger", "phrase", "spans"])
        out.clear()
        return made

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("trigger", "phrase", "shared", "before", "windows", "text_hash", "content")), strict=True):
            if held and held[0][0] != row[0]:
                close()
            held.append(row)
        yield batch_of()
    close()
    yield batch_of()


def _joined(contents: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(c.as_buffer(), np.uint8) for c in contents]
    return tk.prefix_hash(np.concatenate(parts)), np.concatenate(([0], np.cumsum([len(c) for c in parts])))


def _cells(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Every cell of crowded phrases: windows of a size at distances [CELL * cell, CELL * cell + CELL) before the trigger."""
    for batch in batches:
        for low in range(0, len(batch), 512):
            part = batch.slice(low, 512)
            h, base = _joined(part.column("content"))
            before, windows = (part.column(c).to_numpy().astype(np.int64) for c in ("before", "windows"))
            for size in sizes:
                count = np.minimum(windows, np.diff(base) - size + 1)
                least, most = (before - count + 1) // CELL, before // CELL
                n = np.where(count > 0, most - least + 1, 0)
                row = np.repeat(np.arange(len(n)), n)
                cell = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + least[row]
                first = before[row] - np.minimum(cell * CELL + CELL - 1, before[row])
                last = np.minimum(before[row] - cell * CELL, count[row] - 1)
                hashes = tk.span_hash(h, base[row] + first, base[row] + last + size)
                own = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(own) for c in ("trigger", "phrase", "text_hash", "many", "shared")), *(pa.array(x.astype(np.int32)) for x in (np.full(len(row), size), cell, first, last)), tk.longs(hashes)],
                    ["trigger", "phrase", "text_hash", "many", "shared", "kind", "cell", "first", "last", "bytes"],
                )


CELL_SQL = "trigger long, phrase long, text_hash long, many boolean, shared boolean, kind int, cell int, first int, last int, bytes long"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the cells asked for."""
    for batch in batches:
        for low in range(0, len(batch), 512):
            part = batch.slice(low, 512)
            h, base = _joined(part.column("content"))
            asked = [(i, c["kind"], c["first"], c["last"], c["known"]) for i, cells in enumerate(part.column("cells").to_pylist()) for c in cells]
            row, size, first, last, known = (np.array(x) for x in zip(*asked, strict=True))
            n = last - first + 1
            at = np.repeat(np.arange(len(n)), n)
            start = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + first[at]
            own = pa.array(row[at])
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c).take(own) for c in ("trigger", "phrase", "text_hash")),
                    pa.array(known[at]),
                    *(pa.array(x.astype(np.int32)) for x in (size[at], start)),
                    tk.longs(tk.span_hash(h, base[row[at]] + start, base[row[at]] + start + size[at])),
                ],
                ["trigger", "phrase", "text_hash", "known", "kind", "start", "bytes"],
            )


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of each crowded phrase from the first and last starts of its repeated windows."""
    for batch in batches:
        spans = []
        for row in batch.column("starts").to_pylist():
            by_kind: dict[int, list[np.ndarray]] = {}
            for s in row:
                by_kind.setdefault(s["kind"], []).append(np.arange(s["first"], s["last"] + 1))
            spans.append(_spans({kind: np.unique(np.concatenate(x)) for kind, x in by_kind.items()}))
        yield pa.RecordBatch.from_arrays([batch.column("trigger"), batch.column("phrase"), pa.array(spans, SPAN)], ["trigger", "phrase", "spans"])


def _crowded(crowd: DataFrame, length: int, passage: int) -> DataFrame:
    """trigger, phrase, spans of the crowded phrases, by counts of cells and, where cells differ, of windows."""

    def counts(kind: str) -> list:
        # A window of `length` bytes counts where two phrases hold it, one of `passage` bytes where two texts do.
        return [
            F.expr(f"CASE WHEN {kind} THEN max(many) OR min(phrase) <> max(phrase) ELSE max(shared) OR min(text_hash) <> max(text_hash) END").alias("known"),
            F.min("phrase").alias("low"),
            F.max("phrase").alias("high"),
        ]

    cells = staged(crowd.transform(in_arrow, lambda batches: _cells(batches, (length, passage)), CELL_SQL), "cells")
    kinds = staged(cells.groupBy("trigger", "kind", "cell", "bytes").agg(*counts(f"kind = {length}")), "kinds")
    unlike = staged(kinds.groupBy("trigger", "kind", "cell").count().where("count > 1").select("trigger", "kind", "cell"), "unlike")
    known = cells.join(kinds, ["trigger", "kind", "cell", "bytes"])
    whole = known.where("known").select("trigger", "phrase", F.struct("kind", "first", "last").alias("s"))
    # Windows of cells that are known count as known for their equals in other cells.
    asked = known.join(unlike, ["trigger", "kind", "cell"]).groupBy("trigger", "phrase").agg(F.collect_list(F.struct("kind", "first", "last", "known")).alias("cells"))
    windows = staged(
        crowd.select("trigger", "phrase", "text_hash", "content").join(asked, ["trigger", "phrase"]).transform(in_arrow, _windows, "trigger long, phrase long, text_hash long, known boolean, kind int, start int, bytes long"),
        "windows",
    )
    twice = (
        windows.groupBy("trigger", "kind", "bytes")
        .agg(F.max("known").alias("known"), F.expr(f"CASE WHEN max(kind) = {length} THEN min(phrase) <> max(phrase) ELSE min(text_hash) <> max(text_hash) END").alias("two"))
        .where("known or two")
        .select("trigger", "kind", "bytes")
    )
    single = windows.where("not known").join(twice, ["trigger", "kind", "bytes"], "left_semi").select("trigger", "phrase", F.struct("kind", F.col("start").alias("first"), F.col("start").alias("last")).alias("s"))
    return (
        whole.union(single)
        .groupBy("trigger", "phrase")
        .agg(F.collect_list("s").alias("starts"))
        .transform(in_arrow, _gathered, f"trigger long, phrase long, spans {SPAN_SQL}")
    )


def duplicate_spans(docs: DataFrame, length: int, passage: int, gram: int) -> DataFrame:
    """text_hash, text_check, kind, start, after: ranges of repeated windows, possibly overlapping.

    Of kind `length` are windows that start anywhere else, of kind `passage` those in another document.
    """
    spark = docs.sparkSession

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in tk.chunks(batch.column(2)):
                row, *places, trigger, phrase = phrases(data, offsets, length, passage, gram)
                own = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(own), batch.column(1).take(own), *(pa.array(x.astype(np.int32)) for x in places), tk.longs(trigger), tk.longs(phrase)],
                    ["text_hash", "text_check", "first", "bytes", "windows", "before", "trigger", "phrase"],
                )

    texts = docs.where(F.octet_length("text") >= passage).select("text_hash", "text_check", "text")
    parsed = staged(texts.transform(in_arrow, parse, "text_hash long, text_check long, first int, bytes int, windows int, before int, trigger long, phrase long"), "phrases")
    triggers_of = staged(
        parsed.groupBy("trigger")
        .agg(F.count(F.lit(1)).alias("n"), F.min("phrase").alias("low"), F.max("phrase").alias("high"), F.min("text_hash").alias("first_text"), F.max("text_hash").alias("last_text"))
        .where("n > 1")
        .select("trigger", F.expr("low = high").alias("equal"), F.expr("first_text <> last_text").alias("across")),
        "triggers",
    )
    repeating = staged(parsed.join(triggers_of, "trigger"), "repeating")

    def spans_of(df: DataFrame, first: str, removed: str, passages: str) -> DataFrame:
        """Whole phrases: one span of each kind that applies."""
        spans = F.filter(
            F.array(
                F.when(F.expr(f"{removed} and bytes >= {length}"), F.expr(f"named_struct('kind', {length}, 'start', {first}, 'after', {first} + bytes)")),
                F.when(F.expr(passages), F.expr(f"named_struct('kind', {passage}, 'start', {first}, 'after', {first} + windows + {passage - 1})")),
            ),
            lambda s: s.isNotNull(),
        )
        return df.withColumn("spans", spans)

    whole = spans_of(repeating.where("equal"), "first", "true", "across").select("text_hash", "text_check", F.explode("spans").alias("s")).select("text_hash", "text_check", "s.*")
    unequal = repeating.where("not equal")
    # A distinct phrase is read from the text with the least hash that holds it.
    one = F.struct("text_hash", "text_check", "first")
    distinct = staged(
        unequal.groupBy("trigger", "phrase")
        .agg(
            (F.count(F.lit(1)) > 1).alias("many"),
            (F.min("text_hash") != F.max("text_hash")).alias("shared"),
            F.min(one).alias("one"),
            F.max("bytes").alias("bytes"),
            F.max("windows").alias("windows"),
            F.max("before").alias("before"),
        )
        .select("trigger", "phrase", "many", "shared", "bytes", "windows", "before", "one.*"),
        "distinct",
    )
    crowds = staged(distinct.groupBy("trigger").count().where(f"count > {CROWD}").select("trigger", F.lit(True).alias("crowd")), "crowds")
    sent = spark.sparkContext.broadcast(bit_table(distinct, "text_hash"))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(maybe(sent.value, batch.column(0).to_numpy())))

    names = ["trigger", "phrase", "text_hash", "many", "shared", "before", "windows", "crowd", "content"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for hashed, text, cuts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                for x in cuts:
                    rows.append((x["trigger"], x["phrase"], hashed, x["many"], x["shared"], x["before"], x["windows"], x["crowd"], data[x["first"] : x["first"] + x["bytes"]]))
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    cuts = staged(
        distinct.join(crowds, "trigger", "left")
        .groupBy("text_hash", "text_check")
        .agg(F.collect_list(F.struct("trigger", "phrase", "many", "shared", "before", "windows", "first", "bytes", F.coalesce("crowd", F.lit(False)).alias("crowd"))).alias("cuts")),
        "cuts",
    )
    contents = staged(
        texts.transform(in_arrow, wanted, "text_hash long, text_check long, text string")
        .join(cuts, ["text_hash", "text_check"])
        .dropDuplicates(["text_hash", "text_check"])
        .select("text_hash", "text", "cuts")
        .transform(in_arrow, cut, "trigger long, phrase long, text_hash long, many boolean, shared boolean, before int, windows int, crowd boolean, content binary"),
        "contents",
    )
    found = (
        contents.where("not crowd")
        .repartition("trigger")
        .sortWithinPartitions("trigger", "phrase")
        .transform(in_arrow, lambda batches: _grouped(batches, length, passage), f"trigger long, phrase long, spans {SPAN_SQL}")
    )
    if crowds.limit(1).count():
        found = found.union(_crowded(contents.where("crowd").drop("crowd"), length, passage))
    many = spans_of(distinct.where("many"), "0", "true", "shared").select("trigger", "phrase", "spans")
    part = (
        unequal.select("trigger", "phrase", "text_hash", "text_check", "first")
        .join(staged(found.union(many), "found"), ["trigger", "phrase"])
        .select("text_hash", "text_check", "first", F.explode("spans").alias("s"))
        .select("text_hash", "text_check", "s.kind", (F.col("first") + F.col("s.start")).alias("start"), (F.col("first") + F.col("s.after")).alias("after"))
    )
    # A text that two rows hold is a passage as a whole.
    copies = texts.groupBy("text_hash", "text_check").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("after")).where("n > 1")
    return whole.union(part).union(copies.select("text_hash", "text_check", F.lit(passage).alias("kind"), F.lit(0).alias("start"), "after"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared and kept (null where nothing went) of every row.

    n_shared counts the bytes in passages of `passage` bytes or more that another document has too.
    """
    passage = min(passage, length)
    hashed = [F.xxhash64("text").alias("text_hash"), F.xxhash64(F.lit(1), "text").alias("text_check")]
    rows = bounded(docs).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", *hashed, F.octet_length("text").alias("size"), "text")
    spans = staged(
        duplicate_spans(rows, length, passage, gram).distinct().groupBy("text_hash", "text_check").agg(F.collect_list(F.struct("kind", "start", "after")).alias("spans")),
        "spans",
    )
    sent = rows.sparkSession.sparkContext.broadcast(bit_table(spans.where(F.exists("spans", lambda s: s["kind"] == length)), "text_hash"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that keep all their bytes are digested here and not carried along."""
        for batch in batches:
            open_ = maybe(sent.value, batch.column(1).to_numpy())
            digests = [None if m else hashlib.sha256(t.as_buffer()).hexdigest() for m, t in zip(open_, batch.column(4), strict=True)]
            text = pc.if_else(pa.array(open_), batch.column(4), pa.scalar(None, batch.column(4).type))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], text, pa.array(digests, pa.string())], ["doc_id", "text_hash", "text_check", "size", "text", "digest"])

    def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, size, text, digest, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                gone, passages = ([] if not spans else covered([(s["start"], s["after"]) for s in spans if s["kind"] == k]) for k in (length, passage))
                if passage == length:
                    passages = gone
                shared = sum(b - a for a, b in passages)
                if digest is not None:
                    out.append((doc, size, 0, 0, digest, shared, None))
                    continue
                data, kept, at = memoryview(text.as_buffer()), [], 0
                for a, b in gone:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                out.append((doc, size, size - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), shared, rest if gone else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", "kept"])

    return (
        rows.transform(in_arrow, marked, "doc_id long, text_hash long, text_check long, size int, text string, digest string")
        .join(spans, ["text_hash", "text_check"], "left")
        .select("doc_id", "size", "text", "digest", "spans")
        .transform(in_arrow, removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long, kept binary")
    )
