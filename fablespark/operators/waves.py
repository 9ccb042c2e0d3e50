"""Long signals as rows of blocks: filters, dynamics and noise that never hold a whole signal.

A signal is the rows of one key: (keys, block, samples), blocks numbered in order, of any length and with any gaps in the numbers.
Linear filters are scans of state changes: a block changes the two state variables of a second-order section
by s -> A^n s + v, two blocks compose to one such change, and what a block starts with is the change of all before
it. The compressor's envelope does not compose, so it is folded along the sorted blocks of a key.

Edge cases: null and empty blocks hold no samples and come back as they are; null samples count as silence; a signal of at most PAD samples
passes zero_phase unchanged; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.staging import staged
from . import scans

RATE = 24000
PAD = 9  # samples mirrored at either end of a signal before it is filtered both ways
STEP = 128
Section = tuple[float, float, float, float, float]  # b0, b1, b2, a1, a2


def peak_section(rate: float, center: float, gain_db: float, q: float = 1.0) -> Section:
    """A bell at `center`."""
    a, w = 10 ** (gain_db / 40), 2 * math.pi * center / rate
    alpha = math.sin(w) / (2 * q)
    over = 1 + alpha / a
    return (1 + alpha * a) / over, -2 * math.cos(w) / over, (1 - alpha * a) / over, -2 * math.cos(w) / over, (1 - alpha / a) / over


def high_shelf_section(rate: float, cutoff: float, gain_db: float) -> Section:
    """A shelf above `cutoff`, of slope 1."""
    a, w = 10 ** (gain_db / 40), 2 * math.pi * cutoff / rate
    c, slope = math.cos(w), math.sqrt(2 * a) * math.sin(w)
    over = (a + 1) - (a - 1) * c + slope
    return (
        a * ((a + 1) + (a - 1) * c + slope) / over,
        -2 * a * ((a - 1) + (a + 1) * c) / over,
        a * ((a + 1) + (a - 1) * c - slope) / over,
        2 * ((a - 1) - (a + 1) * c) / over,
        ((a + 1) - (a - 1) * c - slope) / over,
    )


def high_pass_section(rate: float, cutoff: float) -> Section:
    """Second-order Butterworth."""
    k = math.tan(math.pi * cutoff / rate)
    over = 1 + math.sqrt(2) * k + k * k
    return 1 / over, -2 / over, 1 / over, 2 * (k * k - 1) / over, (1 - math.sqrt(2) * k + k * k) / over


class _Filter:
    """The matrices that take STEP samples of a section at once."""

    def __init__(self, section: Section):
        b0, b1, b2, a1, a2 = section
        self.a = np.array([[-a1, 1.0], [-a2, 0.0]])
        self.b = np.array([b1 - a1 * b0, b2 - a2 * b0])
        powers = [np.eye(2)]
        for _ in range(STEP):
            powers.append(self.a @ powers[-1])
        self.powers, self.known = powers, {}
        response = np.array([b0, *(powers[i][0] @ self.b for i in range(STEP - 1))])
        lag = np.arange(STEP)[:, None] - np.arange(STEP)[None, :]
        self.response = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
        self.carry = np.array([p[0] for p in powers[:STEP]])  # what a state adds to each output
        self.leave = np.array([powers[STEP - 1 - i] @ self.b for i in range(STEP)])  # what each sample adds to the state left

    def power(self, n: int) -> np.ndarray:
        """a^n, kept for the lengths of blocks, which are few."""
        found = self.known.get(n)
        if found is None:
            found = self.powers[n] if n <= STEP else np.linalg.matrix_power(self.a, n)
            if len(self.known) < 1 << 16:
                self.known[n] = found
        return found

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs and the state left, from a starting state."""
        if len(x) < STEP:
            m = len(x)
            return self.response[:m, :m] @ x + self.carry[:m] @ state, self.powers[m] @ state + x @ self.leave[STEP - m :]
        whole = len(x) // STEP * STEP
        rows = x[:whole].reshape(-1, STEP)
        left, states = rows @ self.leave, np.zeros((len(rows), 2))
        for i in range(len(rows)):
            states[i] = state
            state = self.powers[STEP] @ state + left[i]
        out = np.empty(len(x))
        out[:whole] = (rows @ self.response.T + states @ self.carry.T).ravel()
        rest = x[whole:]
        m = len(rest)
        out[whole:] = self.response[:m, :m] @ rest + self.carry[:m] @ state
        return out, self.powers[m] @ state + rest @ self.leave[STEP - m :]


@lru_cache(16)
def _filter(section: Section) -> _Filter:
    return _Filter(section)


def _resting(section: Section) -> np.ndarray:
    """The state that a constant input of 1 keeps."""
    f = _filter(section)
    return np.linalg.solve(np.eye(2) - f.a, f.b)


def arrays(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The rows of a list column as views of one array; null samples are 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, offsets = np.nan_to_num(column.values.to_numpy(zero_copy_only=False), nan=0.0) if column.values.null_count else column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b, valid in zip(offsets[:-1].tolist(), offsets[1:].tolist(), column.is_valid().to_pylist(), strict=True):
        yield values[a:b] if valid else None


def lists(rows: list[np.ndarray | None]) -> pa.Array:
    """A list column of arrays, made without Python numbers."""
    sizes = [0 if r is None else len(r) for r in rows]
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=np.array([r is None for r in rows] + [False]))
    values = np.concatenate([r for r in rows if r is not None]) if any(sizes) else np.zeros(0)
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.float64()))


def _filtered(blocks: DataFrame, keys: list[str], section: Section, descending: bool, starts: DataFrame) -> DataFrame:
    """blocks with filtered samples, from the last to the first if descending; starts: keys, at_rest (the level whose
    resting state each key begins with)."""
    named = blocks.select(*keys, "block")

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _filter(section)
        for batch in batches:
            out = []
            for x in arrays(batch.column("samples")):
                x = np.zeros(0) if x is None else x
                out.append(np.array([len(x), *f.run(x[::-1] if descending else x, np.zeros(2))[1]]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*keys, "block")), lists(out)], [*keys, "block", "change"])

    def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate(([a[0] + b[0]], _filter(section).power(int(b[0])) @ a[1:] + b[1:]))

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, rest = _filter(section), _resting(section)
        for batch in batches:
            out = []
            for x, before, level in zip(arrays(batch.column("samples")), arrays(batch.column("before")), batch.column("at_rest").to_pylist(), strict=True):
                if x is None:
                    out.append(None)
                    continue
                state = f.power(int(before[0])) @ (rest * (level or 0.0)) + before[1:]
                y, _ = f.run(x[::-1] if descending else x, state)
                out.append(y[::-1] if descending else y)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*keys, "block")), lists(out)], [*keys, "block", "samples"])

    before = scans.prefixes(blocks.mapInArrow(changes, scans.schema_of(named, change="array<double>")), keys, "block", compose, [0.0, 0.0, 0.0], descending=descending)
    rows = scans.meet(scans.meet(blocks, before, [*keys, "block"]), starts, keys)
    return rows.mapInArrow(replay, scans.schema_of(named, samples="array<double>"))


def filtered(blocks: DataFrame, keys: list[str], section: Section) -> DataFrame:
    """keys, block, samples of each signal through one section, from silence."""
    rows = staged(blocks.select(*keys, "block", F.col("samples").cast("array<double>").alias("samples")), "waves")
    return _filtered(rows, keys, section, False, rows.groupBy(*keys).agg(F.lit(0.0).alias("at_rest")))


def _ends(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys, first and last block, and the first and last n samples of each signal; only its outermost n blocks are sorted."""
    w = Window.partitionBy(*keys)
    full = rows.where(F.size("samples") > 0)
    head = full.withColumn("_n", F.row_number().over(w.orderBy("block"))).where(F.col("_n") <= n).select(*keys, "block", F.slice("samples", 1, n).alias("x"))
    tail = full.withColumn("_n", F.row_number().over(w.orderBy(F.desc("block")))).where(F.col("_n") <= n)
    tail = tail.select(*keys, "block", F.slice("samples", F.greatest(F.size("samples") - n + 1, F.lit(1)), F.lit(n)).alias("x"))

    def laid(part: DataFrame, name: str, block: str, edge) -> DataFrame:
        ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "x"))), lambda z: z["x"]))
        return part.groupBy(*keys).agg(ordered.alias(name), edge("block").alias(block))

    both = scans.meet(laid(head, "head", "first_block", F.min), laid(tail, "tail", "last_block", F.max), keys)
    tail_n = F.slice("tail", F.greatest(F.size("tail") - n + 1, F.lit(1)), F.lit(n))
    return both.select(*keys, "first_block", "last_block", F.slice("head", 1, n).alias("head"), tail_n.alias("tail"))


def zero_phase(blocks: DataFrame, keys: list[str], section: Section) -> DataFrame:
    """keys, block, samples of each signal filtered forth and back, which shifts no frequency.

    Both ends are extended by PAD samples mirrored through the end, and each direction begins in
    the resting state of its first sample.
    """
    rows = staged(blocks.select(*keys, "block", F.col("samples").cast("array<double>").alias("samples")).withColumn("samples", F.transform("samples", lambda x: F.coalesce(x, F.lit(0.0)))), "waves")
    ends = staged(_ends(rows, keys, PAD + 1).withColumn("long", F.size("head") > PAD), "wave-ends")
    left = F.transform(F.reverse(F.slice("head", 2, PAD)), lambda x: 2 * F.element_at("head", 1) - x)
    right = F.transform(F.reverse(F.slice("tail", 1, PAD)), lambda x: 2 * F.element_at("tail", -1) - x)
    none = F.array().cast("array<double>")
    edged = scans.meet(rows, ends.where("long"), keys)
    extended = edged.select(
        *keys,
        "block",
        F.concat(F.when(F.col("block") == F.col("first_block"), left).otherwise(none), "samples", F.when(F.col("block") == F.col("last_block"), right).otherwise(none)).alias("samples"),
    )
    extended = staged(extended, "wave-extended")
    starts = ends.where("long").select(*keys, (2 * F.element_at("head", 1) - F.element_at("head", PAD + 1)).alias("at_rest"))
    forth = staged(_filtered(extended, keys, section, False, starts), "wave-forth")
    last = scans.meet(forth, ends.select(*keys, "last_block"), keys).where("block = last_block").select(*keys, F.element_at("samples", -1).alias("at_rest"))
    back = scans.meet(_filtered(forth, keys, section, True, last), ends.select(*keys, "first_block", "last_block"), keys)
    before, after = (F.when(F.col("block") == F.col(c), PAD).otherwise(0) for c in ("first_block", "last_block"))
    done = back.select(*keys, "block", F.slice("samples", before + 1, F.size("samples") - before - after).alias("samples"))
    kept = scans.meet(rows, ends.select(*keys, "long"), keys, "left").where(~F.coalesce("long", F.lit(False)) | F.col("samples").isNull())
    return done.unionByName(kept.select(*keys, "block", "samples"))


def peak_eq(blocks: DataFrame, keys: list[str], rate: float, center: float, gain_db: float, q: float = 1.0) -> DataFrame:
    """A bell of gain_db at `center`; gains under a tenth of a decibel change nothing."""
    return blocks.select(*keys, "block", "samples") if abs(gain_db) < 0.1 else zero_phase(blocks, keys, peak_section(rate, center, gain_db, q))


def high_shelf(blocks: DataFrame, keys: list[str], rate: float, cutoff: float, gain_db: float) -> DataFrame:
    """A shelf of gain_db above `cutoff`; gains under a tenth of a decibel change nothing."""
    return blocks.select(*keys, "block", "samples") if abs(gain_db) < 0.1 else zero_phase(blocks, keys, high_shelf_section(rate, cutoff, gain_db))


def voice_eq(blocks: DataFrame, keys: list[str], rate: float = RATE, low: float = 80.0, presence: float = 3000.0, presence_db: float = 2.0, air: float = 10000.0, air_db: float = 1.0) -> DataFrame:
    """Rumble below `low` removed, presence and air lifted."""
    out = zero_phase(blocks, keys, high_pass_section(rate, low)) if low < rate / 2 else blocks
    return high_shelf(peak_eq(out, keys, rate, presence, presence_db, 1.5), keys, rate, air, air_db)


def compressed(blocks: DataFrame, keys: list[str], rate: float = RATE, threshold_db: float = -18.0, ratio: float = 3.0, attack_ms: float = 10.0, release_ms: float = 100.0) -> DataFrame:
    """keys, block, samples with what lies above the threshold reduced by `ratio`.

    An envelope follows the level, fast up (attack) and slowly down (release). Each step depends on
    whether the level exceeds the envelope so far, so blocks are folded in order, one key in one task, with
    one number of state and one batch of blocks in memory.
    """
    threshold = 10 ** (threshold_db / 20)
    rises, falls = (math.exp(-1.0 / n) if (n := int(ms * rate / 1000)) > 0 else 0.0 for ms in (attack_ms, release_ms))

    def step(state: scans.State, part: pa.RecordBatch) -> tuple[scans.State, dict[str, pa.Array]]:
        e, out = 0.0 if state is None else state, []
        for x in arrays(part.column("samples")):
            if x is None:
                out.append(None)
                continue
            follow = []
            for level in np.abs(x).tolist():
                c = rises if level > e else falls
                e = c * e + (1 - c) * level
                follow.append(e)
            envelope = np.array(follow)
            loud = envelope > threshold
            gain = np.where(loud, (threshold + (envelope - threshold) / ratio) / np.where(loud, envelope, 1.0), 1.0)
            out.append(x * gain)
        return e, {"samples": lists(out)}

    rows = blocks.select(*keys, "block", F.col("samples").cast("array<double>").alias("samples"))
    return scans.folded(rows, keys, ["block"], step)


OCTAVES = 12


def noise_draw(key: Column, octave: Column | int, index: Column) -> Column:
    """A number in [-1, 1) that depends on key, octave and index alone: the first 32 bits of their digest."""
    octave = F.lit(octave) if isinstance(octave, int) else octave
    digest = F.md5(F.concat_ws(":", key.cast("string"), octave.cast("string"), index.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2**31 - 1


def white_noise(key: Column, start: Column, n: Column, level: float = 1.0) -> Column:
    """Samples start .. start + n - 1 of a key's white noise, evenly spread over [-level, level)."""
    return F.when(n > 0, F.transform(F.sequence(start, start + n - 1), lambda i: noise_draw(key, -1, i) * level)).otherwise(F.array().cast("array<double>"))


def pink_noise(key: Column, start: Column, n: Column, octaves: int = OCTAVES, level: float = 1.0) -> Column:
    """Samples start .. start + n - 1 of a key's pink noise, with a root mean square of level / sqrt(3).

    Sample i is the sum of one draw an octave, octave k drawing anew every 2^k samples, so any block can be made
    alone and blocks fit each other. Power falls by 3 dB an octave from half the rate down to
    rate / 2^octaves, each octave within 1 dB of that line.
    """

    def octave(k: int) -> Column:
        """The few draws of an octave that the block needs, made once each and held for 2^k samples."""
        first = F.floor(start / (1 << k)).cast("long")
        draws = F.transform(F.sequence(first, F.floor((start + n - 1) / (1 << k)).cast("long")), lambda j: noise_draw(key, k, j))
        return let(draws, lambda d: F.transform(F.sequence(start, start + n - 1), lambda i: F.get(d, (F.floor(i / (1 << k)) - first).cast("int"))))

    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), map(octave, range(octaves)))
    return F.when(n > 0, F.transform(total, lambda x: x * (level / math.sqrt(octaves)))).otherwise(F.array().cast("array<double>"))


def reblocked(blocks: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The same signals in blocks of `size` samples, numbered from 0; the last of a signal may be shorter. Empty signals vanish."""
    full = blocks.select(*keys, "block", F.col("samples").cast("array<double>").alias("samples")).where(F.size("samples") > 0).withColumn("_n", F.size("samples").cast("long"))
    # Where a block starts: the samples of all blocks before it, in spans that keep any key's sort small.
    starts = _offsets(full.select(*keys, "block", "_n"), keys)
    placed = scans.meet(full, starts, [*keys, "block"])
    first, last = F.floor(F.col("_start") / size), F.floor((F.col("_start") + F.col("_n") - 1) / size)
    pieces = placed.withColumn("_to", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("_to") * size - F.col("_start"), F.lit(0))
    high = F.least((F.col("_to") + 1) * size - F.col("_start"), F.col("_n"))
    pieces = pieces.select(*keys, "_to", (F.col("_start") + low).alias("_at"), F.slice("samples", (low + 1).cast("int"), (high - low).cast("int")).alias("_x"))
    whole = pieces.groupBy(*keys, "_to").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda z: z["_x"])).alias("samples"))
    return whole.withColumnRenamed("_to", "block")


def _offsets(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block, _start: samples before each block."""
    spans = sizes.withColumn("_span", F.floor(F.col("block") / scans.SPAN))
    before = lambda *by: Window.partitionBy(*keys, *by)
    earlier = before().orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    sums = spans.groupBy(*keys, "_span").agg(F.sum("_n").alias("_sum")).select(*keys, "_span", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    own = before("_span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return scans.meet(spans, sums, [*keys, "_span"]).select(*keys, "block", (F.col("_base") + F.coalesce(F.sum("_n").over(own), F.lit(0))).alias("_start"))


def _fade(n: int, rising: bool) -> np.ndarray:
    curve = (1 - np.cos(np.linspace(0, 1, n) * math.pi)) / 2
    return curve if rising else 1 - curve


def softened_silences(blocks: DataFrame, keys: list[str], rate: float = RATE, threshold: float = 0.01, fade: float = 0.01, size: int = 1 << 14) -> DataFrame:
    """keys, block, samples with a short fade where sound falls below the threshold and where it comes back.

    A fade reaches at most `fade` seconds into the next or the last block, so each block is done with that much of its
    neighbours beside it. Edges nearer than a fade to the start (sound ends) or the end (sound begins) of a signal stay.
    Blocks come back with `size` samples each.
    """
    reach = int(fade * rate)
    size = max(size, reach + 2)
    rows = staged(reblocked(blocks, keys, size), "wave-blocks")
    left = rows.select(*keys, (F.col("block") + 1).alias("block"), F.slice("samples", F.greatest(F.size("samples") - reach, F.lit(1)), F.lit(reach + 1)).alias("_before"))
    right = rows.select(*keys, (F.col("block") - 1).alias("block"), F.slice("samples", 1, reach + 1).alias("_after"))
    total = rows.groupBy(*keys).agg(F.sum(F.size("samples")).alias("_total"))
    near = scans.meet(scans.meet(scans.meet(rows, left, [*keys, "block"], "left"), right, [*keys, "block"], "left"), total, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, x, before, after, n in zip(batch.column("block").to_pylist(), *(arrays(batch.column(c)) for c in ("samples", "_before", "_after")), batch.column("_total").to_pylist(), strict=True):
                before, after = (np.zeros(0) if y is None else y for y in (before, after))
                wide = np.concatenate((before, x, after))
                turn = np.diff((np.abs(wide) < threshold).astype(np.int8))
                base, gain = block * size - len(before), np.ones(len(wide))
                for s in np.flatnonzero(turn == 1).tolist():
                    if base + s > reach:
                        length = min(base + s + reach, n) - (base + s)
                        gain[s : s + length] *= _fade(length, False)[: len(wide) - s]
                for e in np.flatnonzero(turn == -1).tolist():
                    if base + e < n - reach:
                        length = base + e - max(base + e - reach, 0)
                        gain[max(e - length, 0) : e] *= _fade(length, True)[max(length - e, 0) :]
                out.append(x * gain[len(before) : len(before) + len(x)])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*keys, "block")), lists(out)], [*keys, "block", "samples"])

    return near.mapInArrow(run, scans.schema_of(rows.select(*keys, "block"), samples="array<double>"))


def limited(blocks: DataFrame, keys: list[str], ceiling: float = 0.95) -> DataFrame:
    """keys, block, samples cut at the ceiling."""
    return blocks.select(*keys, "block", F.transform("samples", lambda x: F.greatest(F.lit(-ceiling), F.least(F.lit(ceiling), x))).alias("samples"))


def processed(blocks: DataFrame, keys: list[str], rate: float = RATE) -> DataFrame:
    """A voice made clear: equalised, compressed and limited."""
    return limited(compressed(staged(voice_eq(blocks, keys, rate), "wave-eq"), keys, rate), keys)
