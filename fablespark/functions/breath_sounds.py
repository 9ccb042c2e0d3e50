"""Sounds between words as arrays of samples: breaths of five kinds, room tone, clicks of the mouth, and unsteady loudness.

All noise is drawn from a key and the place of the sample (see operators.waves), so a sound repeats for its key and needs no state.
Sounds last a second at most, so each is one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scans import schema_of
from ..operators.waves import lists, noise_draw
from . import prosody as P
from . import text as T

try:  # CPython's own takes half the time of OpenSSL's for a few bytes
    from _md5 import md5
except ImportError:
    from hashlib import md5

# Loudness at full intensity, samples that are averaged at 24 kHz, and unsteadiness, by kind; sounds and seconds of tags; seconds of silent tags.
KINDS = {"soft": (0.02, 30, 0.03), "sharp": (0.05, 10, 0.08), "deep": (0.04, 30, 0.04), "gasp": (0.06, 8, 0.10), "sigh": (0.035, 40, 0.03)}
TAG_SOUNDS = {"gasp": ("gasp", 0.3), "sigh": ("sigh", 0.6), "breath": ("soft", 0.4), "breath:soft": ("soft", 0.3), "breath:deep": ("deep", 0.5), "inhale": ("sharp", 0.25), "exhale": ("deep", 0.4)}
TAG_SILENCES = {"pause": 0.3, "beat": 0.3, "long pause": 0.8, "silence": 1.0}
ROOM = 0.0001
CLICK = 0.05
EMPTY = "cast(array() as array<double>)"


def _table(kind: Column, at: int, default: float) -> Column:
    return T.lookup(kind, {k: float(v[at]) for k, v in KINDS.items()}, default)


def _over(n: Column, at) -> Column:
    """at(i) for i from 0 to n - 1."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.expr(EMPTY))


def _steady(key: Column, i: Column) -> Column:
    """White noise of unit variance."""
    return noise_draw(key, -1, i) * math.sqrt(3)


def envelope(kind: Column, t: Column) -> Column:
    """How a breath swells and falls over its length, t from 0 to 1."""
    return (
        F.when(kind == "soft", F.pow(F.sin(math.pi * t), F.lit(2)))
        .when(kind == "sharp", F.sqrt(t) * F.pow(1 - t, F.lit(4)) * 5)
        .when(kind == "deep", t * t * F.sqrt(1 - t) * 2)
        .when(kind == "gasp", F.exp(-5 * t) * (1 - F.exp(-20 * t)) * 3)
        .when(kind == "sigh", F.pow(t, F.lit(0.3)) * F.exp(-2 * t) * 2.5)
        .otherwise(1.0)
    )


def averaged(samples: Column, width: Column | int) -> Column:
    """Each sample's mean with its neighbours, `width` in all; what lies beyond the ends counts as 0."""
    w = F.lit(width) if isinstance(width, int) else width
    right = F.floor((w - 1) / 2).cast("int")
    bound = F.struct(samples.alias("s"), w.alias("w"), right.alias("right"), (F.size(samples) - 1).alias("last"))

    def mean(m: Column) -> Column:
        def at(i: Column) -> Column:
            low = F.greatest(i + m["right"] - m["w"] + 1, F.lit(0))
            return F.aggregate(F.slice(m["s"], low + 1, F.least(i + m["right"], m["last"]) - low + 1), F.lit(0.0), lambda a, x: a + x) / m["w"]

        return _over(F.size(m["s"]), at)

    return T.let(bound, mean)


def breath(key: Column, kind: Column | str, duration: Column | float, intensity: Column | float = 0.5, rate: int = 24000) -> Column:
    """A breath: noise under the kind's envelope, softened. Its length varies by a tenth with the key."""
    n, loud, width, k = _shape(key, kind, duration, intensity, rate)
    # Bound once: what stands inside the lambda is evaluated for every sample.
    made = F.struct(n.alias("n"), loud.alias("loud"), F.greatest(F.lit(1), n - 1).cast("double").alias("last"), k.alias("kind"))
    raw = T.let(made, lambda m: _over(m["n"], lambda i: _steady(key, i) * envelope(m["kind"], i / m["last"]) * m["loud"]))
    return T.let(F.struct(raw.alias("raw"), width.alias("width")), lambda m: averaged(m["raw"], m["width"]))


def _shape(key: Column, kind: Column | str, duration: Column | float, intensity: Column | float, rate: int) -> tuple[Column, Column, Column, Column]:
    """Samples, loudness, samples that are averaged, and kind of a breath."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    seconds = (F.lit(duration) if isinstance(duration, float) else duration) * (0.9 + 0.2 * P.share(key, F.lit("length")))
    loud = F.when(k.isin(*KINDS), _table(k, 0, 0.0) * intensity).otherwise(0.02)
    width = F.greatest(F.lit(1), F.round(_table(k, 1, 30.0) * rate / 24000).cast("int"))
    return F.floor(seconds * rate).cast("int"), loud, width, k


def room_tone(key: Column, seconds: Column | float, rate: int = 24000, floor: float = ROOM) -> Column:
    """The noise of a silent room."""
    n = F.floor((F.lit(seconds) if isinstance(seconds, float) else seconds) * rate).cast("int")
    return _over(n, lambda i: _steady(key, i) * floor)


def click(key: Column, rate: int = 24000) -> Column:
    """A short noise of the mouth, 10 to 30 milliseconds long."""
    n = F.floor((0.01 + 0.02 * P.share(key, F.lit("length"))) * rate).cast("int")
    return T.let(n, lambda m: _over(m, lambda i: _steady(key, i) * CLICK * F.pow(F.sin(math.pi * i / F.greatest(m - 1, F.lit(1))), F.lit(10))))


def unsteady(samples: Column, key: Column, amount: float = 0.05, frequency: float = 20.0, rate: int = 24000) -> Column:
    """Loudness that wavers by `amount`: four slow waves of phases that depend on the key, and a little noise, smoothed."""
    phases = [2 * math.pi * P.share(key, F.lit(f"phase{j}")) for j in range(4)]
    speeds = (0.5, 1.0, 2.0, 3.0)
    wave = lambda i: reduce(lambda a, b: a + b, [F.sin(2 * math.pi * frequency * s * i / rate + p) / s for s, p in zip(speeds, phases, strict=True)]) + _steady(key, i) * 0.3
    width = max(1, int(rate / frequency / 2))

    def wavering(s: Column) -> Column:
        smooth = F.when(F.size(s) > width, averaged(_over(F.size(s), wave), width)).otherwise(_over(F.size(s), wave))
        return T.let(smooth, lambda j: T.let(F.array_max(F.transform(j, F.abs)), lambda top: F.zip_with(s, j, lambda x, y: x * (1 + amount * F.when(top > 0, y / top).otherwise(y)))))

    return F.when(F.size(samples) > 0, T.let(samples, wavering)).otherwise(samples) if amount > 0 else samples


def tag_sound(tag: Column | str, key: Column, intensity: Column | float = 0.5, rate: int = 24000) -> Column:
    """The sound that an inline tag stands for: a breath, or the room's tone for pauses; null for other tags."""
    kinds, seconds, quiet = _meaning(tag)
    return F.when(kinds.isNotNull(), breath(key, kinds, seconds, intensity, rate)).when(quiet > 0, room_tone(key, quiet, rate))


def _meaning(tag: Column | str) -> tuple[Column, Column, Column]:
    """Kind and seconds of the breath, and seconds of the pause, that a tag stands for."""
    t = F.lower(T.strip(tag))
    kinds = F.create_map(*[F.lit(x) for k, (kind, _) in TAG_SOUNDS.items() for x in (k, kind)])[t]
    return kinds, T.lookup(t, {k: s for k, (_, s) in TAG_SOUNDS.items()}, 0.0), T.lookup(t, TAG_SILENCES, 0.0)


#: The envelopes over arrays of times.
SHAPES = {
    "soft": lambda t: np.sin(math.pi * t) ** 2,
    "sharp": lambda t: np.sqrt(t) * (1 - t) ** 4 * 5,
    "deep": lambda t: t * t * np.sqrt(1 - t) * 2,
    "gasp": lambda t: np.exp(-5 * t) * (1 - np.exp(-20 * t)) * 3,
    "sigh": lambda t: t**0.3 * np.exp(-2 * t) * 2.5,
}
BATCH_SAMPLES = 1 << 20  # most of a batch of sounds, beyond its last one


def _noise(key: str, places: list[bytes]) -> np.ndarray:
    """_steady at all places."""
    start = f"{key}:-1:".encode()
    drawn = b"".join([md5(start + i, usedforsecurity=False).digest()[:4] for i in places])
    return (np.frombuffer(drawn, ">u4") / 2**31 - 1) * math.sqrt(3)


def tag_sounds(rows: DataFrame, tag: Column | str, key: Column, out: str, intensity: Column | float = 0.5, rate: int = 24000) -> DataFrame:
    """rows with `out`, the samples of tag_sound; for many rows, as a sample costs a fifth of what it costs as a column. A null key counts as empty."""
    kinds, seconds, quiet = _meaning(tag)
    n, loud, width, _ = _shape(key, kinds, seconds, intensity, rate)
    n = F.when(kinds.isNotNull(), n).when(quiet > 0, F.floor(quiet * rate).cast("int"))
    made = rows.withColumns({"_key": F.coalesce(key.cast("string"), F.lit("")), "_kind": kinds, "_n": n, "_loud": F.when(kinds.isNotNull(), loud).otherwise(ROOM), "_width": width})
    names = [*rows.columns, out]

    def sound(key: str, kind: str | None, n: int | None, loud: float | None, width: int, places: list[bytes]) -> np.ndarray | None:
        if n is None or loud is None:
            return None
        if n < 1:
            return np.zeros(0)
        places.extend(str(i).encode() for i in range(len(places), n))
        raw = _noise(key, places[:n])
        if kind is None:
            return raw * loud
        raw = raw * SHAPES[kind](np.arange(n) / max(1, n - 1)) * loud
        right = (width - 1) // 2
        return np.convolve(raw, np.ones(width))[right : right + n] / width if width > 1 else raw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: list[bytes] = []
        for batch in batches:
            held, size, start = [], 0, 0
            for i, shape in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_key", "_kind", "_n", "_loud", "_width")), strict=True)):
                held.append(sound(*shape, places))
                size += 0 if held[-1] is None else len(held[-1])
                if size >= BATCH_SAMPLES or i == len(batch) - 1:
                    part = batch.slice(start, len(held))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:-1]), lists(held)], names)
                    held, size, start = [], 0, i + 1

    return made.mapInArrow(run, schema_of(rows, **{out: "array<double>"}))


def crossfade_squared(a: Column | str, b: Column | str, n: int) -> Column:
    """a and b overlapped by n samples with weights cos^2 and sin^2; laid end to end where one is shorter."""
    a, b = T.col(a), T.col(b)
    turn = lambda i: i / max(n - 1, 1) * (math.pi / 2)
    ends = F.zip_with(F.slice(a, F.size(a) - n + 1, n), F.slice(b, 1, n), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    mixed = F.transform(ends, lambda z, i: z["x"] * F.pow(F.cos(turn(i)), F.lit(2)) + z["y"] * F.pow(F.sin(turn(i)), F.lit(2)))
    whole = F.concat(F.slice(a, F.lit(1), F.size(a) - n), mixed, F.slice(b, F.lit(n + 1), F.greatest(F.size(b) - n, F.lit(0))))
    return F.when((F.size(a) < n) | (F.size(b) < n) | F.lit(n <= 0), F.concat(a, b)).otherwise(whole)
