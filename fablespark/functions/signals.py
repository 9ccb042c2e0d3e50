"""Audio samples as array columns: fades, crossfades, silence, limits; all JVM-side array functions."""

from __future__ import annotations

import math
from decimal import Decimal
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let


def ramp(n: Column, curve: str = "cosine", rising: bool = True) -> Column:
    """n gains from 0 to 1 (or back): linear, cosine or exponential (a square)."""

    def gain(i: Column) -> Column:
        t = F.when(n > 1, i / (n - 1)).otherwise(0.0)
        g = {"linear": t, "cosine": (1 - F.cos(t * pi)) / 2, "exponential": t * t}[curve]
        return g if rising else 1 - g

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), gain)).otherwise(F.array().cast("array<double>"))


def fade_in(samples: Column | str, n: int, curve: str = "cosine") -> Column:
    s = col(samples)
    size = F.least(F.lit(n), F.size(s))
    head = F.zip_with(F.slice(s, F.lit(1), size), ramp(size, curve), lambda x, g: x * g)
    return F.when(size > 0, F.concat(head, F.slice(s, size + 1, F.greatest(F.size(s) - size, F.lit(0))))).otherwise(s)


def fade_out(samples: Column | str, n: int, curve: str = "cosine") -> Column:
    return F.reverse(fade_in(F.reverse(col(samples)), n, curve))


def crossfade(a: Column | str, b: Column | str, n: int, least: int = 0, curve: str = "cosine") -> Column:
    """a and b overlapped by n samples; laid end to end where one is shorter than `least`."""
    a, b = col(a), col(b)
    over = F.least(F.lit(n), F.size(a), F.size(b))
    ends = F.transform(F.arrays_zip(F.slice(a, F.size(a) - over + 1, over).alias("x"), F.slice(b, F.lit(1), over).alias("y"), ramp(over, curve).alias("g")), lambda z: z["x"] * (1 - z["g"]) + z["y"] * z["g"])
    mixed = F.concat(F.slice(a, F.lit(1), F.size(a) - over), ends, F.slice(b, over + 1, F.size(b) - over))
    return F.when((F.size(a) < least) | (F.size(b) < least) | (over <= 0), F.concat(a, b)).otherwise(mixed)


def silence(seconds: Column, rate: int) -> Column:
    return F.array_repeat(F.lit(0.0), F.floor(seconds * rate).cast("int"))


def limited(samples: Column | str, ceiling: float = 0.95) -> Column:
    return F.transform(col(samples), lambda x: F.greatest(F.lit(-ceiling), F.least(F.lit(ceiling), x)))


def peak_normalised(samples: Column | str, peak: float = 0.9) -> Column:
    s = col(samples)
    top = F.array_max(F.transform(s, F.abs))
    return F.when(top > 0, F.transform(s, lambda x: x / top * peak)).otherwise(s)


def softened(samples: Column | str, amount: float) -> Column:
    """Roughness as a soft clip, mixed in by `amount`."""
    return F.transform(col(samples), lambda x: x * (1 - amount) + F.tanh(x * (1 + 4 * amount)) * amount)


def trimmed(samples: Column | str, threshold_db: float = -50.0) -> Column:
    """Without quiet samples at either end."""
    s, floor = col(samples), 10 ** (threshold_db / 20)
    loud = F.when(F.size(s) > 0, F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: F.abs(F.element_at(s, i)) > floor)).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(loud) > 0, F.slice(s, F.array_min(loud), F.array_max(loud) - F.array_min(loud) + 1)).otherwise(F.slice(s, 1, 0))


def rms_db(samples: Column | str) -> Column:
    s = col(samples)
    power = F.aggregate(s, F.lit(0.0), lambda a, x: a + x * x) / F.size(s)
    return F.when(power > 0, 10 * F.log10(power)).otherwise(-120.0)


def peak_db(samples: Column | str) -> Column:
    top = F.array_max(F.transform(col(samples), F.abs))
    return F.when(top > 0, 20 * F.log10(top)).otherwise(-120.0)


def fade_in_squared(signal: Column | str, n: int) -> Column:
    """The first n samples times sin^2."""
    return F.transform(col(signal), lambda x, i: F.when(i < n, x * F.pow(F.sin(i / max(n - 1, 1) * math.pi / 2), 2)).otherwise(x))


def fade_out_squared(signal: Column | str, n: int) -> Column:
    """The last n samples times cos^2."""
    s = col(signal)
    from_ = F.size(s) - n
    return F.transform(s, lambda x, i: F.when(i >= from_, x * F.pow(F.cos((i - from_) / max(n - 1, 1) * math.pi / 2), 2)).otherwise(x))


def resampled(signal: Column | str, size: Column | int) -> Column:
    """Linear interpolation onto `size` evenly spaced points."""
    s = col(signal)
    n = F.lit(size) if isinstance(size, int) else size
    place = lambda i: i * (F.size(s) - 1) / F.greatest(n - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(s, F.floor(place(i)).cast("int")) + (F.coalesce(F.get(s, (F.floor(place(i)) + 1).cast("int")), F.element_at(s, -1)) - F.get(s, F.floor(place(i)).cast("int"))) * (place(i) - F.floor(place(i))))


def joined(parts: Column | str, n: int, curve: str = "cosine") -> Column:
    """Signals crossfaded one after the other, from the left."""
    p = col(parts)
    return F.when(F.size(p) > 0, F.aggregate(F.slice(p, 2, F.size(p)), F.get(p, F.lit(0)), lambda a, b: crossfade(a, b, n, curve=curve)))


def with_pauses(parts: Column | str, pauses: Column | str, rate: int) -> Column:
    """Signals end to end, silence of a pause in seconds after each."""
    return F.flatten(F.zip_with(col(parts), col(pauses), lambda s, p: F.concat(s, F.array_repeat(F.lit(0.0), F.round(p * rate).cast("int")))))


def weighted_split(signal: Column | str, weights: list[float]) -> Column:
    """A signal cut into parts of the given shares of its length; the last takes the rest.

    Shares are summed and multiplied as the decimals they are written as: 0.7 of 90 samples are 63.
    """
    s = col(signal)
    n, cuts, total = F.size(s), [F.lit(0)], Decimal(0)
    for w in weights[:-1]:
        total += Decimal(str(w))
        cuts.append(F.floor(n * F.lit(total)).cast("int"))
    cuts.append(n)
    return F.array(*[F.slice(s, a + 1, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def soft_clip(signal: Column | str, drive: float) -> Column:
    return F.transform(col(signal), lambda x: F.tanh(x * drive) / math.tanh(drive))


def peak_limited(signal: Column | str, peak: float = 0.95) -> Column:
    """Scaled so that no sample exceeds the peak; quieter signals stay."""
    return let(F.array_max(F.transform(col(signal), F.abs)), lambda top: F.when(top > peak, F.transform(col(signal), lambda x: x * peak / top)).otherwise(col(signal)))
