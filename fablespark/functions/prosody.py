"""Prosody from emotion: interpolated multipliers, styles for a context, pauses and voices by rule."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Multipliers of speed, pitch and volume by intensity; styles by narrative type and emotion; languages by voice prefix.
MULTIPLIERS = ((0.0, (1.0, 0.0, 1.0)), (0.25, (1.02, 0.1, 1.02)), (0.5, (1.05, 0.2, 1.05)), (0.75, (1.1, 0.35, 1.1)), (1.0, (1.2, 0.5, 1.15)))
STYLES = {"action": "energetic", "description": "documentary", "introspection": "intimate", "flashback": "intimate", "suspense": "dramatic"}


def multipliers(intensity: Column | str) -> Column:
    """struct(speed, pitch, volume) on straight lines between the given intensities; beyond 0 and 1 the ends hold."""

    def between(x: Column) -> Column:
        out = None
        for (low, a), (high, b) in reversed(list(zip(MULTIPLIERS[:-1], MULTIPLIERS[1:], strict=True))):
            ratio = (x - low) / (high - low)
            row = F.struct(*[(F.lit(p) + (q - p) * ratio).alias(n) for n, p, q in zip(("speed", "pitch", "volume"), a, b, strict=True)])
            out = row if out is None else F.when(x < high, row).otherwise(out)
        return out

    return T.let(F.greatest(F.lit(0.0), F.least(F.lit(1.0), T.col(intensity).cast("double"))), between)


def style_for(narrative: Column | str, emotion: Column | str, spoken: Column | str) -> Column:
    """Style of a segment: dialogue first, then the narrative type; null where neither decides."""
    table = F.create_map(*[F.lit(x) for kv in STYLES.items() for x in kv])
    said = F.when(T.col(emotion).isin("anger", "fear", "excitement"), "dramatic").otherwise("conversational")
    return F.when(T.col(spoken), said).otherwise(F.try_element_at(table, T.col(narrative)))


def preview(text: Column | str, size: int) -> Column:
    """At most `size` characters: up to the last full stop, if that lies in the second half."""
    cut = F.substring(T.col(text), 1, size)
    stop = F.length(cut) - F.locate(".", F.reverse(cut)) + 1
    ended = F.when((F.locate(".", cut) > 0) & (stop > size / 2), F.substring(cut, F.lit(1), stop.cast("int"))).otherwise(F.concat(cut, F.lit("...")))
    return F.when(F.length(T.col(text)) <= size, T.col(text)).otherwise(ended)


def full_text(title: Column | str, content: Column | str) -> Column:
    return F.concat(T.col(title), F.lit("\n\n"), T.col(content))


def voice_string(voices: Column | str) -> Column:
    """name:0.70,name:0.30 of an array of (voice, weight)."""
    return F.array_join(F.transform(T.col(voices), lambda v: F.format_string("%s:%.2f", v["voice"], v["weight"])), ",")


# Speed, pitch and volume of a style, how far each may vary, pause factor, pauses after sentence and paragraph, strength of emphasis, and whether it varies.
STYLE_PROFILES = {
    "formal": (0.95, 0.0, 1.0, 0.02, 0.1, 0.02, 1.2, 0.5, 1.0, 0.7, False),
    "conversational": (1.05, 0.3, 0.95, 0.08, 0.5, 0.08, 0.9, 0.3, 0.6, 1.0, True),
    "dramatic": (0.92, 0.0, 1.05, 0.12, 1.0, 0.15, 1.3, 0.6, 1.2, 1.5, True),
    "storytelling": (1.0, 0.2, 1.0, 0.1, 0.7, 0.1, 1.1, 0.45, 0.9, 1.2, True),
    "documentary": (1.0, -0.2, 1.0, 0.03, 0.2, 0.03, 1.0, 0.4, 0.8, 0.8, False),
    "intimate": (0.9, -0.3, 0.85, 0.05, 0.3, 0.05, 1.2, 0.5, 1.0, 0.9, True),
    "energetic": (1.12, 0.5, 1.1, 0.1, 0.8, 0.12, 0.8, 0.25, 0.5, 1.3, True),
}
# What exaggeration adds to the multipliers of speed, pitch and volume, by emotion.
EXAGGERATIONS = {"joy": (0.05, 0.2, 0.05), "sad": (-0.08, -0.15, -0.05), "anger": (0.1, 0.1, 0.15), "fear": (0.15, 0.25, 0.0), "surprise": (0.05, 0.3, 0.05), "tender": (-0.05, -0.1, -0.05), "excitement": (0.12, 0.25, 0.1)}
LIMITS = ((0.5, 1.5), (-3.0, 3.0), (0.3, 1.5))
SIGMA, LEAST_PAUSE, MOST_PAUSE = 0.05, 0.85, 1.15
EMPHASIS_PAUSE = 0.05


def share(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone, for what varies by chance elsewhere."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("double") / 2**32


def _profile(style: Column, at: int) -> Column:
    table = {k: float(v[at]) for k, v in STYLE_PROFILES.items()}
    return T.lookup(style, table, table["storytelling"])


def styled(style: Column | str, speed: Column, pitch: Column, volume: Column, *key: Column) -> Column:
    """struct(speed, pitch, volume) in a style, varied by the key where the style varies, within limits; unknown styles tell stories."""
    s = T.col(style)
    out = []
    for i, (name, base) in enumerate((("speed", speed), ("pitch", pitch), ("volume", volume))):
        value = base + _profile(s, i) if name == "pitch" else base * _profile(s, i)
        varied = value + F.when(_profile(s, 10) > 0, (2 * share(*key, F.lit(name)) - 1) * _profile(s, 3 + i)).otherwise(0.0)
        out.append(F.greatest(F.lit(LIMITS[i][0]), F.least(F.lit(LIMITS[i][1]), varied)).alias(name))
    return F.struct(*out)


def style_pause(kind: Column | str, style: Column | str, *key: Column) -> Column:
    """Seconds of pause of a kind (sentence, paragraph, comma, breath, dramatic) in a style, a tenth more or less where it varies."""
    k, s = T.col(kind), T.col(style)
    sentence = _profile(s, 7)
    base = F.when(k == "paragraph", _profile(s, 8)).when(k == "comma", sentence * 0.5).when(k == "breath", 0.3).when(k == "dramatic", sentence * 2.0).otherwise(sentence)
    return base * _profile(s, 6) * F.when(_profile(s, 10) > 0, 0.9 + 0.2 * share(*key, F.lit("pause"))).otherwise(1.0)


def exaggerated(intensity: Column | str, emotion: Column | str, exaggeration: float, speed: float = 1.0, pitch: float = 0.0, volume: float = 1.0) -> Column:
    """struct(speed, pitch, volume): the multipliers of an intensity and, by `exaggeration`, what an emotion adds to them."""
    adds = [T.lookup(T.col(emotion), {k: v[i] * exaggeration for k, v in EXAGGERATIONS.items()}, 0.0) for i in range(3)]
    return T.let(multipliers(intensity), lambda m: F.struct((speed * (m["speed"] + adds[0])).alias("speed"), (pitch + m["pitch"] + adds[1]).alias("pitch"), (volume * (m["volume"] + adds[2])).alias("volume")))


def humanised_pause(pause: Column | str, *key: Column) -> Column:
    """A pause times a draw from a normal curve around 1, within limits; pauses of nothing stay."""
    p = T.col(pause)
    draw = 1 + SIGMA * F.sqrt(-2 * F.log(1 - share(*key, F.lit("u")))) * F.cos(2 * pi * share(*key, F.lit("v")))
    return F.when(p > 0, p * F.greatest(F.lit(LEAST_PAUSE), F.least(F.lit(MOST_PAUSE), draw))).otherwise(p)


def emphasis_pauses(text: Column | str, seconds: float = EMPHASIS_PAUSE) -> Column:
    """A pause before each word of emphasis but one that begins the text."""
    edge = r"""[.,;:!?"'«»]*"""
    return F.regexp_replace(T.col(text), rf"(?iuU)(?<=\s)({edge}(?:{'|'.join(T.EMPHASIS_WORDS)}){edge})(?=\s|\z)", f" [pause:{seconds}]$1")


# How strong an intensity is, what voice an emotion mixes in and how much of it, and its steps of speed and pitch for each level of intensity.
STRENGTHS = {"low": 0.2, "medium": 0.5, "high": 0.8, "extreme": 1.0}
BLENDS = {"anger": ("am_adam", 0.3), "sadness": ("af_bella", 0.25), "fear": ("af_sky", 0.3), "joy": ("af_nicole", 0.2), "excitement": ("af_nicole", 0.2), "suspense": ("am_michael", 0.15)}
MODIFIERS = {"anger": (1.0, 0.05, 0.0), "fear": (1.0, 0.08, 0.2), "sadness": (1.0, -0.05, -0.1), "joy": (1.0, 0.05, 0.15), "suspense": (0.9, -0.03, 0.0)}


def blended_voice(voice: Column | str, emotion: Column | str, intensity: Column | str) -> Column:
    """The voice, or a mix "voice:0.85,other:0.15" with the voice that stands for an emotion, the more the stronger it is."""
    v, e = T.col(voice), T.col(emotion)
    weight = T.lookup(e, {k: w for k, (_, w) in BLENDS.items()}, 0.0) * T.lookup(T.col(intensity), STRENGTHS, 0.5)
    other = F.create_map(*[F.lit(x) for k, (o, _) in BLENDS.items() for x in (k, o)])[e]
    return F.when(other.isNull() | (other == v), v).otherwise(F.format_string("%s:%.2f,%s:%.2f", v, 1 - weight, other, weight))


def emotion_modifiers(emotion: Column | str, intensity: Column | str) -> Column:
    """struct(speed, pitch): what an emotion does at a level of intensity, 1 to 4."""
    e, level = T.col(emotion), T.lookup(T.col(intensity), {k: i + 1.0 for i, k in enumerate(STRENGTHS)}, 2.0)
    part = lambda i, default: T.lookup(e, {k: v[i] for k, v in MODIFIERS.items()}, default)
    return F.struct((part(0, 1.0) + part(1, 0.0) * level).alias("speed"), (part(2, 0.0) * level).alias("pitch"))
