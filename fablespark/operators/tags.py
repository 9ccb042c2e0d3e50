"""Inline performance tags: their table, aliases, and the prosody that a text's tags combine to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, category, native tag, speed, volume, pitch, pause before, pause after.
TAGS = (
    ("excited", "emotion", None, 1.15, 1.1, 0.3, 0.0, 0.0),
    ("sad", "emotion", None, 0.85, 0.9, -0.2, 0.0, 0.3),
    ("angry", "emotion", None, 1.1, 1.2, 0.2, 0.0, 0.0),
    ("whispers", "emotion", None, 0.9, 0.6, -0.1, 0.0, 0.0),
    ("fearful", "emotion", None, 1.2, 0.95, 0.4, 0.1, 0.0),
    ("surprised", "emotion", None, 1.1, 1.0, 0.5, 0.2, 0.0),
    ("tender", "emotion", None, 0.9, 0.85, -0.1, 0.0, 0.0),
    ("dramatic", "emotion", None, 0.85, 1.0, 0.0, 0.4, 0.4),
    ("sigh", "action", "[sigh]", 1.0, 1.0, 0.0, 0.0, 0.3),
    ("laugh", "action", "[laugh]", 1.0, 1.0, 0.0, 0.0, 0.2),
    ("chuckle", "action", "[chuckle]", 1.0, 1.0, 0.0, 0.0, 0.15),
    ("gasp", "action", "[gasp]", 1.0, 1.0, 0.0, 0.1, 0.2),
    ("cough", "action", "[cough]", 1.0, 1.0, 0.0, 0.0, 0.2),
    ("sniff", "action", None, 1.0, 1.0, 0.0, 0.0, 0.1),
    ("yawn", "action", None, 0.8, 1.0, 0.0, 0.0, 0.3),
    ("pause", "pause", None, 1.0, 1.0, 0.0, 0.0, 0.5),
    ("beat", "pause", None, 1.0, 1.0, 0.0, 0.0, 0.3),
    ("silence", "pause", None, 1.0, 1.0, 0.0, 0.0, 1.5),
    ("sarcastic", "style", None, 0.95, 1.0, 0.1, 0.0, 0.0),
    ("cheerful", "style", None, 1.05, 1.05, 0.2, 0.0, 0.0),
    ("serious", "style", None, 0.92, 1.0, -0.1, 0.0, 0.0),
    ("mysterious", "style", None, 0.88, 0.9, 0.0, 0.3, 0.0),
    ("narrator", "style", None, 0.95, 1.0, 0.0, 0.0, 0.0),
    ("announcer", "style", None, 1.0, 1.1, 0.1, 0.0, 0.0),
    ("footsteps", "sound", None, 1.0, 1.0, 0.0, 0.0, 0.5),
    ("door", "sound", None, 1.0, 1.0, 0.0, 0.0, 0.3),
    ("thunder", "sound", None, 1.0, 1.0, 0.0, 0.2, 0.5),
)
ALIASES = {
    "whisper": "whispers", "laughs": "laugh", "laughing": "laugh", "sighs": "sigh", "sighing": "sigh", "gasps": "gasp", "gasping": "gasp",
    "coughs": "cough", "coughing": "cough", "chuckles": "chuckle", "chuckling": "chuckle", "yawns": "yawn", "yawning": "yawn",
    "sniffs": "sniff", "sniffing": "sniff", "happy": "cheerful", "joyful": "cheerful", "mad": "angry", "furious": "angry",
    "scared": "fearful", "afraid": "fearful", "terrified": "fearful", "soft": "tender", "gentle": "tender", "quiet": "whispers",
    "loudly": "announcer", "dramatically": "dramatic", "sarcastically": "sarcastic",
}
SCHEMA = "tag string, category string, native string, speed double, volume double, pitch double, pause_before double, pause_after double"


def known_tags(spark: SparkSession) -> DataFrame:
    """Every name that a text may use, with the tag that it stands for; a fixed table."""
    tags = spark.createDataFrame([(n, *t) for t in TAGS for n in [t[0], *(a for a, of in ALIASES.items() if of == t[0])]], f"name string, {SCHEMA}")
    return F.broadcast(tags)


def names(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.transform(F.regexp_extract_all(t, F.lit(r"\[([A-Za-z_ -]+)\]"), F.lit(1)), lambda n: F.lower(F.trim(n)))


def prosody(text: Column | str) -> Column:
    """Combined effect of a text's tags: products of speed and volume, sum of pitch, longest pauses, all clamped."""
    table = F.create_map(*[x for t in TAGS for n in [t[0], *(a for a, of in ALIASES.items() if of == t[0])] for x in (F.lit(n), F.struct(*[F.lit(v).alias(k) for k, v in zip(("speed", "volume", "pitch", "before", "after"), t[3:], strict=True)]))])
    found = F.filter(F.transform(names(text), lambda n: table[n]), lambda t: t.isNotNull())
    start = F.struct(*[F.lit(v).alias(k) for k, v in (("speed", 1.0), ("volume", 1.0), ("pitch", 0.0), ("pause_before", 0.0), ("pause_after", 0.0))])

    def step(a: Column, t: Column) -> Column:
        return F.struct(
            (a["speed"] * t["speed"]).alias("speed"), (a["volume"] * t["volume"]).alias("volume"), (a["pitch"] + t["pitch"]).alias("pitch"),
            F.greatest(a["pause_before"], t["before"]).alias("pause_before"), F.greatest(a["pause_after"], t["after"]).alias("pause_after"),
        )

    def clamp(a: Column) -> Column:
        within = lambda x, low, high: F.greatest(F.lit(low), F.least(F.lit(high), x))
        return F.struct(within(a["speed"], 0.5, 1.5).alias("speed"), within(a["volume"], 0.3, 1.5).alias("volume"), within(a["pitch"], -1.0, 1.0).alias("pitch"), a["pause_before"].alias("pause_before"), a["pause_after"].alias("pause_after"))

    # Most texts have no tag.
    return F.when(~F.contains(F.col(text) if isinstance(text, str) else text, F.lit("[")), start).otherwise(F.aggregate(found, start, step, clamp))


def spoken_text(text: Column | str) -> Column:
    """Text with native tags left in, other known tags removed, and white space collapsed."""
    t = F.col(text) if isinstance(text, str) else text
    silent = [n for tag in TAGS if tag[2] is None for n in [tag[0], *(a for a, of in ALIASES.items() if of == tag[0])]]
    told = F.when(F.contains(t, F.lit("[")), F.regexp_replace(t, r"(?i)\[\s*(?:" + "|".join(sorted(silent, key=len, reverse=True)) + r")\s*\]", " ")).otherwise(t)
    return F.trim(F.regexp_replace(told, r" \s+|[\t\n\x0B\f\r]\s*", " "))  # a single space stays as it is
