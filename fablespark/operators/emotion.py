"""Scoring of emotion and narrative type, and their continuity from segment to segment."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import scans

# Fixed values, all tables down to BASE_SPEEDS: keywords by emotion, in the order that breaks ties;
# words and patterns of narrative types; relations, pauses, speeds and tones of emotions.
KEYWORDS = {
    "joy": ("heureux", "heureuse", "joie", "rire", "sourire", "content", "ravis"),
    "sadness": ("triste", "pleurer", "larmes", "chagrin", "melancolie", "desole"),
    "anger": ("colere", "furieux", "rage", "enerve", "crier", "hurler"),
    "fear": ("peur", "terreur", "effraye", "anxieux", "trembler", "craindre"),
    "surprise": ("surpris", "etonne", "stupefait", "incroyable", "soudain"),
    "suspense": ("suspense", "attendre", "silence", "immobile", "souffle"),
    "tenderness": ("tendresse", "doux", "caresse", "amour", "affection"),
    "excitement": ("excite", "enthousiaste", "impatient", "hate", "vibrant"),
    "irony": ("ironique", "sarcastique", "ricaner", "evidemment", "bien sur"),
}
ACTION = ("run", "jump", "hit", "throw", "catch", "leap", "dodge", "flee", "chase", "dive", "sprint", "crash", "explode", "strike", "punch", "kick", "shoot", "grab", "rush")
DESCRIPTION = ("was", "seemed", "appeared", "looked", "stood", "lay", "hung", "stretched", "loomed", "dominated", "decorated", "adorned", "bathed", "floated")
INTROSPECTION = ("thought", "wondered", "pondered", "reflected", "remembered", "recalled", "imagined", "dreamed", "realized", "understood", "knew", "felt")
THOUGHTS = ("(?:he|she) thought", "(?:he|she) wondered", "(?:he|she) realized", "(?:he|she) knew")
FLASHBACK = ("years ago", "long ago", "back then", "once upon a time", "(?:he|she) remembered", "the memory", "in (?:his|her) mind")
COMPATIBLE = {
    "neutral": ("joy", "sadness", "suspense"), "joy": ("excitement", "tenderness", "neutral"), "sadness": ("tenderness", "neutral", "anger"),
    "anger": ("fear", "sadness", "neutral"), "fear": ("suspense", "anger", "neutral"), "surprise": ("joy", "fear", "anger"),
    "excitement": ("joy", "surprise", "suspense"), "tenderness": ("joy", "sadness", "neutral"), "suspense": ("fear", "surprise", "excitement"),
    "disgust": ("anger", "fear", "neutral"), "irony": ("neutral", "joy", "anger"),
}
OPPOSITE = (("joy", "sadness"), ("anger", "tenderness"), ("fear", "joy"), ("excitement", "sadness"))
TRANSITION_PAUSES = {"smooth": 0.2, "gradual": 0.4, "sudden": 0.6, "dramatic": 0.8, "resolution": 0.5}
TRANSITION_SPEEDS = {"excitement": 1.1, "anger": 1.05, "sadness": 0.92, "tenderness": 0.95, "suspense": 0.88}
ADJECTIVES = r"(?U)\b\w+(?:e|eux|euse|ant|ent)s?\b.*?\b\w+(?:e|eux|euse|ant|ent)s?\b"
#: As ADJECTIVES, sought from the endings: what stands before an ending within its word is not looked at letter by letter.
ENDING = r"(?=[ea])\B(?:e(?:ux|use|nt)?|ant)s?\b"
TWO_ADJECTIVES = f"(?U){ENDING}.*?{ENDING}"
LEVELS = ("low", "medium", "high", "extreme")
TONES = {"joy": "joyeux", "sadness": "melancolique", "anger": "tendu", "fear": "angoissant", "suspense": "haletant", "tenderness": "tendre", "excitement": "exaltant", "neutral": "neutre"}
BASE_SPEEDS = {"excitement": 1.05, "suspense": 0.95, "sadness": 0.92, "tenderness": 0.95, "anger": 1.02}


def _hits(text: Column, needles: tuple[str, ...], regex: bool = False) -> Column:
    return reduce(lambda a, b: a + b, [(text.rlike(n) if regex else text.contains(n)).cast("int") for n in needles])


def _spelled(pattern: str) -> list[str]:
    """All that a pattern matches whose only signs are (?:a|b)."""
    either = re.search(r"\(\?:([^)]*)\)", pattern)
    if not either:
        return [pattern]
    return [pattern[: either.start()] + w + rest for w in either[1].split("|") for rest in _spelled(pattern[either.end() :])]


class _Needles:
    """Words of several groups, each with a bit of its own, so that one search of a text finds which of them it holds."""

    def __init__(self, groups: dict[str, tuple[str, ...]]):
        own: dict[str, int] = {}
        self.masks, at = dict.fromkeys(groups, 0), 0
        for name, patterns in groups.items():
            for p in patterns:
                for w in _spelled(p):
                    own[w] = own.get(w, 0) | 1 << at
                self.masks[name] |= 1 << at
                at += 1
        assert at < 64  # bits of a long, its sign left out
        # Where a word is found, so are those that it begins with.
        self.bits = {w: reduce(lambda a, b: a | b, [b for v, b in own.items() if w.startswith(v)]) for w in own}

    def hits(self, held: Column, *groups: str) -> Column:
        """How many words of these groups are held."""
        return F.bit_count(held.bitwiseAND(F.lit(sum(self.masks[g] for g in groups)).cast("bigint")))


EMOTIONS = _Needles(KEYWORDS)
TYPES = _Needles({"action": ACTION, "description": DESCRIPTION, "introspection": INTROSPECTION, "thoughts": THOUGHTS, "flashback": FLASHBACK})


def _held(low: Column, *needles: _Needles) -> Column:
    """struct(h0, h1, ...): the bits of the words that a text holds, of each table of needles.

    One automaton over a batch leaves the texts that hold any; only these are searched place by place, for the longest word at each.
    """
    words = sorted({w for n in needles for w in n.bits})
    some, places = "|".join(map(re.escape, words)), f"(?=({T.either(set(words))}))"
    bits = {w: [n.bits.get(w, 0) for n in needles] for w in words}

    def search(texts: pa.Array) -> pa.Array:
        out, place = np.zeros((len(needles), len(texts)), np.int64), re.compile(places)
        at = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, some), False).to_numpy(zero_copy_only=False))
        for i, text in zip(at.tolist(), texts.take(pa.array(at)).to_pylist(), strict=True):
            for w in place.findall(text):
                for k, b in enumerate(bits[w]):
                    out[k, i] |= b
        return pa.StructArray.from_arrays([pa.array(row) for row in out], [f"h{k}" for k in range(len(needles))])

    return F.arrow_udf(search, ", ".join(f"h{k} bigint" for k in range(len(needles))))(low)


def _emotion(held: Column) -> Column:
    """keyword_emotion() by the keywords held."""
    top = lambda h: F.array_max(F.array(*[F.struct(EMOTIONS.hits(h, name).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("emotion")) for i, name in enumerate(KEYWORDS)]))
    of = lambda best: F.struct(best["emotion"].alias("emotion"), F.least(best["n"] / 3, F.lit(0.8)).alias("confidence"))
    none = F.struct(F.lit("neutral").alias("emotion"), F.lit(0.5).alias("confidence"))
    return F.when(held == 0, none).otherwise(T.let(top(held), of))


def keyword_emotion(text: Column | str) -> Column:
    """struct(emotion, confidence): the emotion with most keywords, the first listed of equals."""

    def top(low: Column) -> Column:
        return F.array_max(F.array(*[F.struct(_hits(low, words).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("emotion")) for i, (name, words) in enumerate(KEYWORDS.items())]))

    return T.let(
        T.let(F.lower(T.col(text)), top),
        lambda best: F.struct(F.when(best["n"] > 0, best["emotion"]).otherwise("neutral").alias("emotion"), F.when(best["n"] > 0, F.least(best["n"] / 3, F.lit(0.8))).otherwise(0.5).alias("confidence")),
    )


def sentence_sizes(text: Column | str) -> Column:
    """Words of each part between `.`, `!` and `?`."""
    return F.transform(F.split(T.col(text), "[.!?]"), T.word_count)


def _mostly(sizes: Column, test: Callable[[Column], Column]) -> Column:
    return (F.size(F.filter(sizes, test)) > F.size(sizes) / 2).cast("int")


def action_score(text: Column | str, sizes: Column | None = None, low: Column | None = None) -> Column:
    t = T.col(text)
    score = _hits(F.lower(t) if low is None else low, ACTION) + _mostly(sentence_sizes(t) if sizes is None else sizes, lambda n: n < 8)
    return F.least((score + F.when(F.length(t) - F.length(F.replace(t, F.lit("!"))) > 1, 0.5).otherwise(0.0) + F.when(t.contains("..."), 0.3).otherwise(0.0)) / 3, F.lit(1.0))


def description_score(text: Column | str, sizes: Column | None = None, low: Column | None = None) -> Column:
    t, low = T.col(text), F.lower(T.col(text)) if low is None else low
    score = _hits(low, DESCRIPTION) + _mostly(sentence_sizes(t) if sizes is None else sizes, lambda n: n > 15)
    # Two adjective-like words on one line; the second is sought from the first that is found.
    adjectives = low.rlike(TWO_ADJECTIVES)
    return F.least((score + F.when(adjectives, 0.5).otherwise(0.0) + F.when(_hits(low, ACTION) == 0, 0.3).otherwise(0.0)) / 3, F.lit(1.0))


def introspection_score(text: Column | str, low: Column | None = None) -> Column:
    t, low = T.col(text), F.lower(T.col(text)) if low is None else low
    return _introspection(t, _hits(low, INTROSPECTION) + _hits(low, THOUGHTS, regex=True))


def _introspection(t: Column, hits: Column) -> Column:
    asks = t.contains("?") & t.rlike(r"\?(?!\s*[»\"])") & ~T.is_dialogue(t)
    marked = (t.contains("*") | t.contains("_")) & t.rlike(r"\*[^*]+\*|_[^_]+_")
    return F.least((hits + F.when(marked, 0.5).otherwise(0.0) + F.when(asks, 0.5).otherwise(0.0)) / 3, F.lit(1.0))


def flashback_score(text: Column | str, low: Column | None = None) -> Column:
    return F.least(_hits(F.lower(T.col(text)) if low is None else low, FLASHBACK, regex=True) / 2, F.lit(1.0))


#: A text whose only mark, if any, is its last character: one part, or one and an empty one.
ONE_PART = r"\A[^.!?]*+[.!?]?\z"


def _at_least(words: int) -> str:
    """A pattern for texts whose first part has so many words."""
    return rf"(?U)\A\s*+(?:[^\s.!?]++\s++){{{words - 1}}}[^\s.!?]"


def narrative_types(df: DataFrame, text: str, out: str = "narrative") -> DataFrame:
    """df with struct(type, confidence): dialogue first, then the best of four scores from 0.3 up, else narration."""
    steps = df.withColumn("_low", F.lower(text)).withColumn("_held", _held(F.col("_low"), TYPES))
    return _typed(steps.withColumn("_types", F.col("_held.h0")), text, out).select(*df.columns, out)


def emotions_and_types(df: DataFrame, text: str, feeling: str, out: str) -> DataFrame:
    """df with keyword_emotion() and narrative_types() of its texts, the words of both found in one search."""
    steps = df.withColumn("_low", F.lower(text)).withColumn("_held", _held(F.col("_low"), EMOTIONS, TYPES))
    steps = steps.withColumn(feeling, _emotion(F.col("_held.h0"))).withColumn("_types", F.col("_held.h1"))
    return _typed(steps, text, out).select(*df.columns, feeling, out)


def _typed(steps: DataFrame, text: str, out: str) -> DataFrame:
    """steps(_low, _types: lower case and the words of TYPES held) with the narrative type.

    Sizes and scores are column steps of their own, so that each is made once a row. Sizes of parts are measured one by
    one only where a text has more than one.
    """
    low, held, t = F.col("_low"), F.col("_types"), F.col(text)
    steps = steps.withColumn("_one", t.rlike(ONE_PART)).withColumn("_sizes", F.when(~F.col("_one"), sentence_sizes(t)))
    sizes = F.col("_sizes")
    short = F.when(F.col("_one"), (~t.rlike(_at_least(8))).cast("int")).otherwise(_mostly(sizes, lambda n: n < 8))
    long_ = F.when(F.col("_one"), (~t.rlike(r"[.!?]\z") & t.rlike(_at_least(16))).cast("int")).otherwise(_mostly(sizes, lambda n: n > 15))
    # As the four score functions above, the action words counted once for two of them.
    steps = steps.withColumn("_acts", TYPES.hits(held, "action"))
    steps = steps.withColumn("_action", F.least((F.col("_acts") + short + F.when(F.length(t) - F.length(F.replace(t, F.lit("!"))) > 1, 0.5).otherwise(0.0) + F.when(t.contains("..."), 0.3).otherwise(0.0)) / 3, F.lit(1.0)))
    adjectives = low.rlike(TWO_ADJECTIVES)
    steps = steps.withColumn("_description", F.least((TYPES.hits(held, "description") + long_ + F.when(adjectives, 0.5).otherwise(0.0) + F.when(F.col("_acts") == 0, 0.3).otherwise(0.0)) / 3, F.lit(1.0)))
    steps = steps.withColumn("_introspection", _introspection(t, TYPES.hits(held, "introspection", "thoughts"))).withColumn("_flashback", F.least(TYPES.hits(held, "flashback") / 2, F.lit(1.0)))
    names = ("action", "description", "introspection", "flashback")
    best = F.greatest(*[F.col(f"_{n}") for n in names])
    chosen = F.lit(names[-1])
    for n in reversed(names[:-1]):
        chosen = F.when(F.col(f"_{n}") == F.col("_best"), n).otherwise(chosen)
    told = F.struct(F.lit("narration").alias("type"), F.lit(0.7).alias("confidence"))
    spoken = F.struct(F.lit("dialogue").alias("type"), F.lit(0.9).alias("confidence"))
    result = F.when(T.is_dialogue(t), spoken).when(F.col("_best") < 0.3, told).otherwise(F.struct(chosen.alias("type"), F.col("_best").alias("confidence")))
    return steps.withColumn("_best", best).withColumn(out, result)


def distance(a: Column, b: Column) -> Column:
    """How far two emotions lie apart: 0, 0.3, 0.5, 0.7 or 1."""
    compatible = reduce(lambda x, y: x | y, [(a == k) & b.isin(*v) for k, v in COMPATIBLE.items()])
    opposed = reduce(lambda x, y: x | y, [((a == p) & (b == q)) | ((a == q) & (b == p)) for p, q in OPPOSITE])
    return F.when(a == b, 0.0).when(compatible, 0.3).when((a == "neutral") | (b == "neutral"), 0.5).when(opposed, 1.0).otherwise(0.7)


def transitions(df: DataFrame, partition: list[str], order: str) -> DataFrame:
    """from_emotion, transition, pause and speed of each segment against the one before it."""
    w = Window.partitionBy(*partition).orderBy(order)
    return moved(df.withColumn("from_emotion", F.lag("emotion").over(w)).withColumn("_from_intensity", F.lag("intensity").over(w)))


def moved(out: DataFrame) -> DataFrame:
    """transitions() of rows that hold from_emotion and _from_intensity, null at the first of a text."""
    out, d = out.withColumn("_distance", distance(F.col("from_emotion"), F.col("emotion"))), F.col("_distance")
    kind = (
        F.when(F.col("from_emotion").isNull(), "smooth")
        .when(F.col("_from_intensity").isin("high", "extreme") & F.col("intensity").isin("low", "medium") & F.col("emotion").isin("neutral", "tenderness"), "resolution")
        .when((F.col("intensity") == "extreme") & F.col("emotion").isin("fear", "anger", "excitement"), "dramatic")
        .when(d > 0.8, "sudden")
        .when(d > 0.4, "gradual")
        .otherwise("smooth")
    )
    out = out.withColumn("transition", kind)
    first = F.col("from_emotion").isNull()
    pause = F.when(first, 0.3).otherwise(T.lookup(F.col("transition"), TRANSITION_PAUSES, 0.3) * (1 + d * 0.5))
    speed = F.when(first, 1.0).when(F.col("transition") == "dramatic", 0.95).when(F.col("transition") == "resolution", 0.9).when(F.col("transition") == "sudden", 1.0).otherwise(T.lookup(F.col("emotion"), TRANSITION_SPEEDS, 1.0))
    return out.withColumn("pause", pause).withColumn("speed", speed).withColumn("from_emotion", F.coalesce("from_emotion", F.lit("neutral"))).drop("_from_intensity", "_distance")


def smoothed(df: DataFrame, partition: list[str], order: str, columns: list[str], factor: float = 0.3, speed: str | None = None) -> DataFrame:
    """Each column blended with the smoothed value of the row before, factor for the latter.

    speed: a column by which each result is multiplied before the next row sees it. A null value stays null and
    the next one begins anew. Rows are folded in order with one number a column as the state, so every factor is
    exact and a long partition needs no array of its rows.
    """

    def step(state: scans.State, part: pa.RecordBatch) -> tuple[scans.State, dict[str, pa.Array]]:
        before, new = list(state or [None] * len(columns)), {}
        by = part.column("_by").to_pylist()
        for i, c in enumerate(columns):
            now, out = before[i], []
            for x, m in zip(part.column(f"_x_{c}").to_pylist(), by, strict=True):
                now = None if x is None or m is None else (x if now is None else x * (1 - factor) + now * factor) * m
                out.append(now)
            before[i], new[f"{c}_smooth"] = now, pa.array(out, pa.float64())
        return before, new

    ready = df.withColumns({"_by": (F.col(speed) if speed else F.lit(1.0)).cast("double"), **{f"_x_{c}": F.col(c).cast("double") for c in columns}})
    done = scans.folded(ready, partition, [order], step, **{f"{c}_smooth": "double" for c in columns})
    return done.drop("_by", *[f"_x_{c}" for c in columns])


def blending(column: str, factor: float = 0.3) -> scans.Fold:
    """smoothed() of one column, for scans.laid."""

    def fold(now: float | None, batch: pa.RecordBatch, opens: np.ndarray) -> tuple[float | None, list[pa.Array]]:
        out = []
        for x, new in zip(batch.column(column).to_pylist(), opens.tolist(), strict=True):
            now = x if x is None or new or now is None else x * (1 - factor) + now * factor
            out.append(now)
        return now, [pa.array(out, pa.float64())]

    return fold


def continued(df: DataFrame, partition: list[str], order: str) -> DataFrame:
    """transitions(), with pause_before at least the transition's pause and a smoothed speed, pitch and volume.

    The speed is multiplied by the transition's speed before the next row sees it.
    """
    rows = transitions(df.withColumnRenamed("speed", "own_speed"), partition, order).withColumnRenamed("speed", "transition_speed")
    out = smoothed(rows, partition, order, ["own_speed"], speed="transition_speed")
    out = smoothed(out, partition, order, ["pitch", "volume"])
    return out.withColumn("pause_before", F.greatest("pause_before", "pause")).withColumnRenamed("own_speed_smooth", "speed_smooth").withColumnRenamed("own_speed", "speed")


def arc(df: DataFrame, partition: list[str], order: str) -> DataFrame:
    """Runs of one emotion: run, emotion, first row, duration."""
    w = Window.partitionBy(*partition).orderBy(order)
    new = F.coalesce((F.lag("emotion").over(w) != F.col("emotion")).cast("int"), F.lit(1))
    runs = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    return runs.groupBy(*partition, "run", "emotion").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("duration"))


def chapter_mood(df: DataFrame, partition: list[str], order: str, **totals: tuple[Column, Callable[[Column], Column]]) -> DataFrame:
    """dominant emotion of a chapter (the earliest of equals), its tone and base speed.

    With a column `intensity`, also the greatest of them and the number of climaxes, rows of extreme intensity;
    climaxes() lists those. totals: further columns, each an aggregate of the rows of one emotion and how these are put
    together, so that df is read once.
    """
    levels = F.array(*map(F.lit, LEVELS))
    if "intensity" in df.columns:
        at = F.max(F.array_position(levels, F.col("intensity")))
        totals = {"max_intensity": (at, lambda c: F.get(levels, (F.max(c) - 1).cast("int"))), "climaxes": (F.count_if(F.col("intensity") == "extreme"), F.sum), **totals}
    by = df.groupBy(*partition, "emotion").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"), *[c.alias(f"_{k}") for k, (c, _) in totals.items()])
    top = by.groupBy(*partition).agg(F.sum("_n").alias("segments"), F.max_by("emotion", F.struct("_n", -F.col("_first"))).alias("dominant"), *[join(F.col(f"_{k}")).alias(k) for k, (_, join) in totals.items()])
    tone = F.coalesce(F.create_map(*[F.lit(x) for kv in TONES.items() for x in kv])[F.col("dominant")], F.lit("mixte"))
    return top.withColumn("tone", tone).withColumn("base_speed", T.lookup(F.col("dominant"), BASE_SPEEDS, 1.0))


def climaxes(df: DataFrame, partition: list[str], order: str) -> DataFrame:
    """Position of each row of extreme intensity among the rows of its partition."""
    at = F.row_number().over(Window.partitionBy(*partition).orderBy(order)) - 1
    return df.withColumn("position", at).where("intensity = 'extreme'").select(*partition, "position")


def intensity_arc(df: DataFrame, partition: list[str], order: str, value: str = "intensity") -> DataFrame:
    """rising, falling or stable: whether the last intensity is over 0.2 above or below the first."""
    ends = df.groupBy(*partition).agg(F.min_by(F.coalesce(value, F.lit(0.5)), order).alias("first"), F.max_by(F.coalesce(value, F.lit(0.5)), order).alias("last"), F.count(F.lit(1)).alias("n"))
    arc = F.when(F.col("n") < 2, "stable").when(F.col("last") > F.col("first") + 0.2, "rising").when(F.col("last") < F.col("first") - 0.2, "falling").otherwise("stable")
    return ends.select(*partition, "n", arc.alias("arc"))


def mood_trend(df: DataFrame, partition: list[str], order: str) -> DataFrame:
    """improving, declining or stable by the last five emotions; stable until there are five."""
    w = Window.partitionBy(*partition).orderBy(order)
    last = w.rowsBetween(-4, 0)
    good = F.sum(F.col("emotion").isin("joy", "excitement", "tenderness").cast("int")).over(last)
    bad = F.sum(F.col("emotion").isin("sadness", "anger", "fear").cast("int")).over(last)
    return df.withColumn("trend", F.when(F.row_number().over(w) < 5, "stable").when(good > bad, "improving").when(bad > good, "declining").otherwise("stable"))
