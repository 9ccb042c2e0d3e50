"""The narration plan: from chapters to timed, voiced segments, as one chain of DataFrame steps.

A chapter's sentences come out of its row together and in order, and stay so: the order-dependent steps (transition,
smoothing, pauses, timeline) pass over them as they lie, without a shuffle or a sort. `directed` and `timed` take rows from
elsewhere, too, by windows that all partition by the same keys.
Speech itself is a function the caller supplies to `synthesise`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import emotion, scans, segments, tags, timeline

# Speed, pitch, pause before, pause after by emotion; suggested speed and pauses by narrative type.
PROSODY = {
    "neutral": (1.0, 0.0, 0.0, 0.0), "joy": (1.08, 0.2, 0.1, 0.2), "sadness": (0.88, -0.2, 0.3, 0.5), "anger": (1.1, 0.1, 0.1, 0.3), "fear": (1.12, 0.3, 0.2, 0.3),
    "surprise": (1.05, 0.4, 0.2, 0.3), "suspense": (0.9, -0.1, 0.3, 0.5), "tenderness": (0.92, -0.1, 0.2, 0.3), "excitement": (1.15, 0.3, 0.1, 0.2), "irony": (0.95, 0.1, 0.2, 0.3),
}
NARRATIVE = {"dialogue": (1.0, 0.2, 0.3), "narration": (1.0, 0.1, 0.3), "action": (1.08, 0.1, 0.2), "description": (0.95, 0.2, 0.4), "introspection": (0.92, 0.3, 0.4), "flashback": (0.88, 0.5, 0.5)}
SLOWEST, FASTEST = 0.7, 1.3


def _row(table: dict[str, tuple[float, ...]], key: Column, at: int) -> Column:
    return T.lookup(key, {k: v[at] for k, v in table.items()}, 1.0 if at == 0 else 0.0)


def intensity(text: Column | str) -> Column:
    """low, medium, high or extreme by exclamation marks, ellipses and words in capitals."""
    t = T.col(text)
    marks = F.length(t) - F.length(F.replace(t, F.lit("!")))
    caps = F.size(F.regexp_extract_all(t, F.lit(r"(?U)\b\p{Lu}{3,}\b"), F.lit(0)))
    score = marks + caps * 2 + t.contains("...").cast("int")
    return F.when(score >= 6, "extreme").when(score >= 3, "high").when(score >= 1, "medium").otherwise("low")


def analysed(chapters: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """A row a sentence: emotion, intensity, narrative type, contour, tag effects."""
    rows = segments.sentences(chapters, keys, text)
    rows = emotion.emotions_and_types(rows.select(*keys, "sent_idx", "sentence"), "sentence", "e", "n")
    return rows.select(
        *keys, "sent_idx", tags.spoken_text("sentence").alias("sentence"), F.col("e.emotion").alias("emotion"), F.col("e.confidence").alias("emotion_confidence"), intensity("sentence").alias("intensity"),
        F.col("n.type").alias("narrative"), F.col("n.confidence").alias("narrative_confidence"), T.contour("sentence", stripped=True).alias("contour"), tags.prosody("sentence").alias("tags"), (F.col("n.type") == "dialogue").alias("is_dialogue"),
    )


def directed(rows: DataFrame, keys: list[str], laid: bool = False) -> DataFrame:
    """Speed and pauses of each segment in the light of the one before and the one after; laid: rows lie by key and in order."""
    # What looks at no other row comes first, so that neither step makes a method too long to be compiled.
    rows = rows.withColumns(
        {
            "_speed": _row(PROSODY, F.col("emotion"), 0) * F.col("tags.speed"),
            "pause_before": F.greatest(_row(NARRATIVE, F.col("narrative"), 1), _row(PROSODY, F.col("emotion"), 2), F.col("tags.pause_before")),
            "pause_after": F.greatest(F.lit(0.3), _row(NARRATIVE, F.col("narrative"), 2), _row(PROSODY, F.col("emotion"), 3), F.col("tags.pause_after")),
        }
    )
    if laid:
        rows = scans.laid(rows, keys, "sent_idx", emotion.blending("_speed"), {"from_emotion": "emotion", "_from_intensity": "intensity"}, {"_following": "is_dialogue"}, _speed_smooth="double")
        rows = emotion.moved(rows)
    else:
        rows = emotion.smoothed(emotion.transitions(rows, keys, "sent_idx"), keys, "sent_idx", ["_speed"])
        rows = rows.withColumn("_following", F.lead("is_dialogue").over(Window.partitionBy(*keys).orderBy("sent_idx")))
    rows = rows.withColumnRenamed("pause", "transition_pause").withColumnRenamed("speed", "transition_speed")
    within = F.greatest(F.lit(SLOWEST), F.least(F.lit(FASTEST), F.col("_speed_smooth") * _row(NARRATIVE, F.col("narrative"), 0)))
    following = F.col("_following")
    after = F.greatest("pause_after", F.when(F.col("is_dialogue") | (following != F.col("is_dialogue")), 0.4).otherwise(0.0))
    return rows.withColumn("final_speed", within * F.col("transition_speed")).withColumn("pause_after", after).drop("_speed", "_speed_smooth", "_following")


def timed(rows: DataFrame, keys: list[str], laid: bool = False) -> DataFrame:
    """duration, start_time and end_time of each segment within its chapter."""
    rows = rows.withColumn("duration", F.length("sentence") / T.CHARS_PER_SECOND / F.col("final_speed"))
    rows = rows.withColumn("_step", F.col("pause_before") + F.col("duration") + F.col("pause_after"))
    rows = (timeline.laid_offsets if laid else timeline.offsets)(rows, keys, "sent_idx", "_step").drop("_step")
    return rows.withColumn("start_time", F.col("start_time") + F.col("pause_before")).withColumn("end_time", F.col("start_time") + F.col("duration"))


def narrated(chapters: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    return chapters.transform(analysed, keys, text).transform(directed, keys, True).transform(timed, keys, True)


def chapter_report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Segments, speaking time, mean speed and dominant emotion of each chapter, in one pass over its rows."""
    spoken = F.col("is_dialogue").cast("double")
    mood = emotion.chapter_mood(
        rows, keys, "sent_idx",
        spoken_seconds=(F.sum("duration"), F.sum), seconds=(F.max("end_time"), F.max),
        speeds=(F.sum("final_speed"), F.sum), n_speeds=(F.count("final_speed"), F.sum), said=(F.sum(spoken), F.sum), n_said=(F.count(spoken), F.sum),
    )
    means = mood.withColumns({"mean_speed": F.try_divide("speeds", "n_speeds"), "dialogue_share": F.try_divide("said", "n_said")})
    return means.select(*keys, "spoken_seconds", "seconds", "mean_speed", "dialogue_share", "segments", "dominant", "max_intensity", "climaxes", "tone", "base_speed")


def synthesise(rows: DataFrame, speak: Callable[[str, str, float], bytes], text: str = "sentence", voice: str = "voice", speed: str = "final_speed") -> DataFrame:
    """rows with `audio`: what speak(text, voice, speed) returns, once for each distinct request.

    Requests are keyed by cache key, so repeated lines are spoken once; a request that fails gives null.
    """
    keyed = rows.withColumn("cache_key", T.cache_key(text, voice, speed))
    requests = keyed.groupBy("cache_key").agg(F.first(text).alias("text"), F.first(voice).alias("voice"), F.first(speed).alias("speed"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            audio = []
            for request in batch.itertuples():
                try:
                    audio.append(speak(request.text, request.voice, request.speed))
                except Exception:  # the caller's model: one bad line must not lose the book
                    audio.append(None)
            yield pd.DataFrame({"cache_key": batch["cache_key"], "audio": audio})

    return keyed.join(requests.mapInPandas(run, "cache_key string, audio binary"), "cache_key", "left")
