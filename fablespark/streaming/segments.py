"""Segments as a stream: windowed counts with a watermark, and mood that follows each character."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GOOD, BAD = {"joy", "excitement", "tenderness"}, {"sadness", "anger", "fear"}
RUN = 5


def emotion_counts(rows: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Segments by window and emotion; rows later than `late` are left out, state behind it is dropped."""
    return (
        rows.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("w"), "emotion")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "emotion", "n")
    )


def mood_changes(rows: DataFrame, key: str, order: str) -> DataFrame:
    """A row whenever a character's trend over the last five emotions changes.

    State is five emotions and one word a key, and leaves after a day without news. Within a
    micro-batch, rows are taken in order; between batches, as they come.
    """

    def follow(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent, trend = state.get if state.exists else ("", "stable")
        recent, out = recent.split() if recent else [], []
        for row in pd.concat(list(batches)).sort_values(order).itertuples():
            recent = [*recent, row.emotion][-RUN:]
            good, bad = sum(e in GOOD for e in recent), sum(e in BAD for e in recent)
            now = "stable" if len(recent) < RUN or good == bad else "improving" if good > bad else "declining"
            if now != trend:
                out.append((name[0], getattr(row, order), now))
                trend = now
        state.update((" ".join(recent), trend))
        state.setTimeoutDuration(24 * 3600 * 1000)
        yield pd.DataFrame(out, columns=[key, order, "trend"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.groupBy(key).applyInPandasWithState(follow, f"{key} {kinds[key]}, {order} {kinds[order]}, trend string", "recent string, trend string", "append", GroupStateTimeout.ProcessingTimeTimeout)
