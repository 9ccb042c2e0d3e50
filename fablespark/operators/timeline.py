"""Order-dependent arithmetic: pauses, offsets, timelines, cache eviction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scans

GAP = 0.3


def offsets(df: DataFrame, partition: list[str], order: str, duration: str, start: str = "start_time") -> DataFrame:
    """Start of each row: the sum of the durations before it."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(start, F.coalesce(F.sum(duration).over(w), F.lit(0).cast(df.schema[duration].dataType)))


def laid_offsets(df: DataFrame, partition: list[str], order: str, duration: str, start: str = "start_time") -> DataFrame:
    """offsets() of rows that lie by partition and in order (see scans.laid); the duration is a double."""

    def fold(total: float | None, batch: pa.RecordBatch, opens: np.ndarray) -> tuple[float, list[pa.Array]]:
        steps, total, out = pc.fill_null(batch.column(duration), 0.0).to_pylist(), total or 0.0, []
        for step, new in zip(steps, opens.tolist(), strict=True):
            total = 0.0 if new else total
            out.append(total)
            total += step
        return total, [pa.array(out, pa.float64())]

    return scans.laid(df, partition, order, fold, **{start: "double"})


def conversation_timeline(lines: DataFrame, partition: list[str], order: str, gap: float = GAP) -> DataFrame:
    """start_time and end_time of lines with a pause after each; a pause of 0 takes the gap."""
    spaced = lines.withColumn("_step", F.col("duration") + F.coalesce(F.nullif("pause_after", F.lit(0.0)), F.lit(gap)))
    return offsets(spaced, partition, order, "_step").withColumn("end_time", F.col("start_time") + F.col("duration")).drop("_step")


def segment_pauses(df: DataFrame, partition: list[str], order: str, sentence: float = 0.3, dialogue: float = 0.4) -> DataFrame:
    """pause_after of each segment, longer for speech and where the next speaker is another."""
    following = F.lead("speaker").over(Window.partitionBy(*partition).orderBy(order))
    return df.withColumn("pause_after", F.greatest(F.lit(sentence), F.when(F.col("is_dialogue") | (following != F.col("speaker")), dialogue).otherwise(0.0)))


def evicted(entries: DataFrame, max_bytes: int, max_entries: int) -> DataFrame:
    """Cache entries to remove, oldest first, until 80 % of both limits hold; none while within them.

    The running sums need one global order, so they are made in two steps: sums by creation day,
    then sums within a day from that day's offset. No task sees more than one day or the list of days.
    """
    day = F.to_date("created_at")
    by_day = entries.groupBy(day.alias("day")).agg(F.sum("size_bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    days = by_day.select(
        "day",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.sum("bytes").over(every).alias("all_bytes"),
        F.sum("n").over(every).alias("all_n"),
    )
    own = Window.partitionBy("day").orderBy("created_at", "key").rowsBetween(Window.unboundedPreceding, -1)
    rows = entries.withColumn("day", day).join(days, "day")
    rows = rows.withColumn("_bytes", F.col("bytes_before") + F.coalesce(F.sum("size_bytes").over(own), F.lit(0))).withColumn("_n", F.col("n_before") + F.coalesce(F.count(F.lit(1)).over(own), F.lit(0)))
    full = (F.col("all_bytes") > max_bytes) | (F.col("all_n") > max_entries)
    over = (F.col("all_bytes") - F.col("_bytes") > max_bytes * 0.8) | (F.col("all_n") - F.col("_n") > int(max_entries * 0.8))
    return rows.where(full & over).select(*entries.columns)


def podcast(segments: DataFrame, keys: list[str], section: str, order: str, intro: float = 0.0, jingle: float | None = None) -> DataFrame:
    """segments(start_time, end_time within their section) moved to their place in the whole.

    Half a second follows the intro and a second each section; sections after the first start after the jingle and 0.3 seconds.
    """
    ends = segments.groupBy(*keys, section).agg(F.max_by("end_time", order).alias("_end"))
    w = Window.partitionBy(*keys).orderBy(section)
    before = F.coalesce(F.sum(F.col("_end") + 1.0).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    step = 0.0 if jingle is None else jingle + 0.3
    start = (intro + 0.5 if intro else 0.0) + before + (F.row_number().over(w) - 1) * step
    placed = segments.join(ends.select(*keys, section, start.alias("_start")), [*keys, section])
    return placed.withColumn("start_time", F.col("start_time") + F.col("_start")).withColumn("end_time", F.col("end_time") + F.col("_start")).drop("_start")


def mixed(placed: DataFrame, keys: list[str], at: str, samples: str) -> DataFrame:
    """Signals laid over each other: rows (keys, position, value), a signal's samples added from position `at` on."""
    rows = placed.select(*keys, F.col(at).alias("_at"), F.posexplode(samples).alias("_i", "_x"))
    return rows.groupBy(*keys, (F.col("_at") + F.col("_i")).alias("position")).agg(F.sum("_x").alias("value"))


def running(df: DataFrame, partition: list[str], order: str, value: str, out: str, span: int = 1 << 16) -> DataFrame:
    """`out`: sums of `value` over the rows before each one, for partitions too large for one task.

    order must be a whole number. Sums by ranges of `span` give each range its start, so that no task
    sorts more than one range of a partition.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / span))
    before = Window.partitionBy(*partition).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*partition, "_range").agg(F.sum(value).alias("_sum")).select(*partition, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(*partition, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(starts, [*partition, "_range"]).withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(own), F.lit(0))).drop("_range", "_start")
