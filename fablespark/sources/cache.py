"""An index of what has been synthesised, as a table of versions that many jobs write at once.

Every change is a folder of Parquet files of its own under `data`, and comes into force by a marker of one
row under `markers`, written last: a job that dies before that has changed nothing, and two jobs never touch the same
folder, so neither can lose the other's rows. A key's newest row counts (by version, then by change), whatever the order in which
changes are read. compact() writes all that counts as one change whose marker names those it replaces; a change that
came in meanwhile is not among them and stays in force.

Entries: key, voice_id, speed, path, created_at, size_bytes, duration, text_preview. Edge cases: an index without changes has no entries; null keys
are dropped; of rows of one change with one key the newest by created_at counts, then the greatest path.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import timeline

ENTRY = "key string, voice_id string, speed double, path string, created_at timestamp, size_bytes long, duration double, text_preview string"
ROW = f"{ENTRY}, removed boolean, version long"
MARKER = "change string, replaces array<string>"
PREVIEW = 50


def entry_columns(text: Column | str, voice: Column | str, speed: Column | str) -> list[Column]:
    """key, voice_id, speed and text_preview of a request."""
    return [T.cache_key(text, voice, speed).alias("key"), T.col(voice).alias("voice_id"), T.col(speed).cast("double").alias("speed"), F.substring(T.col(text), 1, PREVIEW).alias("text_preview")]


class CacheIndex:
    """The index in a folder that all executors see."""

    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], int] = time.time_ns):
        self.spark, self.folder, self.clock = spark, folder.rstrip("/"), clock

    def _changes(self) -> list[str]:
        """Changes in force: as many as have come since the last compaction."""
        try:
            markers = self.spark.read.schema(MARKER).option("recursiveFileLookup", "true").parquet(f"{self.folder}/markers").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        replaced = {c for m in markers for c in m["replaces"] or ()}
        return sorted(m["change"] for m in markers if m["change"] not in replaced)

    def _change(self, rows: DataFrame, replaces: list[str]) -> str:
        change = uuid.uuid4().hex
        rows.withColumn("change", F.lit(change)).write.parquet(f"{self.folder}/data/{change}")
        self.spark.createDataFrame([(change, replaces)], MARKER).coalesce(1).write.parquet(f"{self.folder}/markers/{change}")
        return change

    def _rows(self, changes: list[str]) -> DataFrame:
        """The row of each key that counts, removals included."""
        schema = f"{ROW}, change string"
        if not changes:
            return self.spark.createDataFrame([], schema).drop("change")
        rows = self.spark.read.schema(schema).parquet(*[f"{self.folder}/data/{c}" for c in changes])
        columns = [c.split()[0] for c in ROW.split(", ")]
        newest = rows.groupBy("key").agg(F.max_by(F.struct(*columns), F.struct("version", "change", "created_at", "path")).alias("r"))
        return newest.select("r.*")

    def entries(self) -> DataFrame:
        """All entries in force."""
        return self._rows(self._changes()).where("not removed").drop("removed", "version")

    def put(self, entries: DataFrame) -> None:
        """Entries added, or replaced where the key is there."""
        names = [c.split()[0] for c in ENTRY.split(", ")]
        rows = entries.where("key is not null").select(*[F.col(n).cast(t) for n, t in (c.split() for c in ENTRY.split(", "))])
        self._change(rows.select(*names, F.lit(False).alias("removed"), F.lit(self.clock()).cast("long").alias("version")), [])

    def remove(self, keys: DataFrame) -> None:
        """Keys taken out; a later put brings them back."""
        gone = keys.where("key is not null").select("key").distinct()
        none = [F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in ENTRY.split(", ")[1:])]
        self._change(gone.select("key", *none, F.lit(True).alias("removed"), F.lit(self.clock()).cast("long").alias("version")), [])

    def clear(self) -> None:
        """No entry is left of the changes in force now."""
        self._change(self.spark.createDataFrame([], ROW), self._changes())

    def compact(self) -> None:
        """The changes in force as one; removals stay in it, as a slower job's older put may still come."""
        changes = self._changes()
        self._change(self._rows(changes), changes)

    def looked_up(self, requests: DataFrame, files: DataFrame | None = None) -> DataFrame:
        """requests(key) with path, null for a miss; files(path): those that exist, without which an entry is stale."""
        entries = self.entries().select("key", F.col("path").alias("path"))
        if files is not None:
            entries = entries.join(files.select("path").distinct(), "path", "left_semi").select("key", "path")
        return requests.drop("path").join(entries, "key", "left")

    def drop_stale(self, files: DataFrame, requests: DataFrame | None = None) -> None:
        """Takes out the entries whose file is gone; with requests, only those that were asked for."""
        stale = self.entries().join(files.select("path").distinct(), "path", "left_anti")
        self.remove(stale if requests is None else stale.join(requests.select("key").distinct(), "key", "left_semi"))

    def evict(self, max_bytes: int, max_entries: int) -> DataFrame:
        """Takes out the oldest entries until 80 % of both limits hold; the rows taken out, for their files to go."""
        from .staging import staged

        old = staged(timeline.evicted(self.entries(), max_bytes, max_entries), "evicted")
        self.remove(old)
        return old

    def stats(self, answers: DataFrame | None = None) -> DataFrame:
        """entries, size_mb, and hits and misses of looked_up() answers."""
        size = self.entries().agg(F.count(F.lit(1)).alias("entries"), (F.coalesce(F.sum("size_bytes"), F.lit(0)) / (1024 * 1024)).alias("size_mb"))
        if answers is None:
            return size.select("*", F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("misses"))
        counted = answers.agg(F.count("path").alias("hits"), F.count_if(F.col("path").isNull()).alias("misses"))
        return size.crossJoin(counted)  # one row each
