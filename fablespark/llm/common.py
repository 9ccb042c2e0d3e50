"""Shared pieces: staged tables, connected components and reading input tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000
BITS = 22


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is configured."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-fable-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def bounded(df: DataFrame) -> DataFrame:
    """df, its session set to Arrow batches of at most BATCH_ROWS rows.

    Rows hold whole texts, so a task's memory follows the rows of a batch; lower settings are kept.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(conf.get(name, "0"))
    if rows <= 0 or rows > BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def _hand_back() -> None:
    """Return what Arrow and the C library hold free to the system; a worker outlives its task and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema), with free memory handed back where a task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _hand_back()

    return df.mapInArrow(task, schema)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    The lineage ends there, so a lost executor costs a re-read and not the whole plan.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fable-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bit_table(df: DataFrame, column: str) -> np.ndarray:
    """Bits set at the long values of df[column], modulo 2^BITS: a table of a fixed size, however many rows there are."""
    at = df.select(F.pmod(column, F.lit(1 << BITS)).cast("int").alias("bit")).distinct().toArrow()["bit"].to_numpy()
    table = np.zeros(1 << BITS, bool)
    table[at] = True
    return np.packbits(table)


def maybe(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """False where a bit table excludes a value."""
    at = values % (1 << BITS)
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): rows (node, component), component the smallest node.

    Min-label propagation with pointer jumping. Labels only fall and stop falling when every
    edge joins equal labels, so the end state is exact; each round is one staged table.
    """
    both = staged(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")), "labels")
    while True:  # every round lowers a label, so the rounds end
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "component")
        lowest = seen.union(labels.select("node", "component")).groupBy("node").agg(F.min("component").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("further"))
        after = staged(
            lowest.join(jump, "low", "left")
            .select("node", F.least("low", F.coalesce("further", "low")).alias("component"))
            .join(labels.withColumnRenamed("component", "was"), "node"),
            "labels",
        )
        changed = after.where("component <> was").limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            return labels
