"""PCM audio files as a data source: format `wav`, read and written in blocks.

    audio.register(spark)
    rows = spark.read.format("wav").option("blockFrames", 65536).load(folder)
    audio.write_wav(rows, folder)

Rows are (path, block, frame, frames, rate, channels, width, samples): path relative to the folder, frames of the whole file,
samples interleaved as they are stored. A file is cut at PART_BYTES, so that one long file is read by many
tasks; each reads the header and then its own blocks. Writing streams a file's blocks from one
task into a file of a folder of the job, and files get their names when the whole job has
succeeded; a job that fails, or a task that is run again, leaves nothing under the final names.

Files are opened through pyarrow's file systems by URI. Edge cases: a file without frames is one row with no samples; chunks other than `fmt ` and `data` are passed over and not
written back; a data chunk longer than its file ends with the file; files that are no PCM of 8, 16, 24 or 32 bits are an error, or left out with the option `skipBroken`.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .staging import qualified

BLOCK_FRAMES = 1 << 16
PART_BYTES = 1 << 25
OPEN_BYTES = 1 << 15  # what opening a file costs, in bytes read
TASKS = 64
BATCH_SAMPLES, BATCH_BLOCKS = 1 << 20, 1 << 12  # most of a batch, beyond its first block
SCHEMA = "path string, block long, frame long, frames long, rate int, channels int, width int, samples array<int>"
BREATHS = ("soft", "sharp", "deep", "gasp", "sigh")  # fixed values: kinds of breath, each a folder


class NotPcm(ValueError):
    pass


@dataclass
class Header:
    rate: int
    channels: int
    width: int
    start: int  # of the data
    frames: int


def read_header(stream, size: int) -> Header:
    """The header of an open file of `size` bytes."""
    if size < 12 or (head := stream.read(12))[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise NotPcm("no RIFF WAVE file")
    at, form = 12, None
    while at + 8 <= size:
        stream.seek(at)
        name, length = struct.unpack("<4sI", stream.read(8))
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", stream.read(16))
            if kind not in (1, 0xFFFE) or bits not in (8, 16, 24, 32) or not channels:
                raise NotPcm(f"format {kind} of {bits} bits")
            form = rate, channels, bits // 8
        elif name == b"data":
            if form is None:
                raise NotPcm("data before its format")
            rate, channels, width = form
            return Header(rate, channels, width, at + 8, min(length, size - at - 8) // (width * channels))
        at += 8 + length + length % 2
    raise NotPcm("no data")


def header(rate: int, channels: int, width: int, frames: int) -> bytes:
    size = frames * channels * width
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size + size % 2, b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * width, channels * width, 8 * width, b"data", size)


def decoded(raw: bytes, width: int) -> np.ndarray:
    if width == 3:
        three = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((three[:, 2] << 24) | (three[:, 1] << 16) | (three[:, 0] << 8)) >> 8
    return np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.int32)


def encoded(samples: np.ndarray, width: int) -> bytes:
    if width == 3:
        return samples.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return samples.astype({1: np.uint8, 2: "<i2", 4: "<i4"}[width]).tobytes()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


@dataclass
class Part(InputPartition):
    file: str
    name: str
    size: int
    low: int
    high: int


@dataclass
class Parts(InputPartition):
    """What one task reads: a part of a long file, or many short files."""

    parts: list[Part]


def packed(parts: list[Part], limit: int) -> list[Parts]:
    """Neighbouring parts together up to `limit` bytes, a file counting for OPEN_BYTES at least; in some TASKS tasks where there are enough files."""
    cost = lambda p: max(min(p.high, p.size) - p.low, OPEN_BYTES)
    most = min(limit, sum(map(cost, parts)) // TASKS)
    out, held = [], 0
    for p in parts:
        if not out or held + cost(p) > most:
            out.append(Parts([]))
            held = 0
        out[-1].parts.append(p)
        held += cost(p)
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.block = int(options.get("blockframes", BLOCK_FRAMES))
        self.part = int(options.get("partbytes", PART_BYTES))
        self.lenient = str(options.get("skipbroken", "false")).lower() == "true"

    def partitions(self) -> list[Parts]:
        from pyarrow import fs

        files, root = _filesystem(self.root)
        found = [i for i in files.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.path.lower().endswith(".wav")]
        found = [i for i in found if not any(p.startswith(("_", ".")) for p in i.path[len(root) :].split("/"))]
        parts = [Part(i.path, i.path[len(root) :].lstrip("/"), i.size, low, low + self.part) for i in sorted(found, key=lambda i: i.path) for low in range(0, max(i.size, 1), self.part)]
        return packed(parts, self.part)

    def read(self, partition: Parts) -> Iterator[pa.RecordBatch]:
        files, _ = _filesystem(self.root)
        held, n = [], 0
        for part in partition.parts:
            for row, samples in self._blocks(files, part):
                if held and (n + len(samples) > BATCH_SAMPLES or len(held) == BATCH_BLOCKS):
                    yield self._batch(held)
                    held, n = [], 0
                held.append((row, samples))
                n += len(samples)
        if held:
            yield self._batch(held)

    def _batch(self, held: list[tuple[tuple, np.ndarray]]) -> pa.RecordBatch:
        rows, samples = zip(*held, strict=True)
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in samples]))).astype(np.int32)
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(samples)))
        return pa.RecordBatch.from_arrays([*columns, lists], ["path", "block", "frame", "frames", "rate", "channels", "width", "samples"])

    def _blocks(self, files, part: Part) -> Iterator[tuple[tuple, np.ndarray]]:
        with files.open_input_file(part.file) as stream:
            try:
                h = read_header(stream, part.size)
            except NotPcm as e:
                if self.lenient:
                    return
                raise NotPcm(f"{part.name}: {e}") from None
            size = h.width * h.channels
            # A block belongs to the part of the file in which it begins.
            step = self.block * size
            first, end = max(0, -(-(part.low - h.start) // step)), min(-(-h.frames // self.block) or 1, max(0, -(-(part.high - h.start) // step)))
            if not h.frames:
                first, end = 0, int(part.low == 0)
            for block in range(first, end):
                stream.seek(h.start + block * step)
                n = min(self.block, h.frames - block * self.block)
                yield (part.name, block, block * self.block, h.frames, h.rate, h.channels, h.width), decoded(stream.read(n * size), h.width)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # temporary, final


class _Writer(DataSourceArrowWriter):
    """Rows of one task come sorted by path and frame, all rows of a path in one task (see write_wav)."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, root = _filesystem(self.root)
        files.create_dir(f"{root}/{self.job}", recursive=True)
        done, current, stream, left, padded = [], None, None, 0, False

        def close() -> None:
            if left:
                raise ValueError(f"{current}: samples do not fill the frames that its rows name")
            if padded:
                stream.write(b"\0")
            stream.close()

        try:
            for batch in batches:
                samples = batch.column("samples")
                for i, row in enumerate(batch.drop_columns(["samples"]).to_pylist()):
                    if row["path"] != current:
                        if stream:
                            close()
                        current, temporary = row["path"], f"{root}/{self.job}/{uuid.uuid4().hex}"
                        done.append((temporary, f"{root}/{current}"))
                        stream = files.open_output_stream(temporary)
                        stream.write(header(row["rate"], row["channels"], row["width"], row["frames"]))
                        left = row["frames"] * row["channels"]
                        padded = left * row["width"] % 2 == 1
                    values = samples[i].values.to_numpy() if samples[i].values is not None else np.zeros(0, np.int32)
                    stream.write(encoded(values, row["width"]))
                    left -= len(values)
            if stream:
                close()
        finally:
            if stream and not stream.closed:
                stream.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _filesystem(self.root)
        moves = [pair for message in messages if message for pair in message.files]
        for folder in {final.rsplit("/", 1)[0] for _, final in moves}:
            files.create_dir(folder, recursive=True)
        for temporary, final in moves:
            files.move(temporary, final)
        self._clear(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_filesystem(self.root))

    def _clear(self, files, root: str) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.job}")


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavSource)


def read_wav(spark: SparkSession, folder: str, block_frames: int = BLOCK_FRAMES, skip_broken: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("wav").option("blockFrames", block_frames).option("skipBroken", skip_broken).load(qualified(spark, folder))


def write_wav(rows: DataFrame, folder: str) -> None:
    """One file for each path of rows(path, frame or block, rate, channels, width, samples)."""
    register(rows.sparkSession)
    order = "frame" if "frame" in rows.columns else "block"
    frames = rows.groupBy("path").agg((F.sum(F.coalesce(F.size("samples"), F.lit(0)) / F.col("channels"))).cast("long").alias("frames"))
    whole = rows.drop("frames").join(frames, "path").repartition("path").sortWithinPartitions("path", order)
    place = [F.col("block" if "block" in rows.columns else order).cast("long").alias("block"), F.col(order).cast("long").alias("frame")]
    whole.select("path", *place, "frames", *[F.col(c).cast("int").alias(c) for c in ("rate", "channels", "width")], "samples").write.format("wav").mode("append").save(qualified(rows.sparkSession, folder))


def segment_path(index: Column | str, extension: str = "wav") -> Column:
    """The name of a job's n-th segment."""
    return F.concat(F.lit("segment_"), F.lpad(F.col(index).cast("string") if isinstance(index, str) else index.cast("string"), 4, "0"), F.lit(f".{extension}"))


def as_pcm(samples: Column | str, width: int = 2) -> Column:
    """Samples between -1 and 1 as whole numbers of `width` bytes, cut at the ends; of one byte from 0 up."""
    top = (1 << (8 * width - 1)) - 1
    s = F.col(samples) if isinstance(samples, str) else samples
    return F.transform(s, lambda x: (F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * top) + (128 if width == 1 else 0)).cast("int"))


def mono(rows: DataFrame) -> DataFrame:
    """rows with samples between -1 and 1, the channels of a frame averaged."""
    scale = F.pow(F.lit(2.0), 8 * F.col("width") - 1)
    centred = lambda x: (x - F.when(F.col("width") == 1, 128).otherwise(0)) / scale
    frames = F.when(F.size("samples") > 0, F.sequence(F.lit(0), (F.size("samples") / F.col("channels")).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    mean = F.transform(frames, lambda i: F.aggregate(F.slice("samples", i * F.col("channels") + 1, F.col("channels")), F.lit(0.0), lambda a, x: a + centred(x)) / F.col("channels"))
    return rows.withColumn("samples", mean).withColumn("channels", F.lit(1))


def breath_samples(spark: SparkSession, folder: str, rate: int = 24000) -> DataFrame:
    """kind, path, samples of the breath clips under folder/<kind>/: mono, at `rate`, peak at 1; broken files are left out.

    Clips are seconds long, so each is one row.
    """
    from ..functions import signals as S

    rows = mono(read_wav(spark, folder, skip_broken=True).withColumn("kind", F.substring_index("path", "/", 1)).where(F.col("kind").isin(*BREATHS)))
    clips = rows.groupBy("kind", "path", "rate").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("frame", "samples"))), lambda z: z["samples"])).alias("samples"))
    size = F.floor(F.size("samples") * rate / F.col("rate")).cast("int")
    clips = clips.withColumn("samples", F.when((F.col("rate") == rate) | (size < 1), F.col("samples")).otherwise(S.resampled("samples", size)))
    return clips.select("kind", "path", S.peak_normalised("samples", 1.0).alias("samples"))
