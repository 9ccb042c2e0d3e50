"""WAV files to rows and back, in a temporary folder."""

import io
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from fablespark.sources import audio


def wav(frames, channels=1, width=2, rate=24000, seed=0):
    raw = np.random.default_rng(seed).integers(0, 256, frames * channels * width, dtype=np.uint8).tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(raw)
    return out.getvalue() + b"\0" * (len(raw) % 2)


def fixed(data):
    """With the RIFF size that counts the padding byte, as the format wants it."""
    return data[:4] + (len(data) - 8).to_bytes(4, "little") + data[8:]


@pytest.fixture
def folder(tmp_path):
    files = {"a.wav": wav(1000), "x/b.wav": wav(777, 2, 3, 44100, 1), "x/y/c.WAV": wav(5, 3, 4, 8000, 2), "d.wav": wav(0), "e.wav": wav(301, 1, 1, 8000, 3)}
    for name, data in files.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(fixed(data))
    (tmp_path / "in" / "_hidden.wav").write_bytes(b"x")
    (tmp_path / "in" / "notes.txt").write_text("no audio")
    return tmp_path, {k: fixed(v) for k, v in files.items()}


def found(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(root) for f in fs if not f.endswith(".crc")}


@pytest.mark.parametrize("block,part", [(65536, 1 << 25), (64, 500), (1, 97)])
def test_there_and_back(spark, folder, block, part):
    root, files = folder
    audio.register(spark)
    rows = spark.read.format("wav").option("blockFrames", block).option("partBytes", part).load(str(root / "in"))
    seen = rows.collect()
    assert len({(r.path, r.block) for r in seen}) == len(seen)
    assert {r.path for r in seen} == set(files) and all(len(r.samples) <= block * r.channels for r in seen)
    assert {(r.path, r.rate, r.channels, r.width, r.frames) for r in seen if r.path == "x/b.wav"} == {("x/b.wav", 44100, 2, 3, 777)}
    audio.write_wav(rows.repartition(7), str(root / "out"))
    assert found(root / "out") == files


def test_a_failed_task_leaves_no_files(spark, folder):
    root, _ = folder
    rows = audio.read_wav(spark, str(root / "in"), 100)
    bad = rows.withColumn("samples", F.when((F.col("path") == "x/b.wav") & (F.col("block") == 5), F.raise_error(F.lit("lost")).cast("array<int>")).otherwise(F.col("samples")))
    with pytest.raises(Exception, match="lost"):
        audio.write_wav(bad, str(root / "failed"))
    assert found(root / "failed") == {}


def test_broken_files(spark, folder):
    root, files = folder
    (root / "in" / "broken.wav").write_bytes(b"RIFF....JUNK")
    with pytest.raises(Exception, match="broken.wav"):
        audio.read_wav(spark, str(root / "in")).collect()
    assert {r.path for r in audio.read_wav(spark, str(root / "in"), skip_broken=True).collect()} == set(files)


def test_breath_samples(spark, tmp_path):
    def put(name, values, rate=24000, channels=1):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(np.array(values, "<i2").tobytes())

    put("soft/a.wav", [0, 1000, -2000, 500])
    put("deep/b.wav", [100, 300, -100, 300], channels=2)
    put("sigh/c.wav", [0, 100, 200, 300], rate=12000)
    put("gasp/d.wav", [0, 0])
    put("other/e.wav", [1, 2])
    (tmp_path / "soft" / "broken.wav").write_bytes(b"no")
    got = {(r.kind, r.path): r.samples for r in audio.breath_samples(spark, str(tmp_path)).collect()}
    assert set(got) == {("soft", "soft/a.wav"), ("deep", "deep/b.wav"), ("sigh", "sigh/c.wav"), ("gasp", "gasp/d.wav")}
    assert np.allclose(got["soft", "soft/a.wav"], [0, 0.5, -1, 0.25]) and np.allclose(got["deep", "deep/b.wav"], [1, 0.5])
    assert len(got["sigh", "sigh/c.wav"]) == 8 and np.allclose(got["sigh", "sigh/c.wav"][-1], 1) and got["gasp", "gasp/d.wav"] == [0, 0]


def test_pcm_and_names(spark):
    row = spark.createDataFrame([([0.0, 1.0, -1.0, 2.0, 0.5], 7)], "s array<double>, i int").select(audio.as_pcm("s").alias("two"), audio.as_pcm("s", 1).alias("one"), audio.segment_path("i").alias("p")).first()
    assert row.two == [0, 32767, -32767, 32767, 16384] and row.one == [128, 255, 1, 255, 192] and row.p == "segment_0007.wav"
