"""Long signals in blocks against plain loops over the whole signal."""

import math

import numpy as np
import pytest

from fablespark.operators import scans, waves

BLOCKS = "key string, block long, samples array<double>"


def cut(signals, size):
    rows = []
    for key, x in signals.items():
        rows += [(key, 3 * i, [float(v) for v in x[a : a + size]]) for i, a in enumerate(range(0, len(x), size))]
    return rows


def whole(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.key or "", r.block)):
        out.setdefault(r.key, []).extend(r.samples or [])
    return {k: np.array(v) for k, v in out.items()}


def by_loop(section, x, state=(0.0, 0.0)):
    b0, b1, b2, a1, a2 = section
    s0, s1 = state
    out = []
    for v in x:
        y = b0 * v + s0
        s0, s1 = b1 * v - a1 * y + s1, b2 * v - a2 * y
        out.append(y)
    return np.array(out)


def both_ways(section, x):
    if len(x) <= 9:
        return np.array(x)
    x = np.concatenate((2 * x[0] - x[9:0:-1], x, 2 * x[-1] - x[-2:-11:-1]))
    b0, b1, b2, a1, a2 = section
    # a constant 1 in gives a constant g out; the state that keeps it so
    g = (b0 + b1 + b2) / (1 + a1 + a2)
    rest = np.array([g - b0, b2 - a2 * g])
    y = by_loop(section, x, rest * x[0])
    return by_loop(section, y[::-1], rest * y[-1])[::-1][9:-9]


SIGNALS = {None: np.sin(np.arange(400) / 7), "a": np.random.default_rng(1).normal(size=1000), "b": np.arange(10.0), "c": np.ones(9), "d": np.array([1.0])}
SECTIONS = [waves.peak_section(24000, 3000, 2.0, 1.5), waves.high_shelf_section(24000, 10000, 1.0), waves.high_pass_section(24000, 80)]


@pytest.mark.parametrize("size", [1, 7, 64, 5000])
def test_filters_do_not_depend_on_blocks(spark, size, monkeypatch):
    monkeypatch.setattr(scans, "SPAN", 5)
    rows = spark.createDataFrame(cut(SIGNALS, size), BLOCKS).repartition(3)
    section = SECTIONS[0]
    got, both = whole(waves.filtered(rows, ["key"], section)), whole(waves.zero_phase(rows, ["key"], section))
    for key, x in SIGNALS.items():
        assert np.allclose(got[key], by_loop(section, x), atol=1e-9)
        assert np.allclose(both[key], both_ways(section, x), atol=1e-9)


@pytest.mark.parametrize("section", SECTIONS[1:])
def test_zero_phase_sections(spark, section):
    got = whole(waves.zero_phase(spark.createDataFrame(cut(SIGNALS, 100), BLOCKS), ["key"], section))
    for key, x in SIGNALS.items():
        assert np.allclose(got[key], both_ways(section, x), atol=1e-8)


def test_a_million_samples(spark):
    """One signal over many tasks, in blocks of 4,096."""
    rows = spark.range(250, numPartitions=16).selectExpr("'k' key", "id block", "transform(sequence(0, 3999), i -> sin((id * 4000 + i) / 5D) + cos((id * 4000 + i) / 301D)) samples")
    t = np.arange(1_000_000)
    x = np.sin(t / 5) + np.cos(t / 301)
    got = whole(waves.peak_eq(rows, ["key"], 24000, 3000, 6.0))["k"]
    assert np.allclose(got, both_ways(waves.peak_section(24000, 3000, 6.0), x), atol=1e-7)


def test_voice_eq_gains(spark):
    """Low tones go, tones at the presence rise by twice its gain (both ways), others stay."""
    tone = lambda hz: np.sin(2 * math.pi * hz * np.arange(12000) / 24000)
    got = whole(waves.voice_eq(spark.createDataFrame(cut({str(hz): tone(hz) for hz in (20, 500, 3000)}, 1000), BLOCKS), ["key"]))
    level = lambda x: 20 * math.log10(np.sqrt((x[2000:-2000] ** 2).mean()) * math.sqrt(2))
    assert level(got["20"]) < -40 and abs(level(got["500"])) < 0.2 and abs(level(got["3000"]) - 4.0) < 0.2


def compressed_by_loop(x, rate, threshold_db, ratio, attack_ms, release_ms):
    threshold, e, out = 10 ** (threshold_db / 20), 0.0, []
    up, down = (math.exp(-1 / int(ms * rate / 1000)) if int(ms * rate / 1000) else 0.0 for ms in (attack_ms, release_ms))
    for v in x:
        c = up if abs(v) > e else down
        e = c * e + (1 - c) * abs(v)
        out.append(v * (threshold + (e - threshold) / ratio) / e if e > threshold else v)
    return np.array(out)


@pytest.mark.parametrize("size,attack", [(1, 10.0), (33, 0.0), (10_000, 10.0)])
def test_compressor(spark, size, attack):
    rows = spark.createDataFrame(cut(SIGNALS, size), BLOCKS).repartition(3)
    got = whole(waves.compressed(rows, ["key"], attack_ms=attack))
    for key, x in SIGNALS.items():
        assert np.allclose(got[key], compressed_by_loop(x, 24000, -18.0, 3.0, attack, 100.0), atol=1e-12)


def test_edge_blocks(spark):
    rows = spark.createDataFrame([("k", 0, None), ("k", 1, []), ("k", 2, [0.5, None, 0.5] * 8), ("k", 4, []), ("z", 0, None)], BLOCKS)
    for out in (waves.compressed(rows, ["key"]), waves.zero_phase(rows, ["key"], SECTIONS[0]), waves.filtered(rows, ["key"], SECTIONS[0])):
        got = {(r.key, r.block): r.samples for r in out.collect()}
        assert got["k", 0] is None and got["z", 0] is None and got["k", 1] == [] and len(got["k", 2]) == 24 and len(got) == 5
    none = spark.createDataFrame([], BLOCKS)
    assert waves.voice_eq(none, ["key"]).collect() == [] and waves.compressed(none, ["key"]).collect() == []


def silences_by_loop(x, rate, threshold, fade):
    x, out = np.array(x), np.array(x, float)
    n, reach = len(x), int(fade * rate)
    curve = lambda k: (1 - np.cos(np.linspace(0, 1, k) * np.pi)) / 2
    turn = np.diff((np.abs(x) < threshold).astype(int))
    for s in np.where(turn == 1)[0]:
        if s > reach:
            end = min(s + reach, n)
            out[s:end] *= 1 - curve(end - s)
    for e in np.where(turn == -1)[0]:
        if e < n - reach:
            start = max(e - reach, 0)
            out[start:e] *= curve(e - start)
    return out


@pytest.mark.parametrize("size,cut_at", [(12, 7), (40, 1000), (1 << 14, 50)])
def test_softened_silences(spark, size, cut_at):
    rng = np.random.default_rng(9)
    signals = {k: np.where(np.repeat(rng.random(60) < 0.5, 10), rng.normal(0, 0.002, 600), rng.normal(0, 0.5, 600))[: 600 - 7 * i] for i, k in enumerate(("a", "b", None))}
    signals |= {"quiet": np.zeros(30), "short": np.array([0.5, 0.0, 0.5])}
    got = whole(waves.softened_silences(spark.createDataFrame(cut(signals, cut_at), BLOCKS).repartition(3), ["key"], 1000, 0.01, 0.01, size))
    for key, x in signals.items():
        assert np.allclose(got[key], silences_by_loop(x, 1000, 0.01, 0.01), atol=1e-12)


@pytest.mark.parametrize("size", [1, 7, 5000])
def test_reblocked(spark, size, monkeypatch):
    monkeypatch.setattr(scans, "SPAN", 4)
    rows = spark.createDataFrame([*cut(SIGNALS, 13), ("empty", 0, []), ("empty", 1, None), ("a", 1, [])], BLOCKS)
    out = waves.reblocked(rows, ["key"], size).collect()
    blocks = {}
    for r in out:
        blocks.setdefault(r.key, {})[r.block] = r.samples
    assert blocks.keys() == SIGNALS.keys()
    for key, x in SIGNALS.items():
        assert sorted(blocks[key]) == list(range(-(-len(x) // size)))
        assert np.allclose(np.concatenate([blocks[key][b] for b in sorted(blocks[key])]), x) and all(len(blocks[key][b]) == size for b in sorted(blocks[key])[:-1])


def test_processed(spark):
    x = np.sin(np.arange(3000) / 9) * 0.9
    got = whole(waves.processed(spark.createDataFrame(cut({"k": x}, 500), BLOCKS), ["key"]))["k"]
    want = x
    for section in (waves.high_pass_section(24000, 80), waves.peak_section(24000, 3000, 2.0, 1.5), waves.high_shelf_section(24000, 10000, 1.0)):
        want = both_ways(section, want)
    assert np.allclose(got, np.clip(compressed_by_loop(want, 24000, -18.0, 3.0, 10.0, 100.0), -0.95, 0.95), atol=1e-7)
