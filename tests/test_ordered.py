"""Breaths, previews and noise against plain loops."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fablespark.operators import breaths, preview, scans, waves


def threshold(*key, mean=20):
    share = int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:8], 16) / 2**32
    return int(mean * (0.7 + (1.3 - 0.7) * share))


def sentences(n, seed):
    r = random.Random(seed)
    return [(i, r.choice([0, 1, 3, 5, 8, 12, 20, 21, 40]), r.choice(["joy", "fear", "neutral", None]), r.choice(["low", "medium", "high", None])) for i in range(n)]


ROWS = {"a": sentences(500, 1), "b": sentences(3, 2), "c": [(0, None, None, None)], "d": [(7, 30, "joy", "high")], "e": sentences(130, 3)}


def frame(spark):
    rows = [(k, *row, "x") for k, v in ROWS.items() for row in v]
    random.Random(4).shuffle(rows)
    return spark.createDataFrame(rows, "key string, i long, words int, emotion string, intensity string, breath string").repartition(5)


def markers(key, rows):
    said, limit, out = 0, threshold(key, "start"), {}
    for n, (i, words, emotion, intensity) in enumerate(rows):
        said += words or 0
        need = False
        if n and intensity in ("high", "extreme") and emotion and rows[n - 1][2] and rows[n - 1][2] != emotion:
            need = True
        if said > limit:
            need, said, limit = True, 0, threshold(key, i)
        out[i] = need or (emotion in ("suspense", "fear") and intensity not in ("low", None))
    return out


def pauses(key, rows):
    said, limit, out = 0, threshold(key, "start"), {}
    for i, words, *_ in rows:
        out[i] = None
        if said > limit:
            out[i] = "deep" if said > limit * 1.5 else "soft"
            said, limit = 0, threshold(key, i)
        said += words or 0
    return out


@pytest.mark.parametrize("run,span", [(2048, 512), (7, 3), (1, 2)])
def test_breaths(spark, monkeypatch, run, span):
    monkeypatch.setattr(breaths, "RUN", run)
    monkeypatch.setattr(scans, "SPAN", span)
    got = {(r.key, r.i): r for r in breaths.breath_markers(frame(spark), ["key"], "i").collect()}
    rests = {(r.key, r.i): r.breath for r in breaths.breath_pauses(frame(spark), ["key"], "i").collect()}
    assert len(got) == len(rests) == sum(map(len, ROWS.values()))
    for key, rows in ROWS.items():
        assert {i: got[key, i].breath_before for i, *_ in rows} == markers(key, rows)
        assert {i: rests[key, i] for i, *_ in rows} == pauses(key, rows)
    assert {"soft", "deep", None} == set(rests.values())
    assert got["a", 5].words == ROWS["a"][5][1] and got["a", 5].breath == "x"


def test_breaths_of_nothing(spark):
    assert breaths.breath_markers(frame(spark).limit(0), ["key"], "i").collect() == []


def by_hand(text, target):
    paras = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    if not paras:
        return text[:target]
    rest, size = paras[1:], lambda s: sum(map(len, s))
    chosen = paras[:1]
    spoken = next((p for p in rest if re.search(r'[«"].*?[»"]', p) or re.search(r"[-–—]\s*.+", p)), None)
    if spoken and size(chosen) + len(spoken) < target:
        chosen.append(spoken)
    score = lambda p: sum(w in p.lower() for w in ("soudain", "cria", "terrible", "rit")) + p.count("!") * 0.5 + p.count("...") * 0.3
    best = max(rest, key=score, default=None)
    if best and score(best) > 0 and size(chosen) + len(best) < target and best not in chosen:
        chosen.append(best)
    if size(chosen) < target * 0.7:
        for p in rest:
            if p not in chosen:
                if size(chosen) + len(p) >= target:
                    break
                chosen.append(p)
    whole = "\n\n".join(chosen)
    if len(whole) <= target:
        return whole
    cut = whole[:target]
    stop = max(map(cut.rfind, ".!?"))
    return cut[: stop + 1] if stop > target * 0.5 else cut


def test_preview(spark):
    r = random.Random(9)
    pieces = ["Il pleut.", "« Viens », dit Marie.", "Soudain il cria ! Terrible...", "Un mot", "a" * 90, "b. " * 40, "- Oui.", "Elle rit et repart sans un mot de plus.", "Fin ?"]
    texts = ["", "  \n\n ", "un seul", "x" * 500, "y. " * 200, pieces[4] + "\n\n" + pieces[0] + "\n\n" + pieces[0]]
    texts += ["\n\n".join(r.choice(pieces) for _ in range(r.randrange(1, 14))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for target in (60, 200, 450):
        got = {r.i: r.p for r in rows.select("i", preview.preview("t", "fr", target).alias("p")).collect()}
        assert got == {i: by_hand(t, target) for i, t in enumerate(texts)}
    assert spark.createDataFrame([(None,)], "t string").select(preview.preview("t")).first()[0] is None


def test_noise_blocks_fit(spark):
    """The same samples whole and in blocks of any size; power falls by 3 dB an octave."""
    k, n = F.lit("k"), 1 << 14
    make = lambda f, size: np.concatenate([r.x for r in spark.range(n // size).orderBy("id").select(f(k, F.col("id") * size, F.lit(size)).alias("x")).collect()])
    pink = make(waves.pink_noise, n)
    assert (pink == make(waves.pink_noise, 64)).all() and (make(waves.white_noise, n) == make(waves.white_noise, 128)).all()
    assert abs(np.sqrt((pink**2).mean()) * np.sqrt(3) - 1) < 0.2
    every = [r.x for r in spark.range(12).select(waves.pink_noise(F.col("id"), F.lit(0), F.lit(n)).alias("x")).collect()]
    power = sum(np.abs(np.fft.rfft(np.array(x) * np.hanning(n))) ** 2 for x in every)
    level = np.array([10 * np.log10(power[n >> (j + 1) : n >> j].mean()) for j in range(1, 11)])  # octaves, from the highest down
    fit = np.polyfit(np.arange(len(level)), level, 1)
    assert abs(fit[0] - 3.0) < 0.3 and np.abs(level - np.polyval(fit, np.arange(len(level)))).max() < 1.0
    assert spark.range(1).select(waves.pink_noise(k, F.lit(0), F.lit(0)).alias("x")).first().x == []
    other = np.array(spark.range(1).select(waves.white_noise(F.lit("j"), F.lit(0), F.lit(n)).alias("x")).first().x)
    assert abs(np.corrcoef(other, make(waves.white_noise, n))[0, 1]) < 0.05


def test_breath_sounds(spark):
    from fablespark.functions import breath_sounds as B

    rate = 2400
    k = F.lit("key")
    one = spark.range(1)
    draw = lambda i: (int(hashlib.md5(f"key:-1:{i}".encode()).hexdigest()[:8], 16) / 2**31 - 1) * 3**0.5
    share = int(hashlib.md5(b"key:length").hexdigest()[:8], 16) / 2**32
    shapes = {"soft": lambda t: np.sin(np.pi * t) ** 2, "sharp": lambda t: t**0.5 * (1 - t) ** 4 * 5, "deep": lambda t: t**2 * (1 - t) ** 0.5 * 2, "gasp": lambda t: np.exp(-5 * t) * (1 - np.exp(-20 * t)) * 3, "sigh": lambda t: t**0.3 * np.exp(-2 * t) * 2.5}
    for kind, shape in shapes.items():
        got = np.array(one.select(B.breath(k, kind, 0.2, 0.7, rate)).first()[0])
        n, width = int(0.2 * (0.9 + 0.2 * share) * rate), max(1, round(B.KINDS[kind][1] / 10))
        raw = np.array([draw(i) for i in range(n)]) * shape(np.linspace(0, 1, n)) * B.KINDS[kind][0] * 0.7
        assert np.allclose(got, np.convolve(raw, np.ones(width) / width, mode="same"), atol=1e-12)
    tone, click, still = one.select(B.room_tone(k, 0.05, rate), B.click(k, rate), B.unsteady(B.room_tone(k, 0.3, rate, 1.0), k, 0.1, 20.0, rate)).first()
    assert len(tone) == 120 and abs(np.std(tone) - 1e-4) < 2e-5 and 24 <= len(click) <= 72 and abs(click[0]) < 1e-12
    ratio = np.array(still) / np.array([draw(i) for i in range(720)])
    assert abs(np.abs(ratio - 1).max() - 0.1) < 1e-9 and np.abs(np.diff(ratio)).max() < 0.02
    assert one.select(B.tag_sound(F.lit(" Pause "), k, rate=100)).first()[0][:1] != [] and one.select(B.tag_sound(F.lit("door"), k)).first()[0] is None
    a, b = [1.0] * 6, [0.0, 0.0, 0.0, 2.0]
    mixed = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(B.crossfade_squared("a", "b", 3), B.crossfade_squared("a", "b", 5)).first()
    assert np.allclose(mixed[0], [1, 1, 1, 1, 0.5, 0, 2]) and mixed[1] == a + b
