"""Word-level markup: nesting, overlaps, tags without a partner, pauses, and curves that cover each sample once."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fablespark.operators import markup


def rows_of(spark, *texts, **options):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    out = {}
    for r in sorted(markup.words(frame, ["i"], **options).collect(), key=lambda r: (r.i, r.word_idx)):
        assert r.word_idx == len(out.setdefault(r.i, []))
        out[r.i].append(r)
    return [out.get(i, []) for i in range(len(texts))]


def test_words(spark):
    texts = [
        "un <em>deux trois</em> quatre",
        "<slow>a <em>b</em> c</slow>d",
        "<slow>a <loud>b</slow> c</loud> d",
        "<fast>never closed </em> here",
        "*x y* _z_ w_w",
        "<pitch high>a <pitch low>b</pitch> c</pitch>",
        "[pause] a[pause:0.5] <pause/> b",
        "Jamais, <slow>jamais</slow> or",
        "<SOFT>tout</Soft> bas",
        "<em></em>a",
        None,
        "",
        "2 < 3 [x] a<b",
    ]
    got = rows_of(spark, *texts)
    say = lambda i: [r.word for r in got[i]]
    assert say(0) == ["un", "deux", "trois", "quatre"]
    assert [(r.speed, r.pitch, r.volume, r.pause_before, r.is_emphasis) for r in got[0]] == [(1, 0, 1, 0, False), (0.92, 0.5, 1.1, 0.05, True), (0.92, 0.5, 1.1, 0, True), (1, 0, 1, 0, False)]
    assert say(1) == ["a", "b", "c", "d"] and [round(r.speed, 6) for r in got[1]] == [0.8, 0.736, 0.8, 1.0] and got[1][1].pause_before == 0.05
    assert [(r.speed, r.volume) for r in got[2]] == [(0.8, 1), (0.8, 1.3), (1, 1.3), (1, 1)]
    assert say(3) == ["<fast>never", "closed", "</em>", "here"] and {r.speed for r in got[3]} == {1.0}
    assert say(4) == ["x", "y", "z", "w_w"] and [r.is_emphasis for r in got[4]] == [True, True, True, False]
    assert [r.pitch for r in got[5]] == [2.0, 0.0, 2.0]
    assert [(r.word, round(r.pause_after, 6)) for r in got[6]] == [("a", 0.65), ("b", 0.0)]
    assert [(r.word, r.is_emphasis, r.speed) for r in got[7]] == [("Jamais,", True, 0.92), ("jamais", False, 0.8), ("or", True, 0.92)]
    assert [(r.word, r.is_whisper, r.volume) for r in got[8]] == [("tout", True, 0.6), ("bas", False, 1.0)]
    assert [(r.word, r.pause_before, r.speed) for r in got[9]] == [("a", 0.05, 1.0)]
    assert got[10] == got[11] == []
    assert say(12) == ["2", "<", "3", "[x]", "a<b"]
    [soft] = rows_of(spark, "jamais <em>oui</em>", auto=False, strength=2.0)
    assert [(r.is_emphasis, r.pitch) for r in soft] == [(False, 0.0), (True, 1.0)]


def by_stack(text):
    """Words and whether each kind holds there, by a walk with one stack a kind."""
    pieces = re.findall(r"</?(?:slow|loud)>|\s+|[^\s<]+|<", text)
    stacks, partner = {"slow": [], "loud": []}, set()
    for i, p in enumerate(pieces):
        if m := re.fullmatch(r"<(/?)(slow|loud)>", p):
            if not m[1]:
                stacks[m[2]].append(i)
            elif stacks[m[2]]:
                partner |= {i, stacks[m[2]].pop()}
    depth, out, glued = {"slow": 0, "loud": 0}, [], False
    for i, p in enumerate(pieces):
        m = re.fullmatch(r"<(/?)(slow|loud)>", p)
        if m and i in partner:
            depth[m[2]] += -1 if m[1] else 1
            glued = False
        elif p.isspace():
            glued = False
        elif glued:
            out[-1] = (out[-1][0] + p, *out[-1][1:])
        else:
            out.append((p, depth["slow"] > 0, depth["loud"] > 0))
            glued = True
    return out


def test_random_tags_match_a_stack(spark):
    r = random.Random(2)
    texts = ["".join(r.choice(["<slow>", "</slow>", "<loud>", "</loud>", "a", "bc", " ", " "]) for _ in range(r.randrange(25))) for _ in range(300)]
    got = [[(w.word, w.speed == 0.8, w.volume == 1.3) for w in rows] for rows in rows_of(spark, *texts, auto=False)]
    assert got == [by_stack(t) for t in texts]


def test_clean_text(spark):
    texts = ["un <em>deux</em>,  trois[pause] <fast>", "a\n*b*", None, "", "_"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert {r.i: r.clean for r in markup.clean_text(frame, ["i"]).collect()} == {0: "un deux,  trois <fast>", 1: "a\nb", 2: None, 3: "", 4: "_"}


def test_emphasised(spark):
    frame = spark.createDataFrame([("Le roi et la Reine. roi! roitelet a.b axb",)], "t string")
    assert frame.select(markup.emphasised("t", ["roi", "reine", "a.b"])).first()[0] == "Le <em>roi</em> et la <em>Reine</em>. <em>roi</em>! roitelet <em>a.b</em> axb"


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_curves(spark, block):
    texts = [(0, "a <slow>bbb</slow> <high>cc</high>", 30), (1, "", 5), (2, None, 3), (3, "x", 0), (4, "a " * 50, 7), (5, "abcdefghij <loud>k</loud>", 1000)]
    frame = spark.createDataFrame(texts, "i int, text string, samples int")
    words = markup.words(frame, ["i"])
    got = {}
    for r in sorted(markup.curves(frame, words, ["i"], block=block).collect(), key=lambda r: (r.i, r.block)):
        assert len(r.pitch) == len(r.volume) == len(r.speed) <= block
        assert len(got.setdefault(r.i, [])) == r.block * block
        got[r.i] += zip(r.pitch, r.volume, r.speed, strict=True)
    assert {i: len(v) for i, v in got.items()} == {i: n for i, _, n in texts if n}
    assert got[0] == [(0.0, 1.0, 1.0)] * 5 + [(0.0, 1.0, 0.8)] * 15 + [(2.0, 1.0, 1.0)] * 10
    assert set(got[1]) == set(got[2]) == {(0.0, 1.0, 1.0)}
    assert words.where(F.col("i") == 5).count() == 2 and sum(v == 1.3 for _, v, _ in got[5]) == 1000 - 1000 * 10 // 11
