"""Scripts against a line-by-line walk, and prosody of styles by hand."""

import random
import re

import pytest

from fablespark.functions import prosody as P
from fablespark.operators import conversation as C
from pyspark.sql import functions as F

PATTERNS = [r"^([A-Z][A-Z\s]+):\s*(.+)$", r"^([A-Za-z][A-Za-z\s]+):\s*(.+)$", r"^\*\*([^*:]+):?\*\*:?\s*(.+)$", r"^([A-Z][A-Z\s]+)\.\s*[-–]\s*(.+)$", r"^\(([^)]+)\)\s*(.+)$"]


def walked(text):
    raw = text.strip().split("\n")
    if not any(re.match(p, x.strip()) for x in raw[:20] for p in PATTERNS):
        quotes = [m.strip() for p in (r'[«"]([^»"]+)[»"]', r'"([^"]+)"', r"'([^']+)'") for m in re.findall(p, text) if len(m.strip()) > 5]
        return [("SPEAKER", q) for q in quotes] or [("NARRATOR", text)]
    out, who, held = [], None, []
    for line in [x.strip() for x in raw] + [""]:
        m = next(filter(None, (re.match(p, line) for p in PATTERNS)), None)
        if (not line or m) and who and held:
            out.append((who, " ".join(held)))
            held = []
        if m:
            who, held = m[1].strip(), [m[2].strip()]
        elif line and who:
            held.append(line)
    return out


def test_lines(spark):
    r = random.Random(3)
    bits = ["MARIE: oui", "**Paul:** non", "**Paul**: si", "HUGO. - bon", "(Anna) viens", "Jean le Grand: là", "et la suite", "", "encore", "X:", "  "]
    texts = ["\n".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(200)]
    texts += ['Il dit « bonjour à tous » puis "au revoir" et \'encore un mot\'.', "Rien du tout.", "", "\n" * 25 + "suite\n" * 21 + "MARIE: trop tard", "JEAN: d'abord\n" + "suite\n" * 30]
    frame = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, text string").repartition(3)
    got = {}
    for x in sorted(C.lines(frame, ["i"]).collect(), key=lambda x: (x.i, x.line_idx)):
        assert x.line_idx == len(got.setdefault(x.i, []))
        got[x.i].append((x.speaker, x.line))
    for i, t in enumerate(texts):
        assert got.get(i, []) == walked(t), t
    assert -1 not in got


def test_formats(spark):
    texts = ["JEAN: a", "Jean: a", "**Jean:** a", "JEAN. - a", "(Jean) a", "rien", "", None, "x\n\n(Y) z", "\n".join(["x"] * 20 + ["JEAN: a"])]
    got = spark.createDataFrame([*enumerate(texts)], "i int, t string").select("i", C.script_format("t").alias("f")).orderBy("i").collect()
    assert [x.f for x in got] == ["script", "script_lower", "markdown", "theatre", "parentheses", "unknown", "unknown", None, "parentheses", "unknown"]


def test_moods_and_directions(spark):
    rows = ["[Sad] [angry] non (il part) [vite]", "rien", "(a)(b)  c", "[whispers]", "[cheerful", "[](x)"]
    frame = spark.createDataFrame([*enumerate(rows)], "i int, t string")
    got = frame.select("i", C.mood("t"), C.without_mood("t"), C.directions("t"), C.without_directions(C.without_mood("t"))).orderBy("i").collect()
    assert [tuple(x)[1:] for x in got] == [("sad", "non (il part) [vite]", "il part; vite", "non"), (None, "rien", "", "rien"), (None, "(a)(b)  c", "a; b", "c"), ("whispers", "", "", ""), (None, "[cheerful", "", "[cheerful"), (None, "[](x)", "x", "[]")]


def test_conversation(spark):
    text = "LEA: oui\nMAX: [angry] non (il sort)\nKIM: bof\nZOE: si\nLEA: encore"
    config = spark.createDataFrame([("LEA", "female", None, 1.1, None), ("MAX", "male", "own", None, 2.0), ("MAX", None, None, None, None), ("ZOE", "robot", None, None, None)], C.CONFIG)
    frame = spark.createDataFrame([(1, text), (2, "KIM: a\nLEA: b")], "i int, text string")
    got = {(x.i, x.line_idx): x for x in C.conversation(frame, ["i"], config).collect()}
    assert [(got[1, j].speaker, got[1, j].voice) for j in range(5)] == [("LEA", "ff_siwis"), ("MAX", "own"), ("KIM", "ff_sophie"), ("ZOE", "fm_hugo"), ("LEA", "ff_siwis")]
    assert (got[1, 1].emotion, got[1, 1].direction, got[1, 1].text, got[1, 1].pitch_shift, got[1, 0].speed) == ("angry", "il sort", "non", 2.0, 1.1)
    assert [(got[2, j].voice) for j in range(2)] == ["fm_hugo", "ff_siwis"]
    [stats] = C.statistics(C.conversation(frame.where("i = 1"), ["i"], config), ["i"]).collect()
    assert (stats.lines, stats.participants, stats.words) == (5, 4, 5) and [tuple(s) for s in stats.by_speaker][:2] == [("LEA", 2), ("MAX", 1)]


def test_styles(spark):
    one = spark.range(2000).select(F.col("id"))
    rows = one.select("id", P.styled(F.lit("dramatic"), F.lit(1.0), F.lit(0.0), F.lit(1.0), F.col("id")).alias("p"), P.style_pause(F.lit("dramatic"), F.lit("formal")).alias("s"), P.humanised_pause(F.lit(0.5), F.col("id")).alias("h")).collect()
    speeds, pauses = [r.p.speed for r in rows], [r.h for r in rows]
    assert 0.80 <= min(speeds) < 0.83 and 1.01 < max(speeds) <= 1.04 and abs(sum(speeds) / len(speeds) - 0.92) < 0.01
    assert all(0.425 <= p <= 0.575 for p in pauses) and abs(sum(pauses) / len(pauses) - 0.5) < 0.003
    assert abs((sum((p / 0.5 - 1) ** 2 for p in pauses) / len(pauses)) ** 0.5 - 0.05) < 0.005
    assert rows[0].s == pytest.approx(0.5 * 2 * 1.2)
    flat = spark.range(1).select(P.styled(F.lit("formal"), F.lit(2.0), F.lit(9.0), F.lit(0.1), F.lit(1)).alias("p"), P.humanised_pause(F.lit(-1.0), F.lit(1)).alias("n"), P.exaggerated(F.lit(0.5), F.lit("sad"), 2.0).alias("e")).first()
    assert tuple(flat.p) == (1.5, 3.0, 0.3) and flat.n == -1.0 and flat.e.speed == pytest.approx(1.05 - 0.16) and flat.e.pitch == pytest.approx(0.2 - 0.3)


def test_emphasis_pauses(spark):
    texts = ["Jamais il ne vit rien.", "mais mais mais", "un  jamais, « Soudain » orage or", "", "\tjamais"]
    want = ["Jamais il ne vit  [pause:0.05]rien.", "mais  [pause:0.05]mais  [pause:0.05]mais", "un   [pause:0.05]jamais, «  [pause:0.05]Soudain » orage  [pause:0.05]or", "", "\t [pause:0.05]jamais"]
    got = spark.createDataFrame([*enumerate(texts)], "i int, t string").select("i", P.emphasis_pauses("t").alias("p")).orderBy("i").collect()
    assert [x.p for x in got] == want


def test_extended_plan(spark):
    from fablespark.functions import text as T
    from fablespark.operators import breaths
    from fablespark.plans import extended, narration

    told = "Il marchait dans la nuit. Soudain un bruit étrange ! « Qui va là ? » Rien, jamais rien ne répondit. [whispers] Il avait peur... API. " * 5
    chapters = spark.createDataFrame([(1, told), (2, "Fin."), (3, "")], "c int, content string")
    entries = spark.createDataFrame([("API", "A P I")], "key string, replacement string")
    got = {(r.c, r.sent_idx): r for r in extended.extended(chapters, ["c"], entries=entries).collect()}
    base = narration.narrated(chapters.withColumn("content", F.regexp_replace("content", "API", "A P I")), ["c"])
    plain = {(r.c, r.sent_idx): r for r in base.collect()}
    assert got.keys() == plain.keys() and {c for c, _ in got} == {1, 2}
    markers = {(r.c, r.sent_idx): r.breath_before for r in breaths.breath_markers(base.withColumn("words", T.word_count("sentence")), ["c"], "sent_idx").collect()}
    for k, r in got.items():
        p = plain[k]
        assert (r.sentence, r.emotion, r.final_speed, r.start_time) == (p.sentence, p.emotion, p.final_speed, p.start_time)
        assert r.breath_before == markers[k] and r.has_emphasis == ("[pause:0.05]" in r.spoken) and r.clause in T.CLAUSE_SPEEDS
        assert 0.85 * p.pause_before - 1e-9 <= r.human_before <= 1.15 * p.pause_before + 1e-9 and 0.5 <= r.speed <= 1.5
        assert r.voice == "ff_siwis" or r.voice.startswith("ff_siwis:")
    assert any(r.has_emphasis for r in got.values()) and any(r.breath_before for r in got.values()) and any("A P I" in r.sentence for r in got.values())
    assert {r.style for r in extended.extended(chapters, ["c"], style="formal").collect()} == {"formal"}
