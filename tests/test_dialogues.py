"""Dialogue in running text against plain walks over it."""

import random
import re

from fablespark.operators import dialogues

QUOTE = r'(«[^»]+»|"[^"]+"|“[^”]+”)'
bare = lambda q: re.sub('^[«»"“”\\s]+|[«»"“”\\s]+$', "", q)


def runs(text):
    out, last = [], 0
    for m in re.finditer(QUOTE, text):
        out += [(text[last : m.start()].strip(), False), (bare(m[0]), True)]
        last = m.end()
    return [r for r in [*out, (text[last:].strip(), False)] if r[0]]


def by_lines(text):
    out, held = [], []
    for line in [x.strip() for x in text.split("\n") if x.strip()]:
        if m := re.match(r"^[—–\-]\s*(.+)$", line):
            out += [*runs(" ".join(held)), (m[1].strip(), True)]
            held = []
        else:
            held.append(line)
    return [r for r in out + runs(" ".join(held)) if r[0]]


def in_context(text):
    return [(bare(m[0]), f"{text[max(0, m.start() - 100) : m.start()]} {text[m.end() : m.end() + 100]}") for m in re.finditer(QUOTE, text)]


def texts():
    r = random.Random(7)
    bits = ["— ", "-", "\n", "\n", " ", "« oui »", '"non"', "“bon”", "«", '"', "”", "mot ", "une phrase assez longue pour le dire. ", "é"]
    fixed = ["", "rien", "— Bonjour !\nIl entra.\n« Salut », dit Paul.\n- Oui.\n—\n", '"a" "b"', "« sans fin", "x" * 300 + "«q»" + "y" * 300, "— « cité » ici"]
    return fixed + ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(200)]


def test_dashed_and_quotes(spark):
    frame = spark.createDataFrame([*enumerate(texts()), (-1, None)], "i int, text string").repartition(3)
    lines, found = {}, {}
    for r in sorted(dialogues.dashed(frame, ["i"]).collect(), key=lambda r: (r.i, r.seg_idx)):
        lines.setdefault(r.i, []).append((r.segment, r.is_dialogue))
    for r in sorted(dialogues.quotes(frame, ["i"]).collect(), key=lambda r: (r.i, r.quote_idx)):
        found.setdefault(r.i, []).append((r.quote, r.context))
    for i, t in enumerate(texts()):
        assert lines.get(i, []) == by_lines(t)
        assert found.get(i, []) == in_context(t)
    assert -1 not in lines and -1 not in found


def test_speakers(spark):
    told = [
        (1, 0, "« A », fit-elle."), (1, 1, "« B », dit Marie."), (1, 2, "« C »"), (1, 3, "« D », demanda-t-il."), (1, 4, "« E », murmura Paul."), (1, 5, "« F »"), (1, 6, "« G »"),
        (1, 7, "« H », cria-t-elle."), (1, 8, "Hugo dit « I »"), (1, 9, "« J »"), (1, 10, "« K », ajouta-t-il."), (2, 0, "« seul »"), (2, 1, "« elle répond », dit le roi."),
    ]
    rows = dialogues.quotes(spark.createDataFrame(told, "c int, turn int, text string").repartition(4), ["c", "turn"])
    got = {(r.c, r.turn): (r.speaker, r.method, r.confidence) for r in dialogues.attributed(rows, ["c"], ["turn", "quote_idx"]).collect()}
    assert got[1, 0][:2] == ("UNKNOWN", "unknown") and got[1, 1] == ("Marie", "explicit", 0.95) and got[1, 2] == ("Marie", "context", 0.4)
    assert got[1, 3][:2] == ("[M]", "pronoun") and abs(got[1, 3][2] - 0.56) < 1e-9 and got[1, 4][0] == "Paul"
    assert [got[1, i][:2] for i in (5, 6)] == [("Marie", "alternation"), ("Paul", "alternation")]
    assert got[1, 7][:2] == ("Marie", "pronoun") and abs(got[1, 7][2] - 0.72) < 1e-9
    assert got[1, 8] == ("Hugo", "explicit", 0.9) and got[1, 9][:2] == ("Marie", "alternation") and got[1, 10][0] == "Paul"
    assert got[2, 0][0] == got[2, 1][0] == "UNKNOWN"


def test_narrated(spark):
    text = "Il pleuvait. « Viens », dit Marie. « Non », et la nuit tomba sur la ville. « Si »"
    frame = spark.createDataFrame([(1, text), (2, "Rien."), (3, None), (4, ""), (5, "« A » « B »")], "i int, text string")
    got = {}
    for r in sorted(dialogues.narrated(frame, ["i"]).collect(), key=lambda r: (r.i, r.seg_idx)):
        got.setdefault(r.i, []).append((r.segment, r.speaker, r.is_dialogue))
    assert got[1] == [("Il pleuvait.", "NARRATOR", False), ("Viens", "Marie", True), ("Non", "Marie", True), ("et la nuit tomba sur la ville", "NARRATOR", False), ("Si", "Marie", True)]
    assert got[2] == [("Rien.", "NARRATOR", False)] and got[5] == [("A", "UNKNOWN", True), ("B", "UNKNOWN", True)] and 3 not in got and 4 not in got
