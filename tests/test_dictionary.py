"""Dictionary rewriting against a plain search at every place, by broadcast and by join."""

import random
import re

import pytest

from fablespark.operators import dictionary

ENTRIES = [("roi", "ROY", None), ("le roi", "KING", None), ("le roi soleil", "SUN", None), ("Paris", "paname", True), ("paris", "PARIS", True), ("%", " pourcent", None), ("n°", "numéro", None), ("etc.", "et cetera", None), ("été", "summer", None), ("a.b", "dot", None), ("", "never", None), (None, "never", None), ("x", None, None), ("roi", "ZZZ", None)]
TEXTS = ["Le roi Soleil et le ROI, leroi roi2", "Paris paris PARIS", "5% n°5 n° 5 n°", "etc. etc.x etc., etc", "Été étés a.b a.bc", "", None, "x-x xx", "le roi soleilx le roi", "le  roi"]
ORDER = {k: i for i, (k, *_) in enumerate(ENTRIES)}


def by_hand(text, closing):
    """At each place the longest key that fits, tried one by one."""
    entries = sorted({(k, r or "", bool(e)) for k, r, e in ENTRIES if k}, key=lambda e: (-len(re.findall(r"\w+|\W", e[0])), not e[2], e[1], e[0]))
    out, i, n = "", 0, 0
    while i < len(text):
        for key, new, exact in entries:
            part, end = text[i : i + len(key)], i + len(key)
            if (part != key) if exact else (part.lower() != key.lower()):
                continue
            if re.match(r"\w", key[0]) and i and re.match(r"\w", text[i - 1]) or re.match(r"\w", key[-1]) and end < len(text) and re.match(r"\w", text[end]):
                continue
            if closing and key[-1] in ".°" and end < len(text) and not re.match(r"[\s,;:!?]", text[end]):
                continue
            out, i, n = out + new, end, n + 1
            break
        else:
            out, i = out + text[i], i + 1
    return out, n


@pytest.mark.parametrize("most", [0, 1 << 20])
@pytest.mark.parametrize("closing", [False, True])
def test_rewritten(spark, most, closing):
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice(["le", "roi", "soleil", "Paris", " ", " ", "%", "n°", "etc.", "été", ",", "x"]) for _ in range(r.randrange(30))) for _ in range(200)]
    frame = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(500, texts[0], "c")], "i int, text string, phrase string").repartition(3)
    entries = spark.createDataFrame(ENTRIES, "key string, replacement string, exact boolean")
    got = {r.i: r for r in dictionary.rewritten(frame, entries, closing=closing, most=most).collect()}
    assert len(got) == len(texts) + 1 and got[0].text == got[500].text and got[0].phrase == "c"
    for i, t in enumerate(texts):
        assert (got[i].text, got[i].n_replaced) == ((None, 0) if t is None else by_hand(t, closing))


@pytest.mark.parametrize("most", [0, 1 << 30])
def test_many_keys(spark, most):
    """100,000 keys: the plan has as many nodes as for one."""
    keys = spark.range(100_000).selectExpr("concat('w', id, if(id % 7 = 0, ' tail', '')) key", "concat('<', id, '>') replacement")
    frame = spark.range(300).selectExpr("id i", "concat('w', id * 331, ' tail w', id * 331, ' x') text")
    got = {r.i: r.text for r in dictionary.rewritten(frame, keys, most=most).collect()}
    assert got == {i: (f"<{i * 331}> w{i * 331} x" if i * 331 % 7 == 0 else f"<{i * 331}> tail <{i * 331}> x") for i in range(300)}
    one = dictionary.rewritten(frame, keys.limit(1), most=most)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert plan(dictionary.rewritten(frame, keys, most=most)) <= plan(one) + 2


def test_phonemes(spark):
    custom = spark.createDataFrame([("Seine", "sɛn"), ("seine", "zz")], "word string, ipa string")
    builtin = spark.createDataFrame([("paris", "paʁi"), ("Lyon", "ljɔ̃"), ("seine", "no")], "word string, ipa string")
    words = spark.createDataFrame([(w,) for w in ("SEINE", "Paris", "paris", "Lyon", "lyon", "x", None)], "word string")
    assert {r.word: r.ipa for r in dictionary.phonemes(words, custom, builtin).collect()} == {"SEINE": "sɛn", "Paris": "paʁi", "paris": "paʁi", "Lyon": "ljɔ̃", "lyon": None, "x": None, None: None}
    text = spark.createDataFrame([("La Seine, Paris et Lyon (lyon).",)], "text string")
    assert dictionary.rewritten(text, dictionary.merged_phonemes(custom, builtin)).first().text == "La sèn, pari et ljon (lyon)."
