"""Golden values for text, number and signal functions, accents included."""

import pytest
from pyspark.sql import functions as F

from fablespark.functions import numbers as N
from fablespark.functions import signals as S
from fablespark.functions import text as T
from fablespark.operators import compliance, emotion, tags


def values(spark, rows, kind, *columns):
    return [r[0] if len(columns) == 1 else tuple(r) for r in spark.createDataFrame([(r,) for r in rows], f"x {kind}").coalesce(1).select(*columns).collect()]


def test_sentences_and_clauses(spark):
    got = values(spark, ["Un. Deux ! Trois ? fin", "", None, "  ...  "], "string", T.sentences("x"))
    assert got == [["Un.", "Deux !", "Trois ?", "fin"], [], None, ["..."]]
    assert values(spark, ["Oui; non! Peut-être"], "string", T.clauses("x")) == [["Oui;", "non!", "Peut-être"]]
    assert values(spark, ["a  b c", " ", ""], "string", T.word_count("x")) == [3, 0, 0]


@pytest.mark.parametrize("text,want", [("Où es-tu ?", "question_wh"), ("Tu viens ?", "question_yn"), ("Non !", "exclamation"), ("Et puis...", "suspense"), ("Il vint,", "continuation"), ("Il vint mais", "continuation"), ("Il vint.", "declarative"), ("été", "declarative"), ("", "neutral"), ("(x)", "neutral")])
def test_contour(spark, text, want):
    assert values(spark, [text], "string", T.contour("x")) == [want]


@pytest.mark.parametrize("text,want", [("« Oui »", "quote"), ("(dit-il)", "parenthetical"), ("– un aparté –", "parenthetical"), ("— un aparté —", "quote"), ("Parce que oui", "subordinate"), ("Où il vit", "subordinate"), ("Il ne vint jamais", "emphasis"), ("Il vint", "main")])
def test_clause_type(spark, text, want):
    assert values(spark, [text], "string", T.clause_type("x")) == [want]


def test_pack_is_greedy(spark):
    got = spark.range(1).select(T.pack(F.array(*map(F.lit, ["aa", "bbb", "c", "dddddddddd", "e"])), 6)).first()[0]
    assert got == ["aa bbb", "c", "dddddddddd", "e"]


def test_markdown_and_html(spark):
    assert values(spark, ["# T\n\n**gras** et [lien](u) `code`\n- un\n\n\n\n> cité"], "string", T.plain_markdown("x")) == ["T\n\ngras et lien code\nun\n\ncité"]
    page = "<h1> Titre </h1><style>p{}</style><script>var a='</p>';</script><p>Un&nbsp;<b>deux</b></p>"
    assert values(spark, [page], "string", T.html_title("x"), T.html_text("x")) == [("Titre", "Titre Un&nbsp; deux")]
    assert values(spark, ["A**b**<"], "string", T.markdown_to_html("x")) == ["A<strong>b</strong>&lt;"]


def test_numbers(spark):
    french = {0: "zéro", 16: "seize", 21: "vingt-et-un", 71: "soixante-onze", 80: "quatre-vingts", 81: "quatre-vingt-un", 91: "quatre-vingt-onze", 100: "cent", 200: "deux cents", 201: "deux cent un", 1000: "mille", 2024: "deux mille vingt-quatre", 1_000_000: "un million", 3_000_000_000: "trois milliards", -5: "moins cinq"}
    assert values(spark, list(french), "long", N.in_words("x")) == list(french.values())
    english = {13: "thirteen", 42: "forty-two", 999: "nine hundred ninety-nine", 1001: "one thousand one", 2_000_000: "two million"}
    assert values(spark, list(english), "long", N.in_words("x", "en")) == list(english.values())
    assert values(spark, ["2024-05-01", "1999-12-31"], "string", N.date_in_words(F.to_date("x"))) == ["premier mai deux mille vingt-quatre", "trente-et-un décembre mille neuf cent quatre-vingt-dix-neuf"]
    assert values(spark, [1.0, 2.5, 0.01], "double", N.money_in_words("x")) == ["un euro", "deux euros et cinquante centimes", "zéro euro et un centime"]
    assert values(spark, ["XIV", "mcmxcix", "CD"], "string", T.roman_value("x")) == [14, 1999, 400]


def test_emotion(spark):
    got = values(spark, ["La joie et le rire", "peur et joie", "rien"], "string", emotion.keyword_emotion("x"))
    assert [(r.emotion, round(r.confidence, 3)) for r in got] == [("joy", 0.667), ("joy", 0.333), ("neutral", 0.5)]
    told = spark.createDataFrame([("« Oui »",), ("He said nothing of it to me in the end at all.",), ("Run! Jump! Hit!",)], "x string")
    assert [r.type for r in emotion.narrative_types(told, "x", "n").select("n.type").collect()] == ["dialogue", "narration", "action"]


def test_tags(spark):
    got = values(spark, ["[Mad] x [pause]", "[unknown]", "[excited][excited][excited][excited]"], "string", tags.prosody("x"))
    assert [tuple(round(v, 3) for v in r) for r in got] == [(1.1, 1.2, 0.2, 0.0, 0.5), (1.0, 1.0, 0.0, 0.0, 0.0), (1.5, 1.464, 1.0, 0.0, 0.0)]
    assert values(spark, ["a [mad] b [laugh] c [odd]"], "string", tags.spoken_text("x")) == ["a b [laugh] c [odd]"]


def test_rules(spark):
    rules = [{"pattern": "b", "replacement": "c", "ord": 2}, {"pattern": "(A)", "replacement": "\\1b", "flags": ["IGNORECASE"], "ord": 1}]
    assert values(spark, ["xax"], "string", compliance.rewritten(F.col("x"), rules)) == ["xacx"]


def test_signals(spark):
    one = [1.0] * 6
    assert values(spark, [one], "array<double>", S.fade_in("x", 3, "linear"), S.fade_out("x", 3, "linear")) == [([0.0, 0.5, 1.0, 1.0, 1.0, 1.0], [1.0, 1.0, 1.0, 1.0, 0.5, 0.0])]
    assert values(spark, [one], "array<double>", S.crossfade("x", "x", 2, curve="linear"), S.crossfade("x", "x", 2, least=9)) == [([1.0] * 10, [1.0] * 12)]
    assert values(spark, [[0.0, 0.5, -2.0, 0.0]], "array<double>", S.limited("x"), S.trimmed("x"), S.peak_normalised("x")) == [([0.0, 0.5, -0.95, 0.0], [0.5, -2.0], [0.0, 0.225, -0.9, 0.0])]
    assert values(spark, [[]], "array<double>", S.fade_in("x", 3), S.trimmed("x")) == [([], [])]
    assert spark.range(1).select(F.size(S.silence(F.lit(0.5), 100))).first()[0] == 50


def test_normalised_text(spark):
    from fablespark.functions import normalize

    pairs = {
        "Le 25/12/2024, il etait 14h30.": "Le vingt-cinq decembre deux mille vingt-quatre, il etait quatorze heures trente.",
        "Le 01/13/1999 a 01:00": "Le premier treize mille neuf cent quatre-vingt-dix-neuf a un heure",
        "Mon tel: 06 12 34 56 78": "Mon tel: six douze trente-quatre cinquante-six soixante-dix-huit",
        "Chapitre III: Louis XIV au XVIIe siecle, mil": "Chapitre trois: Louis quatorze au dix-septieme siecle, mil",
        "Il a couru 42,195 km en 3 h": "Il a couru quarante-deux virgule un neuf cinq kilometres en trois heures",
        "85% puis 7,5 %": "quatre-vingt-cinq pourcent puis sept virgule cinq pourcent",
        "$12.50, €1 ou 3€": "douze dollars et cinquante centimes, un euro ou trois euros",
        "Voir https://a.b/c?d et moi@ex.co.uk !": "Voir lien internet et moi arobase ex point co point uk !",
        "M. Dupont et Mme Martin, etc.": "Monsieur Dupont et Madame Martin, et cetera",
        "1er, 2eme & #tag": "premier, deuxieme et tag",
        "# Titre\nil y a 1 234,5 pas": "Titre il y a mille deux cent trente-quatre virgule cinq pas",
        "1984": "cent quatre-vingt-dix-huitquatre",
        "": "",
    }
    rows = spark.createDataFrame(list(pairs.items()), "text string, want string")
    got = normalize.normalized(rows, "text", "fr").collect()
    assert [r.text for r in got] == [r.want for r in got]


def test_lexicon_intensity(spark):
    from fablespark.operators import lexicon

    pairs = {"calme": "low", "quoi ?": "medium", "tres bien !": "high", "NON !! tres tres BIEN": "extreme", "un jour, un...": "medium"}
    rows = spark.createDataFrame(list(pairs.items()), "text string, want string").withColumn("got", lexicon.lexicon_intensity("text")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def chunks_by_force(text, limit):
    """The same cuts in plain Python: paragraphs, sentences, clauses, commas."""
    import re

    def fold(parts, joiner):
        out, open_ = [], ""
        for p in parts:
            joined = open_ + joiner + p if open_ else p
            if len(joined) <= limit:
                open_ = joined
            else:
                out += [open_] if open_ else []
                open_ = p
        return out + ([open_] if open_ else [])

    def clauses(sentence):
        out, open_ = [], ""
        for part in re.split(r"([;:])\s*", sentence):
            if part in (";", ":"):
                open_ += part
                continue
            joined = f"{open_} {part}" if open_ else part
            if len(joined) <= limit:
                open_ = joined
                continue
            out += [open_] if open_ else []
            cut = fold(re.split(r",\s*", part), ", ") if len(part) > limit else [part]
            out, open_ = out + cut[:-1], cut[-1]
        return out + ([open_] if open_ else [])

    out = []
    for p in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
        if len(p) <= limit:
            out.append(p)
            continue
        open_ = ""
        for s in filter(None, map(str.strip, re.split(r"(?<=[.!?])\s+", p))):
            if len(s) > limit:
                out += [open_] if open_ else []
                open_, out = "", out + clauses(s)
            elif len(joined := f"{open_} {s}" if open_ else s) <= limit:
                open_ = joined
            else:
                out += [open_] if open_ else []
                open_ = s
        out += [open_] if open_ else []
    return [c.strip() for c in out]


def test_hierarchical_chunks(spark):
    import random

    from fablespark.operators import chunking

    r = random.Random(4)
    texts = ["", "court.", "a, b; c: d. " * 5, ";; a ;", "x" * 90 + ", " + "y" * 90 + "; z"]
    texts += ["".join(r.choice(["mot ", "long, ", "fin. ", "oui! ", "soit; ", "car: ", "\n\n", "tres "]) for _ in range(r.randint(1, 80))) for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for row in chunking.chunks(rows, ["id"], 40).orderBy("id", "chunk_idx").collect():
        got.setdefault(row.id, []).append(row.chunk)
    assert [got.get(i, []) for i in range(len(texts))] == [chunks_by_force(t, 40) for t in texts]


def test_plain_chapter(spark):
    import textwrap

    from fablespark.sources import sinks

    text = "Un **mot** et *deux* " + "tres long texte " * 20 + "\n\n\n\nfin"
    got = spark.createDataFrame([("Un titre", text)], "t string, c string").select(sinks.plain_chapter("t", "c", 30).alias("x")).first().x
    body = "\n\n".join(textwrap.fill(p.strip(), 30) for p in text.replace("**mot**", "mot").replace("*deux*", "deux").split("\n\n") if p.strip())
    assert got == "=" * 30 + "\nUN TITRE\n" + "=" * 30 + "\n\n" + body + "\n\n"
