"""What the review of round 4 found."""

import duckdb
import pytest

#: Texts in which scripts and SQL could differ: no lines, ids that are null or shared, white space of all kinds, lines that look like a speaker's.
ODD = [
    "", " \n\t\n", "***\n()", "a\rb\nc\rd\ne\rf\ng\rh\ni\rj", "a\r\nb\r\nc\r\n\r\nd\r\ne", "a\x0bb\n\x0b\nc\x0bd\ne\x0b", "a\x0cb\n\x0c\nc\x0cd\ne", "a\xa0b\n\xa0\nc\xa0\n\xa0d\xa0\xa0e\nf\xa0\ng",
    "a b\nc d\ne　f　\ng\x85h\ni   j", "un\ndeux\nOUI. - non\nquatre", "A\nB\nAB. – x\nHUGO.-y\nZZ. - t\nOK. - u\nOK. - v\nOK. - w", "a\x1cb\n\x1c\nc\x1f d", "a \t b\nc  d\ne   f", "a\x10b\x101c\n\x100\n\x10a", "x​y\n​\nz",
    '"un deux trois"\n« quatre cinq »', ". - a\n. - b\n. - c\n. - d\n: e", "\U0001d41a\n\U0001f600 x\ny", "\n".join(f"l{i}" for i in range(60)),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [*enumerate(ODD), (100, None), (101, "un\ndeux\ntrois\nquatre"), (101, "un\ndeux\ntrois\nquatre"), (102, ""), (102, "un\ndeux"), (None, "x\ny\nz\nt"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    return folder, con


@pytest.mark.parametrize("name", ["script_conversation", "script_participants"])
def test_scripts_of_odd_texts(spark, odd, name):
    """script_conversation and script_participants equal their SQL on odd texts and ids."""
    from fablespark.plans.queries import ORACLE_SQL, QUERIES

    got = QUERIES[name](spark, odd[0])
    columns = sorted(got.columns)
    want = odd[1].sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(str(tuple(r)) for r in got.select(columns).collect()) == sorted(map(str, want))


def test_scripts_are_walked_over_in_their_rows(spark):
    """lines need no shuffle; a null key keeps its lines; a line may hold a carriage return."""
    from fablespark.operators import conversation

    frame = spark.createDataFrame([(None, "MARIE: un\rdeux\nPAUL: trois"), (2, "MARIE: a" + "\nLEA: b" * 3000)], "i int, text string").coalesce(1)
    made = conversation.lines(frame, ["i"])
    assert not any(w in made._jdf.queryExecution().executedPlan().toString() for w in ("Exchange", "Sort", "Window"))
    assert [(r.line_idx, r.speaker) for r in made.where("i = 2").collect()] == [(0, "MARIE"), *((j, "LEA") for j in range(1, 3001))]
    said = conversation.conversation(frame.where("i is null"), ["i"], spark.createDataFrame([], conversation.CONFIG))
    assert sorted((r.line_idx, r.speaker, r.text, r.voice) for r in said.collect()) == [(0, "MARIE", "un deux", "fm_hugo"), (1, "PAUL", "trois", "ff_siwis")]


def test_passes_search_once(spark):
    """abbreviations and signs found by one search, and numbers never tried shorter, give what search after search gives."""
    import random
    import time
    from functools import reduce

    from fablespark.functions import normalize as Z
    from fablespark.functions import text as T
    from pyspark.sql import functions as F

    rng = random.Random(5)
    bits = [*Z.ABBREVIATIONS["fr"], *Z.ABBREVIATIONS["en"], *Z.SYMBOLS["fr"], *Z.UNITS["fr"], *"0123456789", *".,;:%$€/-h'", " ", " ", " ", "  ", "\n", "\0", "\xa0", "DR.", "ſt", "İ.E.", "ı.e.", "##", "x", "é", "12", "1999", "IV", "ieme", "th", "1er"]
    rows = spark.createDataFrame([(i, "".join(rng.choice(bits) for _ in range(rng.randrange(25)))) for i in range(3000)], "i int, t string").repartition(8).cache()
    for lang in ("fr", "en"):
        short = reduce(lambda t, kv: F.regexp_replace(t, rf"(?iuU)\b\Q{kv[0]}\E(?=\s|$|[,;:])", kv[1]), Z.ABBREVIATIONS[lang].items(), F.col("t"))
        sign = F.col("t")
        for c, said in Z.SYMBOLS[lang].items():
            sign = F.regexp_replace(F.regexp_replace(sign, r"(?mU)^#+\s*", ""), r"(?U)#(\w)", "$1") if c == "#" else F.replace(sign, F.lit(c), F.lit(said))
        marks = {"measures": rf"(?iuU){Z.NUMBER}\s*(?:{'|'.join(Z.UNITS[lang])})\b", "percentages": rf"(?U){Z.NUMBER}\s*%", "currency": rf"(?U)[€$£¥]\s?{Z.NUMBER}|{Z.NUMBER}\s?[€$£¥]", "ordinals": r"(?iuU)[0-9]+(?:er|ere|eme|ème|e)\b" if lang == "fr" else r"(?iuU)[0-9]+(?:st|nd|rd|th)\b", "romans": r"(?iuU)\b[IVXLCDM]+(?:e|eme|ème)?\b(?!')"}
        used: dict[str, str] = {}
        kept = Z.replaced
        try:
            for name in marks:
                Z.replaced = lambda t, p, by, n=name: (used.setdefault(n, p), kept(t, p, by))[1]
                getattr(Z, name)("t", lang)
        finally:
            Z.replaced = kept
        found = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
        pairs = [(Z.abbreviations("t", lang), short), (Z.symbols("t", lang), sign), (Z._collapsed(F.col("t")), T.collapse("t")), *((found(used[n]), found(p)) for n, p in marks.items())]
        for k, (a, b) in enumerate(pairs):
            assert rows.where(~a.eqNullSafe(b)).select("t", a, b).take(3) == [], (lang, k)
        for name in marks:
            assert rows.where(found(used[name]).cast("string") == "[]").where(getattr(Z, name)("t", lang) != F.col("t")).count() == 0
    long, start = spark.createDataFrame([("1" * 30000,)], "t string"), time.monotonic()
    assert all(long.where(f("t", "fr") == F.col("t")).count() == 1 for f in (Z.measures, Z.percentages, Z.ordinals))
    assert time.monotonic() - start < 20
