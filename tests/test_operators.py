"""Row generators, readers, writers and streams on small inputs."""

import zipfile

import pytest
from pyspark.sql import functions as F

from fablespark.operators import casting, catalog, segments, timeline
from fablespark.plans import narration
from fablespark.sources import books, sinks
from fablespark.streaming import segments as stream


def test_chapters(spark):
    rows = [("b1", "lost\n# Un\ntexte\n# Deux\n\nsuite\n## sous\nfin"), ("b2", "sans titre"), ("b3", "  ")]
    got = segments.chapters(spark.createDataFrame(rows, "book string, text string"), ["book"]).orderBy("book", "number").collect()
    assert [tuple(r) for r in got] == [("b1", 1, "Un", "texte"), ("b1", 2, "Deux", "suite\n## sous\nfin"), ("b2", 1, "Contenu", "sans titre")]


def test_dialogue(spark):
    got = segments.dialogue(spark.createDataFrame([(1, 'Il dit : « Oui. » Puis "non" et sortit.')], "id int, text string"), ["id"]).orderBy("seg_idx").collect()
    assert [(r.segment, r.is_dialogue) for r in got] == [("Il dit :", False), ("Oui.", True), ("Puis", False), ("non", True), ("et sortit.", False)]


def test_script(spark):
    text = "MARIE: Bonjour\nà tous\n\nPAUL: Salut\n\nencore\nMARIE: Fin"
    got = segments.script_lines(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).orderBy("line_idx").collect()
    assert [(r.speaker, r.line) for r in got] == [("MARIE", "Bonjour à tous"), ("PAUL", "Salut"), ("PAUL", "encore"), ("MARIE", "Fin")]


def test_voice_blend(spark):
    got = segments.voice_blend(spark.createDataFrame([(1, "a:60, b ,c"), (2, "x")], "id int, spec string"), ["id"], "spec").orderBy("id", "pos").collect()
    assert [(r.voice, round(r.weight, 3)) for r in got] == [("a", 0.6), ("b", 0.2), ("c", 0.2), ("x", 1.0)]


def test_attribution(spark):
    rows = [(1, i, s) for i, s in enumerate([None, "A", None, "B", None, None, "B", None])]
    got = casting.attributed(spark.createDataFrame(rows, "d int, i int, explicit string"), ["d"], "i").orderBy("i").collect()
    assert [(r.speaker, r.method) for r in got] == [("UNKNOWN", "unknown"), ("A", "explicit"), ("A", "last_speaker"), ("B", "explicit"), ("A", "alternation"), ("B", "alternation"), ("B", "explicit"), ("A", "alternation")]


def test_catalog(spark):
    a = spark.createDataFrame([("k", "1", 0), ("l", "2", 1)], "key string, value string, ord int")
    changes = spark.createDataFrame([("k", "z", "9")], "key string, new_key string, value string")
    assert sorted(tuple(r) for r in catalog.renamed(a, changes, "key", "ord").collect()) == [("l", "2", 1), ("z", "9", 2)]
    assert {r.key for r in catalog.searched(a, "K", "key").collect()} == {"k"}
    assert catalog.removed(a, changes, "key").count() == 1


def test_eviction_keeps_within_limits(spark):
    rows = [(i, f"2024-01-{1 + i // 3:02d} 00:00:0{i % 3}", 10) for i in range(12)]
    frame = spark.createDataFrame(rows, "key int, t string, size_bytes long").select("key", F.col("t").cast("timestamp").alias("created_at"), "size_bytes")
    assert {r.key for r in timeline.evicted(frame, 100, 100).collect()} == {0, 1, 2, 3}
    assert timeline.evicted(frame, 1000, 100).count() == 0


@pytest.fixture
def book_folder(tmp_path):
    (tmp_path / "01_le_debut.md").write_text("# Le début\n\nTexte un.", "utf-8")
    (tmp_path / "02_la-suite.md").write_text("Texte deux.", "utf-8")
    with zipfile.ZipFile(tmp_path / "livre.epub", "w") as z:
        z.writestr("OPS/c2.xhtml", "<h2>Deux</h2><p>Corps <i>deux</i></p>")
        z.writestr("OPS/c1.html", "<p></p>")
        z.writestr("OPS/toc.html", "<p>table</p>")
    (tmp_path / "rules.json").write_text('{"rules": [{"id": "r1", "pattern": "a", "flags": ["i"]}, {"id": "r2", "pattern": "b", "confidence": "low"}]}')
    (tmp_path / "wrapped.json").write_text('{"version": 1, "corrections": {"a": "b"}}')
    (tmp_path / "flat.json").write_text('{"a": "b", "c": "d"}')
    (tmp_path / "album").mkdir()
    (tmp_path / "album" / "piste.mp3").write_bytes(b"12345")
    return str(tmp_path)


def test_readers(spark, book_folder):
    got = books.markdown_directory(spark, book_folder).orderBy("number").collect()
    assert [(r.number, r.title, r.content) for r in got] == [(1, "Le début", "Texte un."), (2, "La Suite", "Texte deux.")]
    assert [(r.number, r.title) for r in books.markdown(spark, f"{book_folder}/*.md").orderBy("title").collect()] == [(1, "Contenu"), (1, "Le début")]
    assert [(r.number, r.title, r.content) for r in books.epub(spark, book_folder).collect()] == [(2, "Deux", "Deux Corps deux")]
    assert [(r.ord, r.id, r.confidence, r.action) for r in books.rules(spark, f"{book_folder}/rules.json").orderBy("ord").collect()] == [(0, "r1", "high", "replace"), (1, "r2", "low", "replace")]
    assert books.corrections(spark, f"{book_folder}/wrapped.json").count() == 1 and books.corrections(spark, f"{book_folder}/flat.json").count() == 2
    assert [(r.title, r.size) for r in books.audio_library(spark, book_folder).collect()] == [("album - piste", 5)]


def test_writers(spark, tmp_path):
    chapters = spark.createDataFrame([("b", 2, "Deux", "y"), ("b", 1, "Un <", "x\n\nz")], "book string, number int, title string, content string")
    assert sinks.markdown(chapters, ["book"]).first().text == "# Un <\n\nx\n\nz\n\n# Deux\n\ny"
    page = sinks.html(chapters, ["book"]).first().text
    assert page.index("Un &lt;") < page.index("Deux") and "x</p>\n<p>z" in page
    sinks.write_texts(sinks.markdown(chapters, ["book"]), ["book"], str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "book=b")).count() == 9


def test_narration(spark):
    chapters = spark.createDataFrame([(1, "Il court. [mad] « Non ! » La joie vint... Fin."), (2, ""), (3, None)], "chapter int, content string")
    rows = narration.narrated(chapters, ["chapter"]).orderBy("sent_idx").collect()
    assert rows and all(r.chapter == 1 for r in rows)
    assert all(a.end_time <= b.start_time for a, b in zip(rows, rows[1:]))
    assert narration.chapter_report(narration.narrated(chapters, ["chapter"]), ["chapter"]).count() == 1


def test_synthesis_speaks_each_request_once(spark):
    rows = spark.createDataFrame([(1, "a", "v", 1.0), (2, "a", "v", 1.0), (3, "bad", "v", 1.0)], "id int, sentence string, voice string, final_speed double")

    def speak(text, voice, speed):
        if text == "bad":
            raise ValueError
        return text.encode()

    got = {r.id: r.audio for r in narration.synthesise(rows, speak).collect()}
    assert got == {1: b"a", 2: b"a", 3: None}


def test_streams(spark, tmp_path):
    rows = [(f"2024-01-01 0{i // 5}:0{i % 5}:00", "k", i, "joy" if i < 10 else "fear") for i in range(20)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "ts string, who string, idx long, emotion string").select(F.col("ts").cast("timestamp").alias("ts"), "who", "idx", "emotion").coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    for name, frame in (("counts", stream.emotion_counts(spark.readStream.schema(schema).parquet(source))), ("moods", stream.mood_changes(spark.readStream.schema(schema).parquet(source), "who", "idx"))):
        run = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        run.awaitTermination(120)
    assert {(r.emotion, r.n) for r in spark.table("counts").collect()} >= {("joy", 5)}
    assert [(r.idx, r.trend) for r in spark.table("moods").orderBy("idx").collect()] == [(4, "improving"), (12, "declining")]
