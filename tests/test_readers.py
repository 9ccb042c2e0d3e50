"""Readers of books, voices and settings, in a temporary folder."""

import json
import zipfile

import pytest
from pyspark.sql import types as t

from fablespark.functions import html
from fablespark.sources import books


def epub(path, title=None, **pages):
    with zipfile.ZipFile(path, "w") as z:
        if title is not None:
            z.writestr("OEBPS/content.opf", f"<package><dc:title id='t'>{title}</dc:title></package>")
        for name, text in pages.items():
            z.writestr(f"OEBPS/{name}.xhtml", text)


@pytest.fixture
def shelf(tmp_path):
    (tmp_path / "b.md").write_text("# One\n\nfirst\n\n# Two\n\nsecond")
    (tmp_path / "c.txt").write_text("plain text")
    epub(tmp_path / "d.epub", "Tom &amp; Co", c1="<h1>Start</h1><p>He <b>ran</b>.</p><p>Then&nbsp;slept.</p>", c2="<body><h3>Sub</h3><style>p{}</style><p>End</p></body>", toc="<p>no</p>")
    return tmp_path


def test_as_markdown(spark, shelf):
    got = {(r.book_id.rsplit("/", 1)[-1], r.number): r.markdown for r in books.as_markdown(spark, str(shelf)).collect()}
    assert got == {
        ("b.md", 1): "# One\n\nfirst\n\n# Two\n\nsecond",
        ("c.txt", 1): "plain text",
        ("d.epub", 0): "# Tom & Co\n",
        ("d.epub", 1): "\n## Start\nHe ran.\n\nThen\xa0slept.\n\n",
        ("d.epub", 2): "\n#### Sub\nEnd\n\n",
    }
    (shelf / "e.pdf").write_bytes(b"%PDF")
    with pytest.raises(ValueError, match="e.pdf"):
        books.as_markdown(spark, str(shelf))


def test_book_tells_what_is_there(spark, shelf):
    rows = lambda p: [(r.number, r.title, r.content) for r in sorted(books.book(spark, str(p)).collect(), key=lambda r: r.number)]
    assert rows(shelf / "b.md") == [(1, "One", "first"), (2, "Two", "second")]
    assert [r[:2] for r in rows(shelf / "d.epub")] == [(1, "Start"), (2, "Chapitre 2")]
    assert [r[:2] for r in rows(shelf)] == [(1, "One")]


def test_cloned_voices(spark, tmp_path):
    (tmp_path / "a_meta.json").write_text(json.dumps({"name": "a", "source_audio": "a.wav", "duration_seconds": 3.5, "more": 1}))
    (tmp_path / "b_meta.json").write_text(json.dumps({"name": "b", "source_audio": "b.wav", "language": "en", "description": "deep"}))
    (tmp_path / "c_meta.json").write_text("{broken")
    (tmp_path / "d_meta.json").write_text(json.dumps({"name": "d"}))
    (tmp_path / "other.json").write_text(json.dumps({"name": "x", "source_audio": "x"}))
    assert sorted(map(tuple, books.cloned_voices(spark, str(tmp_path)).collect())) == [("a", "a.wav", "fr", "", 3.5), ("b", "b.wav", "en", "deep", 0.0)]


def test_settings_and_pronunciations(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"speed": 1.5, "voices": {"a": "x"}, "unknown": 1}))
    schema = t.StructType().add("speed", "double").add("lang", "string").add("voices", t.MapType(t.StringType(), t.StringType()))
    assert books.settings(spark, str(tmp_path / "s.json"), schema, {"speed": 1.0, "lang": "fr"}).first().asDict() == {"speed": 1.5, "lang": "fr", "voices": {"a": "x"}}
    (tmp_path / "p.json").write_text(json.dumps({"corrections": {"API": "A P I"}, "phonemes": {"words": {"Seine": {"ipa": "sɛn", "notes": "n"}}}}))
    assert sorted(map(tuple, books.pronunciations(spark, str(tmp_path / "p.json")).collect())) == [("correction", "API", "A P I"), ("phoneme", "Seine", "sɛn")]


def test_page_markdown(spark):
    pages = ["<h4 class='x'>A<i>b</i></h4>t", "<p>x</p>\n\n\n<p>y</p>", "<H1>\nT\n</H1>", "a &lt; b<br>c", "", None]
    got = spark.createDataFrame([*enumerate(pages)], "i int, t string").select("i", html.page_markdown("t").alias("m")).orderBy("i").collect()
    assert [r.m for r in got] == ["\n##### Ab\nt", "x\n\ny\n\n", "\n## \nT\n\n", "a < bc", "", None]
