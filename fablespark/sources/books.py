"""Readers of books and listings: Markdown, EPUB, HTML, rule tables and audio libraries."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..functions import html
from ..functions import text as T
from ..operators import segments

RULES = t.StructType().add("id", "string").add("section", "string").add("original", "string").add("confidence", "string").add("action", "string").add("replacement", "string").add("notes", "string").add("pattern", "string").add("flags", t.ArrayType(t.StringType())).add("alternatives", t.ArrayType(t.StringType()))


def markdown(spark: SparkSession, path: str, level: int = 1) -> DataFrame:
    """book_id (the file), number, title, content of each chapter of each file at path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("book_id"), F.col("value").alias("text"))
    return segments.chapters(files, ["book_id"], level=level)


def markdown_directory(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """One chapter a file, numbered by path within its folder; title from the first header or the file's name."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))
    stem = F.regexp_replace(F.regexp_extract("source_file", r"([^/]+)\.[^./]+$", 1), r"^\d+[_\- ]*", "")
    header = F.trim(F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1))
    title = F.when(header != "", header).otherwise(F.initcap(F.regexp_replace(stem, "[_-]", " ")))
    first = F.trim(F.regexp_replace(F.substring_index(F.ltrim("text"), "\n", 1), r"^#+\s*", ""))
    body = F.when(F.lower(first) == F.lower(title), F.regexp_replace(F.ltrim("text"), r"^[^\n]*\n?", "")).otherwise(F.col("text"))
    folder = F.regexp_extract("source_file", r"^(.*)/", 1)
    return files.select(folder.alias("book_id"), F.row_number().over(Window.partitionBy(folder).orderBy("source_file")).alias("number"), title.alias("title"), T.strip(body).alias("content"), "source_file")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Content pages of each zipped book in name order; undecodable bytes are dropped."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as book:
                names = sorted(n for n in book.namelist() if re.search(r"\.x?html?$", n, re.I) and not re.search("toc|nav|cover|title", n, re.I))
                pages = [book.read(n).decode("utf-8", "ignore") for n in names]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(names), pa.string()), pa.array(range(1, len(names) + 1), pa.int32()), pa.array(names, pa.string()), pa.array(pages, pa.string())], ["book_id", "number", "member", "html"])


def epub(spark: SparkSession, path: str) -> DataFrame:
    """Chapters of EPUB files; numbered before blank pages are dropped, so numbers may have gaps."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")
    pages = files.mapInArrow(_members, "book_id string, number int, member string, html string")
    titled = F.when(T.html_title("html") != "", T.html_title("html")).otherwise(F.concat(F.lit("Chapitre "), F.col("number").cast("string")))
    return pages.select("book_id", "number", titled.alias("title"), T.html_text("html").alias("content")).where("content <> ''")


def rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a JSON glossary {rules: [...]} with their place and defaults."""
    wrapped = spark.read.schema(t.StructType().add("rules", t.ArrayType(RULES))).json(path, multiLine=True)
    out = wrapped.select(F.posexplode("rules").alias("ord", "r")).select("ord", "r.*")
    return out.fillna({"confidence": "high", "action": "replace", "section": "", "replacement": ""})


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """original, replacement of a JSON object, flat or under `corrections`."""
    files = spark.read.text(path, wholetext=True).select(F.coalesce(F.get_json_object("value", "$.corrections"), F.col("value")).alias("j"))
    return files.select(F.explode(F.from_json("j", "map<string,string>")).alias("original", "replacement"))


def audio_library(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("mp3", "m4b", "m4a")) -> DataFrame:
    """title, url path, size and time of audio files, found by metadata alone; newest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    stem, parent = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    root = path.rstrip("/").rsplit("/", 1)[-1]
    return (
        files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))
        .select(F.when(parent == root, stem).otherwise(F.concat_ws(" - ", parent, stem)).alias("title"), "path", F.col("length").alias("size"), "modificationTime")
        .orderBy(F.desc("modificationTime"), "path")
    )


def _titles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The title in the package file of each zipped book; null without one."""
    for batch in batches:
        titles = []
        for content in batch.column(1).to_pylist():
            with zipfile.ZipFile(io.BytesIO(content)) as book:
                packages = [book.read(n).decode("utf-8", "ignore") for n in sorted(book.namelist()) if n.lower().endswith(".opf")]
            found = next((m[1] for p in packages if (m := re.search(r"<dc:title[^>]*>([^<]*)</dc:title>", p, re.I))), None)
            titles.append(found and found.strip())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(titles, pa.string())], ["book_id", "title"])


def epub_markdown(spark: SparkSession, path: str) -> DataFrame:
    """book_id, number, markdown of EPUB files: a row for each content page in order, and as number 0 the book's title if it has one.

    Joined in order with lines of three stars between them, a book's rows are its Markdown file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")
    pages = files.mapInArrow(_members, "book_id string, number int, member string, html string").select("book_id", "number", html.page_markdown("html").alias("markdown"))
    titles = files.mapInArrow(_titles, "book_id string, title string").where("title <> ''")
    return titles.select("book_id", F.lit(0).alias("number"), F.concat(F.lit("# "), html.unescaped("title"), F.lit("\n")).alias("markdown")).unionByName(pages)


def as_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """book_id, number, markdown of all books of a folder: .md and .txt files as they are, EPUB files page by page.

    Files of other kinds are an error that names the first of them.
    """
    files = spark.read.format("binaryFile").load(folder).select("path")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    other = files.where(~kind.isin("md", "txt", "epub")).agg(F.min("path")).first()[0]
    if other:
        raise ValueError(f"no reader for {other}")
    plain = spark.read.option("pathGlobFilter", "*.{md,txt,MD,TXT}").text(folder, wholetext=True)
    return plain.select(F.col("_metadata.file_path").alias("book_id"), F.lit(1).alias("number"), F.col("value").alias("markdown")).unionByName(epub_markdown(spark, folder))


def book(spark: SparkSession, path: str, level: int = 1) -> DataFrame:
    """book_id, number, title, content of whatever is at path: a folder of Markdown files, an EPUB file, or a Markdown file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return markdown_directory(spark, path).select("book_id", "number", "title", "content")
    return epub(spark, path) if path.lower().endswith(".epub") else markdown(spark, path, level).select("book_id", "number", "title", "content")


VOICE = t.StructType().add("name", "string").add("source_audio", "string").add("language", "string").add("description", "string").add("duration_seconds", "double")


def cloned_voices(spark: SparkSession, folder: str) -> DataFrame:
    """name, source_audio, language, description, duration_seconds of the sidecars *_meta.json of a folder; files that are
    no JSON, or lack a name or its audio, are left out."""
    files = spark.read.option("pathGlobFilter", "*_meta.json").text(folder, wholetext=True)
    rows = files.select(F.from_json("value", VOICE).alias("v")).select("v.*").where("name is not null and source_audio is not null")
    return rows.fillna({"language": "fr", "description": "", "duration_seconds": 0.0})


def settings(spark: SparkSession, path: str, schema: t.StructType, defaults: dict) -> DataFrame:
    """One row for each JSON file of settings at path, fields that are missing or null taking their defaults; other fields are ignored."""
    files = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("s")).select("s.*")
    return files.select(*[F.coalesce(F.col(f.name), F.lit(defaults[f.name]).cast(f.dataType)).alias(f.name) if f.name in defaults else F.col(f.name) for f in schema])


def pronunciations(spark: SparkSession, path: str) -> DataFrame:
    """kind (correction or phoneme), key, replacement of a pronunciation file {corrections: {k: v}, phonemes: {words: {k: {ipa: v}}}}."""
    raw = spark.read.text(path, wholetext=True)
    plain = raw.select(F.explode(F.from_json(F.get_json_object("value", "$.corrections"), "map<string,string>")).alias("key", "replacement"))
    word = F.coalesce(F.get_json_object("value", "$.phonemes.words"), F.get_json_object("value", "$.words"), F.get_json_object("value", "$.phonemes"))
    spoken = raw.select(F.explode(F.from_json(word, "map<string,string>")).alias("key", "entry"))
    ipa = F.coalesce(F.get_json_object("entry", "$.ipa"), F.when(~F.startswith("entry", F.lit("{")), F.col("entry")))
    return plain.select(F.lit("correction").alias("kind"), "key", "replacement").unionByName(spoken.select(F.lit("phoneme").alias("kind"), "key", ipa.alias("replacement")))
