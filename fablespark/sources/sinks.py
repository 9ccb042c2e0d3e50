"""Text renderings of chapters and listings as columns, and writers that keep one file a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def escaped(text: Column | str) -> Column:
    """For XML and HTML."""
    return T.chain(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")))


def _ordered(order: str, *columns: Column) -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), *columns)))


def markdown(chapters: DataFrame, book: list[str]) -> DataFrame:
    """One row a book: its chapters under headers, in order."""
    parts = chapters.groupBy(*book).agg(_ordered("number", "title", "content").alias("c"))
    return parts.select(*book, F.array_join(F.transform("c", lambda c: F.concat(F.lit("# "), c["title"], F.lit("\n\n"), c["content"])), "\n\n").alias("text"))


def html(chapters: DataFrame, book: list[str]) -> DataFrame:
    """One page a book with a table of contents that links to its chapters."""
    parts = chapters.groupBy(*book).agg(_ordered("number", escaped("title").alias("title"), T.markdown_to_html("content").alias("body")).alias("c"))
    link = lambda c: F.concat(F.lit('<li><a href="#c'), c["_order"].cast("string"), F.lit('">'), c["title"], F.lit("</a></li>"))
    body = lambda c: F.concat(F.lit('<h1 id="c'), c["_order"].cast("string"), F.lit('">'), c["title"], F.lit("</h1>\n<p>"), F.regexp_replace(c["body"], r"\n\s*\n", "</p>\n<p>"), F.lit("</p>"))
    return parts.select(*book, F.concat(F.lit("<html><body><ul>"), F.array_join(F.transform("c", link), ""), F.lit("</ul>\n"), F.array_join(F.transform("c", body), "\n"), F.lit("</body></html>")).alias("text"))


def rss(items: DataFrame, channel: list[str], title: Column, base_url: str) -> DataFrame:
    """Feeds from items(title, url, size, type, date) as rows (channel, part, date, url, xml).

    Part 0 is a channel's head, 1 its items, 2 its foot: sorted by channel, part, date and url, the latter two
    descending, the rows are the feed with the newest item first. A channel may have any number of items, so
    none is gathered in one row; write_feeds sorts and writes them.
    """
    entry = F.concat(
        F.lit("<item>\n<title>"), escaped("title"), F.lit('</title>\n<enclosure url="'), F.col("url"), F.lit('" length="'), F.col("size").cast("string"), F.lit('" type="'), F.col("type"),
        F.lit('" />\n<guid>'), F.col("url"), F.lit("</guid>\n<pubDate>"), F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate>\n</item>"),
    )
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0">\n<channel>\n<title>'), escaped(title), F.lit(f"</title>\n<link>{base_url}</link>\n<language>fr</language>"))
    nothing = (F.lit(None).cast(items.schema["date"].dataType).alias("date"), F.lit(None).cast("string").alias("url"))
    heads = items.groupBy(*channel).agg(F.first(head).alias("xml")).select(*channel, F.lit(0).alias("part"), *nothing, "xml")
    feet = items.select(*channel).distinct().select(*channel, F.lit(2).alias("part"), *nothing, F.lit("</channel>\n</rss>").alias("xml"))
    return heads.union(items.select(*channel, F.lit(1).alias("part"), "date", "url", entry.alias("xml"))).union(feet)


def write_feeds(feeds: DataFrame, channel: list[str], path: str) -> None:
    """Feeds of rss() in order, dealt out by range so that a long feed is written by many tasks."""
    order = [*channel, "part", F.desc("date"), F.desc("url")]
    feeds.repartitionByRange(*order).sortWithinPartitions(*order).select(*channel, F.col("xml").alias("value")).write.partitionBy(*channel).mode("overwrite").text(path)


def write_texts(texts: DataFrame, book: list[str], path: str) -> None:
    """One folder a book, each holding its text; written by executors."""
    texts.select(*book, "text").write.partitionBy(*book).mode("overwrite").text(path)


def manifest(chapters: DataFrame, book: list[str]) -> DataFrame:
    """number, title, words, characters and estimated minutes of each chapter."""
    return chapters.select(*book, "number", "title", T.word_count("content").alias("words"), F.length("content").alias("chars"), T.minutes("content").alias("minutes"))


def clock(seconds: Column | str) -> Column:
    """HH:MM:SS,mmm of seconds, cut off at the millisecond."""
    t = T.col(seconds)
    whole = F.floor(t)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60, F.floor((t - whole) * 1000))


def clock_of_ms(ms: Column | str) -> Column:
    """HH:MM:SS.mmm of milliseconds."""
    t = T.col(ms).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(t / 3600000), F.floor(t % 3600000 / 60000), F.floor(t % 60000 / 1000), t % 1000)


def timeline_rows(segments: DataFrame) -> DataFrame:
    """segments with a column each for a subtitle entry, a line of comma-separated values and a JSON object.

    Entries are rows, so that a long timeline is written by many tasks; sort and write them as text.
    """
    quoted = lambda c: F.when(F.col(c).rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    entry = F.concat((F.col("index") + 1).cast("string"), F.lit("\n"), clock("start_time"), F.lit(" --> "), clock("end_time"), F.lit("\n["), F.col("speaker"), F.lit("] "), F.col("text"), F.lit("\n"))
    values = F.concat_ws(",", F.col("index").cast("string"), quoted("speaker"), quoted("text"), F.format_string("%.3f", "start_time"), F.format_string("%.3f", "duration"), F.coalesce("emotion", F.lit("")))
    return segments.withColumn("srt", entry).withColumn("csv", values).withColumn("json", F.to_json(F.struct("index", "speaker", "text", "start_time", "end_time", "duration", "emotion")))


def chapter_marks(chapters: DataFrame, escape: bool = True) -> DataFrame:
    """chapters(title, start_ms, end_ms) with a metadata block each; the file starts with `;FFMETADATA1`.

    A title's `=`, `;` and `#` are escaped and its backslashes, those of the escapes included, doubled after that.
    """
    title = F.col("title")
    if escape:
        for sign in "=;#":
            title = F.replace(title, F.lit(sign), F.lit("\\" + sign))
        title = F.replace(title, F.lit("\\"), F.lit("\\\\"))
    return chapters.withColumn("block", F.concat(F.lit("\n[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("start_ms").cast("string"), F.lit("\nEND="), F.col("end_ms").cast("string"), F.lit("\ntitle="), title))


def concat_line(path: Column | str) -> Column:
    """A line of a list of files to be joined, quotes escaped."""
    return F.concat(F.lit("file '"), F.replace(T.col(path), F.lit("'"), F.lit("'\\''")), F.lit("'"))


def wrapped(paragraph: Column | str, width: int = 80) -> Column:
    """A paragraph folded into lines of at most `width` characters; words longer than that are cut."""
    pieces = F.flatten(F.transform(T.words(paragraph), lambda w: F.regexp_extract_all(w, F.lit(f".{{1,{width}}}"), F.lit(0))))
    return F.array_join(T.pack(pieces, width), "\n")


def plain_chapter(title: Column | str, content: Column | str, width: int = 80) -> Column:
    """A chapter as plain text: its title between rules, bold and italic marks gone, paragraphs folded."""
    text = F.regexp_replace(F.regexp_replace(T.col(content), r"\*\*(.+?)\*\*", "$1"), r"\*(.+?)\*", "$1")
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), T.strip), lambda p: p != "")
    rule = "=" * width
    return F.concat(F.lit(f"{rule}\n"), F.upper(T.col(title)), F.lit(f"\n{rule}\n\n"), F.array_join(F.transform(paragraphs, lambda p: wrapped(p, width)), "\n\n"), F.lit("\n\n"))


def slug(title: Column | str) -> Column:
    """A file name from a title: runs of other signs than letters and digits as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(T.col(title)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
