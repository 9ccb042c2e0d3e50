"""Row generators: chapters, sentences, dialogue, script lines, clauses and tags from text.

Every generator explodes an array made by Column expressions, so a row's output is bounded by its
own text and nothing is shuffled. Input columns named in `keep` are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def exploded(df: DataFrame, keep: list[str], items: Column, index: str, value: str, base: int = 0) -> DataFrame:
    out = df.select(*keep, F.posexplode(items).alias(index, value))
    return out.withColumn(index, F.col(index) + base) if base else out


def chapters(books: DataFrame, keep: list[str], text: str = "text", level: int = 1) -> DataFrame:
    """number, title, content by headers of one level; a text without one is a chapter of its own."""
    mark = "#" * level
    parts = F.split(F.col(text), rf"(?m)^{mark}[ \t]+")
    headed = F.col(text).rlike(rf"(?m)^{mark}[ \t]+\S")
    one = F.struct(F.lit("Contenu").alias("title"), T.strip(text).alias("content"))
    each = F.transform(
        F.slice(parts, 2, F.size(parts)),
        lambda p: F.struct(T.strip(F.substring_index(p, "\n", 1)).alias("title"), T.strip(F.when(p.contains("\n"), F.regexp_replace(p, r"^[^\n]*\n", "")).otherwise("")).alias("content")),
    )
    found = F.when(headed, each).otherwise(F.filter(F.array(one), lambda c: c["content"] != ""))
    out = books.select(*keep, F.posexplode(found).alias("number", "c"))
    return out.select(*keep, (F.col("number") + 1).alias("number"), "c.title", "c.content")


def sentences(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    return exploded(df, keep, T.sentences(text), "sent_idx", "sentence")


def clauses(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    return exploded(df, keep, T.clauses(text), "clause_idx", "clause")


def chunks(df: DataFrame, keep: list[str], limit: int, text: str = "text") -> DataFrame:
    """Sentences packed greedily into chunks of at most `limit` characters (a longer one alone)."""
    return exploded(df, keep, T.pack(T.sentences(text), limit), "chunk_idx", "chunk")


def dialogue(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """seg_idx, segment, is_dialogue: quoted runs and what lies between them, blanks dropped."""
    runs = F.filter(F.regexp_extract_all(F.col(text), F.lit(r"«[^»]+»|\"[^\"]+\"|[^«\"]+"), F.lit(0)), lambda s: T.strip(s) != "")
    out = exploded(df, keep, runs, "seg_idx", "raw")
    spoken = F.col("raw").rlike(r"^[«\"]")
    return out.select(*keep, "seg_idx", T.strip(F.when(spoken, F.regexp_replace("raw", r"^[«\"]|[»\"]$", "")).otherwise(F.col("raw"))).alias("segment"), spoken.alias("is_dialogue"))


def script_lines(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """line_idx, speaker, line of scripts `NAME: text`; lines without a name continue the one before.

    A blank line ends a speech without forgetting its speaker. Speeches are islands of a running
    count over each text's own lines.
    """
    pattern = r"^([A-Za-z][A-Za-z\s]+):\s*(.+)$"
    lines = exploded(df, keep, F.split(T.strip(text), "\n"), "pos", "raw")
    lines = lines.select(*keep, "pos", T.strip("raw").alias("raw"))
    named = F.col("raw").rlike(pattern)
    order = Window.partitionBy(*keep).orderBy("pos")
    lines = lines.select(
        *keep,
        "pos",
        F.when(named, T.strip(F.regexp_extract("raw", pattern, 1))).alias("name"),
        F.when(named, T.strip(F.regexp_extract("raw", pattern, 2))).otherwise(F.col("raw")).alias("said"),
        F.sum((named | (F.col("raw") == "")).cast("int")).over(order).alias("island"),
    ).withColumn("speaker", F.last("name", ignorenulls=True).over(order))
    spoken = lines.where("said <> '' and speaker is not null").groupBy(*keep, "island", "speaker").agg(F.array_sort(F.collect_list(F.struct("pos", "said"))).alias("parts"))
    order = Window.partitionBy(*keep).orderBy("island")
    return spoken.select(*keep, (F.row_number().over(order) - 1).alias("line_idx"), "speaker", F.array_join(F.transform("parts", lambda p: p["said"]), " ").alias("line"))


def merge_short(df: DataFrame, keep: list[str], value: str, index: str, least: int) -> DataFrame:
    """Rows shorter than `least` join the row before them: islands of a running count of long rows."""
    order = Window.partitionBy(*keep).orderBy(index)
    marked = df.withColumn("_island", F.sum(((F.length(value) >= least) | (F.row_number().over(order) == 1)).cast("int")).over(order))
    rows = marked.groupBy(*keep, "_island").agg(F.array_sort(F.collect_list(F.struct(index, value))).alias("parts"))
    return rows.select(*keep, (F.col("_island") - 1).alias(index), F.array_join(F.transform("parts", lambda p: p[value]), " ").alias(value))


def tags(df: DataFrame, keep: list[str], known: DataFrame, text: str = "text") -> DataFrame:
    """tag_idx and the known tag of each `[name]` in a text; unknown names are dropped by the join."""
    names = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"\[([A-Za-z_ -]+)\]"), F.lit(1)), lambda n: F.lower(F.trim(n)))
    return exploded(df, keep, names, "tag_idx", "name").join(known, "name")


def voice_blend(df: DataFrame, keep: list[str], spec: str) -> DataFrame:
    """Rows (voice, weight) of `a:60,b:40`; voices without a share split what is left; weights sum to 1."""
    items = F.filter(F.transform(F.split(F.col(spec), ","), lambda x: F.trim(x)), lambda x: x != "")
    parsed = F.transform(items, lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("voice"), F.trim(F.split_part(x, F.lit(":"), F.lit(2))).try_cast("double").alias("share")))
    out = df.select(*keep, F.posexplode(parsed).alias("pos", "v")).select(*keep, "pos", "v.voice", "v.share")
    whole = Window.partitionBy(*keep)
    given, missing = F.coalesce(F.sum("share").over(whole), F.lit(0.0)), F.sum(F.col("share").isNull().cast("int")).over(whole)
    out = out.withColumn("share", F.coalesce("share", F.greatest(F.lit(0.0), 100 - given) / missing))
    return out.withColumn("weight", F.col("share") / F.sum("share").over(whole)).drop("share")
