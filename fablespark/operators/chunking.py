"""Texts cut to a length that a speaker can take: paragraphs, then sentences, then clauses, then commas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

EMPTY = "cast(array() as array<string>)"


def at_commas(text: Column, limit: int) -> Column:
    """Parts between commas, joined again while they fit; a part over the limit stays whole."""
    return T.pack(F.split(text, r"(?U),\s*", -1), limit, ", ")


def at_clauses(text: Column, limit: int) -> Column:
    """Parts between `;` and `:`, each with its mark, joined while they fit; longer ones are cut at commas."""
    bodies = F.split(text, r"(?U)[;:]\s*", -1)
    marks = F.concat(F.regexp_extract_all(text, F.lit("[;:]"), F.lit(0)), F.array(F.lit("")))
    state = lambda open_, done: F.struct(open_.alias("open"), done.alias("done"))

    def step(a: Column, x: Column) -> Column:
        joined = F.when(a["open"] == "", x["body"]).otherwise(F.concat(a["open"], F.lit(" "), x["body"]))
        done = F.when(a["open"] == "", a["done"]).otherwise(F.array_append(a["done"], a["open"]))
        cut = at_commas(x["body"], limit)
        longer = T.let(cut, lambda c: state(F.concat(F.element_at(c, -1), x["mark"]), F.concat(done, F.slice(c, 1, F.size(c) - 1))))
        return F.when(F.length(joined) <= limit, state(F.concat(joined, x["mark"]), a["done"])).when(F.length(x["body"]) > limit, longer).otherwise(state(F.concat(x["body"], x["mark"]), done))

    parts = F.zip_with(bodies, marks, lambda b, m: F.struct(b.alias("body"), m.alias("mark")))
    return F.aggregate(parts, state(F.lit(""), F.expr(EMPTY)), step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.array_append(a["done"], a["open"])))


def _paragraph(text: Column, limit: int) -> Column:
    state = lambda open_, done: F.struct(open_.alias("open"), done.alias("done"))

    def step(a: Column, s: Column) -> Column:
        done = F.when(a["open"] == "", a["done"]).otherwise(F.array_append(a["done"], a["open"]))
        joined = F.when(a["open"] == "", s).otherwise(F.concat(a["open"], F.lit(" "), s))
        return F.when(F.length(s) > limit, state(F.lit(""), F.concat(done, at_clauses(s, limit)))).when(F.length(joined) <= limit, state(joined, a["done"])).otherwise(state(s, done))

    whole = F.aggregate(F.transform(T.sentences(text), T.strip), state(F.lit(""), F.expr(EMPTY)), step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.array_append(a["done"], a["open"])))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(whole)


def chunks(df: DataFrame, keys: list[str], limit: int, text: str = "text") -> DataFrame:
    """chunk_idx, chunk, is_dialogue, pause_after (0.3 after dialogue, else 0.1) of each text."""
    cut = F.flatten(F.transform(T.paragraphs(text), lambda p: _paragraph(p, limit)))
    out = df.select(*keys, F.posexplode(F.transform(cut, T.strip)).alias("chunk_idx", "chunk"))
    spoken = T.is_dialogue("chunk")
    return out.withColumn("is_dialogue", spoken).withColumn("pause_after", F.when(spoken, 0.3).otherwise(0.1))


def halves(text: Column | str) -> Column:
    """An over-long piece as two halves of its words; pieces of fewer than four words stay whole."""
    return T.let(T.words(text), lambda w: F.when(F.size(w) < 4, F.array(F.array_join(w, " "))).otherwise(F.array(F.array_join(F.slice(w, 1, F.floor(F.size(w) / 2).cast("int")), " "), F.array_join(F.slice(w, F.floor(F.size(w) / 2).cast("int") + 1, F.size(w)), " "))))


def handed_on(pieces: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Pieces of one segment: the first keeps tags and pause_before, the last pause_after; 0.1 between."""
    w = Window.partitionBy(*keys).orderBy(order)
    first, last = F.lag(order).over(w).isNull(), F.lead(order).over(w).isNull()
    return (
        pieces.withColumn("_first", first)
        .withColumn("_last", last)
        .withColumn("tags", F.when(F.col("_first"), F.col("tags")).otherwise(F.array().cast("array<string>")))
        .withColumn("pause_before", F.when(F.col("_first"), F.col("pause_before")).otherwise(0.0))
        .withColumn("pause_after", F.when(F.col("_last"), F.col("pause_after")).otherwise(0.1))
        .drop("_first", "_last")
    )
