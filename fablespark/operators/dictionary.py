"""Texts rewritten by a dictionary of any size, in one pass over each text.

Texts and keys are cut alike into words and single other characters, so a key matches where its pieces
are whole pieces of the text: a key that begins or ends with a letter or digit matches at word edges only, and signs match
anywhere. Of the keys that match at a place the longest wins, and what is put in its place is not read again.
A dictionary of at most `most` bytes is sent to every task. A larger one is joined: each text asks for its own phrases of as many
pieces as some key has, an equality join finds those that are keys, and the text takes up its answers. The plan
is the same for ten keys and for ten million.

entries: key, replacement, and optionally exact (letter case counts) and rank (lower first where several entries fit the same phrase; then
exact ones, then the least replacement). Edge cases: null texts stay null with no replacement; null and empty keys are
dropped; a null replacement is the empty string; rows of texts need no distinct keys.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import scans

MOST = 32 << 20
SLICE = 1 << 20  # bytes of a batch that are Python objects at a time
PIECE = re.compile(r"\w+|\W")
CLOSERS = frozenset(",;:!?")

# Signs of a phonetic script and how they are written for a reader; order matters.
READABLE = (("ʒ", "j"), ("ɑ̃", "an"), ("ɛ̃", "in"), ("ɔ̃", "on"), ("œ̃", "un"), ("ʁ", "r"), ("ɛ", "è"), ("ø", "eu"), ("œ", "eu"), ("y", "u"), ("ɥ", "u"), ("ŋ", "ng"), ("ʃ", "ch"), ("ɲ", "gn"))

#: phrase in lower case -> [(exact, key, replacement)], best first
Entries = dict[str, list[tuple[bool, str, str]]]


def _rewritten(text: str, entries: Callable[[str], list[tuple[bool, str, str]] | None], sizes: dict[str, list[int]], closing: bool) -> tuple[str, int]:
    """The text with every match replaced, and their number. sizes: numbers of pieces of the keys that begin with a piece, longest first."""
    pieces = PIECE.findall(text)
    low, out, i, n = [p.lower() for p in pieces], [], 0, 0
    while i < len(pieces):
        found = None
        for size in sizes.get(low[i], ()):
            if i + size > len(pieces):
                continue
            for exact, key, replacement in entries("".join(low[i : i + size])) or ():
                if exact and "".join(pieces[i : i + size]) != key:
                    continue
                if closing and key[-1] in ".°" and i + size < len(pieces) and not (pieces[i + size].isspace() or pieces[i + size] in CLOSERS):
                    continue
                found = size, replacement
                break
            if found:
                break
        if found:
            out.append(found[1])
            i, n = i + found[0], n + 1
        else:
            out.append(pieces[i])
            i += 1
    return "".join(out), n


def _shape(phrases: Iterator[str]) -> dict[str, list[int]]:
    sizes: dict[str, set[int]] = {}
    for phrase in phrases:
        pieces = PIECE.findall(phrase)
        sizes.setdefault(pieces[0], set()).add(len(pieces))
    return {k: sorted(v, reverse=True) for k, v in sizes.items()}


def _gathered(rows: list[dict]) -> Entries:
    out: Entries = {}
    for r in sorted(rows, key=lambda r: (r["rank"], not r["exact"], r["replacement"], r["key"])):
        out.setdefault("".join(p.lower() for p in PIECE.findall(r["key"])), []).append((r["exact"], r["key"], r["replacement"]))
    return out


def _filled(entries: DataFrame) -> DataFrame:
    exact = F.coalesce("exact", F.lit(False)) if "exact" in entries.columns else F.lit(False)
    rank = F.coalesce("rank", F.lit(0)) if "rank" in entries.columns else F.lit(0)
    return entries.where("key <> ''").select("key", F.coalesce("replacement", F.lit("")).alias("replacement"), exact.alias("exact"), rank.cast("int").alias("rank")).distinct()


def rewritten(texts: DataFrame, entries: DataFrame, text: str = "text", closing: bool = False, most: int = MOST) -> DataFrame:
    """texts with the column rewritten and n_replaced beside it.

    closing: keys that end in `.` or `°` match only before white space, one of `,;:!?` or the end.
    """
    filled = _filled(entries)
    size = filled.agg(F.sum(F.octet_length("key") + F.octet_length("replacement") + 16)).first()[0] or 0
    return _by_broadcast(texts, filled, text, closing) if size <= most else _by_join(texts, filled, text, closing)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, by so few at a time that texts, phrases and answers as Python objects stay small beside the batch."""
    for batch in batches:
        rows = max(1, int(len(batch) * SLICE / max(1, batch.nbytes)))
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


def _out(texts: DataFrame, text: str) -> tuple[list[str], str]:
    shape = texts.withColumn("n_replaced", F.lit(0))
    return [f.name for f in shape.schema], scans.schema_of(shape)


def _by_broadcast(texts: DataFrame, filled: DataFrame, text: str, closing: bool) -> DataFrame:
    table = _gathered(filled.toArrow().to_pylist())
    sent = texts.sparkSession.sparkContext.broadcast((table, _shape(iter(table))))
    names, schema = _out(texts, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sizes = sent.value
        for batch in _slices(batches):
            done = [(None, 0) if t is None else _rewritten(t, table.get, sizes, closing) for t in batch.column(text).to_pylist()]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {text: pa.array([d[0] for d in done], pa.string()), "n_replaced": pa.array([d[1] for d in done], pa.int32())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return texts.mapInArrow(run, schema)


def _by_join(texts: DataFrame, filled: DataFrame, text: str, closing: bool) -> DataFrame:
    names, schema = _out(texts, text)

    def phrased(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries with their phrase and number of pieces."""
        for batch in batches:
            cut = [PIECE.findall(k) for k in batch.column("key").to_pylist()]
            phrases, counts = pa.array(["".join(p.lower() for p in c) for c in cut], pa.string()), pa.array([len(c) for c in cut], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, phrases, counts], [*batch.schema.names, "phrase", "pieces"])

    keyed = filled.mapInArrow(phrased, scans.schema_of(filled, phrase="string", pieces="int"))
    lengths = sorted(r[0] for r in keyed.select("pieces").distinct().collect())  # a few numbers, not keys
    answers = keyed.groupBy("phrase").agg(F.collect_set(F.struct("rank", "exact", "replacement", "key")).alias("found"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct phrases of each text."""
        for batch in _slices(batches):
            out = []
            for t in batch.column("text").to_pylist():
                low = [p.lower() for p in PIECE.findall(t or "")]
                out.append(list({"".join(low[i : i + n]) for n in lengths for i in range(len(low) - n + 1)}))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(out, pa.list_(pa.string()))], ["digest", "phrases"])

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            done = []
            for t, found in zip(batch.column(text).to_pylist(), batch.column("_found").to_pylist(), strict=True):
                table = _gathered([e for group in found or () for e in group])
                done.append((None, 0) if t is None else _rewritten(t, table.get, _shape(iter(table)), closing))
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {text: pa.array([d[0] for d in done], pa.string()), "n_replaced": pa.array([d[1] for d in done], pa.int32())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    # Equal texts ask once; answers come back to every row by the text's digest.
    digests = texts.withColumn("_digest", F.sha2(text, 256))
    distinct = digests.where(F.col(text).isNotNull()).groupBy("_digest").agg(F.any_value(text).alias("text")).withColumnRenamed("_digest", "digest")
    questions = distinct.mapInArrow(asked, "digest string, phrases array<string>").select("digest", F.explode("phrases").alias("phrase"))
    found = questions.join(answers, "phrase").groupBy("digest").agg(F.collect_list("found").alias("_found")).withColumnRenamed("digest", "_digest")
    return digests.join(found, "_digest", "left").drop("_digest").mapInArrow(applied, schema)


def merged_phonemes(custom: DataFrame, builtin: DataFrame) -> DataFrame:
    """Entries of two tables (word, ipa): custom words in any case, then built-in ones as they are written, then built-in ones of the lower-cased word."""
    spelled = readable_phonemes("ipa")
    rows = lambda df, exact, rank: df.select(F.col("word").alias("key"), spelled.alias("replacement"), F.lit(exact).alias("exact"), F.lit(rank).alias("rank"))
    own = rows(custom.withColumn("word", F.lower("word")), False, 0)
    return own.unionByName(rows(builtin, True, 1)).unionByName(rows(builtin.where("word = lower(word)"), False, 2))


def phonemes(words: DataFrame, custom: DataFrame, builtin: DataFrame, word: str = "word") -> DataFrame:
    """words with ipa: of the custom table in lower case, else of the built-in one as written, else of that in lower case; null without one."""
    table = lambda df, name: df.groupBy("word").agg(F.min("ipa").alias(name))
    own, given = table(custom.withColumn("word", F.lower("word")), "_own"), table(builtin, "_given")
    exact, lower = given.withColumnRenamed("word", "_exact"), given.select(F.col("word").alias("_low"), F.col("_given").alias("_given_low"))
    out = words.join(own.withColumnRenamed("word", "_key"), F.lower(word) == F.col("_key"), "left").join(exact, F.col(word) == F.col("_exact"), "left").join(lower, F.lower(word) == F.col("_low"), "left")
    return out.withColumn("ipa", F.coalesce("_own", "_given", "_given_low")).drop("_key", "_own", "_exact", "_given", "_low", "_given_low")


def readable_phonemes(ipa: Column | str) -> Column:
    """Signs of a phonetic script as letters."""
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), READABLE, T.col(ipa))
