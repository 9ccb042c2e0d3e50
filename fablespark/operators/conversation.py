"""Conversations from scripts: formats told apart, lines given to speakers, stage directions and moods cut out, voices set.

A script is the text of one row; its lines are walked over in that row, so no line is shuffled or sorted for its speech.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.staging import staged
from . import casting, scans

# How a line names its speaker, by format, in the order in which they are tried; moods that a tag may name; voices by gender.
FORMATS = {
    "script": r"(?sU)^([A-Z][A-Z\s]+):\s*(.+)$",
    "script_lower": r"(?sU)^([A-Za-z][A-Za-z\s]+):\s*(.+)$",
    "markdown": r"(?sU)^\*\*([^*:]+):?\*\*:?\s*(.+)$",
    "theatre": r"(?sU)^([A-Z][A-Z\s]+)\.\s*[-–]\s*(.+)$",
    "parentheses": r"(?sU)^\(([^)]+)\)\s*(.+)$",
}
EMOTIONS = ("excited", "sad", "angry", "whispers", "fearful", "tender", "dramatic", "sarcastic", "cheerful", "serious", "mysterious")
VOICES = {"M": ("fm_hugo", "fm_florian"), "F": ("ff_siwis", "ff_sophie")}
FIRST_LINES = 20
SHORTEST = 5
MOOD = rf"(?i)\[({'|'.join(EMOTIONS)})\]"
DIRECTION = r"\[([^\]]+)\]|\(([^)]+)\)"
QUOTES = (r'[«"]([^»"]+)[»"]', r'"([^"]+)"', r"'([^']+)'")
CONFIG = "name string, gender string, voice string, speed double, pitch_shift double"


def script_format(text: Column | str) -> Column:
    """The format of the first of the first FIRST_LINES lines that has one; unknown without any."""
    lines = F.transform(F.slice(F.split(T.strip(text), "\n"), 1, FIRST_LINES), T.strip)
    known = F.filter(F.transform(lines, lambda x: reduce(lambda a, b: a.when(x.rlike(b[1]), b[0]), FORMATS.items(), F.when(F.lit(False), ""))), lambda k: k.isNotNull())
    return F.when(T.col(text).isNotNull(), F.coalesce(F.get(known, F.lit(0)), F.lit("unknown")))


#: The formats as Python reads them, white space as in T.SPACES; and characters of speeches in a batch.
_NAMED = [re.compile(p.replace("(?sU)", "(?s)").replace(r"\s]", T.SPACES + "]").replace(r"\s", f"[{T.SPACES}]")) for p in FORMATS.values()]
_BATCH = 1 << 22


def _named(line: str) -> re.Match | None:
    return next(filter(None, (p.match(line) for p in _NAMED)), None)


def _speeches(text: str) -> Iterator[tuple[str, str]]:
    """Speaker and line of each speech of one script."""
    raw = [x.strip(T.SPACES) for x in text.strip(T.SPACES).split("\n")]
    if not any(map(_named, raw[:FIRST_LINES])):
        quotes = [q.strip(T.SPACES) for p in QUOTES for q in re.findall(p, text)]
        yield from [("SPEAKER", q) for q in quotes if len(q) > SHORTEST] or [("NARRATOR", text)]
        return
    speaker, said = None, []
    for line in raw:
        found = _named(line)
        if said and (found or not line):
            yield speaker, " ".join(said)
            said = []
        if found:
            speaker, line = found[1].strip(T.SPACES), found[2].strip(T.SPACES)
        if line and speaker is not None:
            said.append(line)
    if said:
        yield speaker, " ".join(said)


def lines(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """line_idx, speaker, line of each script. Lines without a speaker go on with the one before; blank ones end a speech,
    not its speaker; lines before any speaker are dropped. A text of no known format gives its quotes to SPEAKER, or itself to NARRATOR.
    Scripts that share their keys stay apart."""
    names = [*keep, "line_idx", "speaker", "line"]

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0

            def made(rows: list[tuple[int, int, str, str]], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                at, idx, speaker, line = zip(*rows, strict=True)
                kept = batch.select(keep).take(pa.array(at, pa.int32()))
                return pa.RecordBatch.from_arrays([*kept.columns, pa.array(idx, pa.int32()), pa.array(speaker, pa.string()), pa.array(line, pa.string())], names)

            for i, script in enumerate(batch.column(text)):
                for j, (speaker, line) in enumerate(_speeches(script.as_py())):
                    rows.append((i, j, speaker, line))
                    size += len(line)
                    if size > _BATCH:
                        yield made(rows)
                        rows, size = [], 0
            if rows:
                yield made(rows)

    scripts = df.where(F.col(text).isNotNull()).select(*dict.fromkeys([*keep, text]))
    return scripts.mapInArrow(walked, scans.schema_of(scripts.select(*keep), line_idx="int", speaker="string", line="string"))


def _held(line: Column, mark: str, read: Column, otherwise: Column) -> Column:
    """Patterns look only at lines that hold their first letter."""
    return F.when(~reduce(lambda a, b: a | b, [F.contains(line, F.lit(c)) for c in mark]), otherwise).otherwise(read)


def mood(line: Column | str) -> Column:
    """The first mood that a tag names, in lower case; null without one."""
    t = T.col(line)
    return _held(t, "[", F.nullif(F.lower(F.regexp_extract(t, MOOD, 1)), F.lit("")), F.lit(None).cast("string"))


def without_mood(line: Column | str) -> Column:
    """Without its mood tags; a line without any stays as it is."""
    t = T.col(line)
    return _held(t, "[", F.when(t.rlike(MOOD), T.strip(F.regexp_replace(t, MOOD, ""))).otherwise(t), t)


def directions(line: Column | str) -> Column:
    """What stands in brackets, moods left out, joined by semicolons."""
    t = T.col(line)
    found = F.transform(F.regexp_extract_all(t, F.lit(DIRECTION), F.lit(0)), lambda d: F.substring(d, F.lit(2), F.length(d) - 2))
    return _held(t, "[(", F.array_join(F.filter(found, lambda d: ~F.concat(F.lit("["), d, F.lit("]")).rlike(f"^{MOOD}")), "; "), F.lit(""))


def without_directions(line: Column | str) -> Column:
    t = T.col(line)
    cut = T.strip(_held(t, "[(", F.regexp_replace(t, DIRECTION, ""), t))
    # Most lines have single spaces only, which a range of characters tells sooner than white space does.
    return T.let(cut, lambda x: F.when(F.contains(x, F.lit("  ")) | x.rlike(r"[\t-\r\x85\xa0\u1680-\u3000]"), F.regexp_replace(x, r"(?U)\s+", " ")).otherwise(x))


def speakers(rows: DataFrame, keep: list[str], config: DataFrame, voices: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """keep, speaker, gender, voice, speed, pitch_shift of each speaker of lines(): from config(CONFIG) by name; who has no
    voice there takes the least used of the pool of their gender, in the order in which they first speak, those without a gender from both pools in turn."""
    cast = rows.groupBy(*keep, "speaker").agg(F.min("line_idx").alias("first_idx"))
    known = config.groupBy(F.col("name").alias("speaker")).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("gender", "voice", "speed", "pitch_shift")])
    named = cast.join(known, "speaker", "left").withColumn("gender", F.when(F.lower("gender") == "male", "M").when(F.lower("gender") == "female", "F"))
    pooled = casting.pooled(named.where("voice is null").drop("voice"), keep, "first_idx", voices or VOICES)
    out = named.where("voice is not null").unionByName(pooled)
    return out.select(*keep, "speaker", "gender", "voice", F.coalesce("speed", F.lit(1.0)).alias("speed"), F.coalesce("pitch_shift", F.lit(0.0)).alias("pitch_shift"))


def conversation(df: DataFrame, keep: list[str], config: DataFrame, text: str = "text") -> DataFrame:
    """line_idx, speaker, text, emotion, direction, gender, voice, speed, pitch_shift: scripts ready to be spoken. keep names one script each; null is a key like others."""
    rows = staged(lines(df, keep, text), "lines")  # read for the speakers and for what they say
    cut = rows.select(*keep, "line_idx", "speaker", mood("line").alias("emotion"), without_mood("line").alias("_line"))
    cut = cut.select(*keep, "line_idx", "speaker", without_directions("_line").alias("text"), "emotion", directions("_line").alias("direction"))
    return scans.meet(cut, speakers(rows, keep, config), [*keep, "speaker"]).select(*keep, "line_idx", "speaker", "text", "emotion", "direction", "gender", "voice", "speed", "pitch_shift")


def statistics(rows: DataFrame, keep: list[str]) -> DataFrame:
    """lines, participants and words of each conversation, and its lines by speaker, the most first."""
    by = rows.groupBy(*keep, "speaker").agg(F.count(F.lit(1)).alias("n"), F.sum(T.word_count("text")).alias("words"), F.min("line_idx").alias("first"))
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "first", "speaker", "n"))), lambda z: F.struct(z["speaker"].alias("speaker"), z["n"].alias("n")))
    return by.groupBy(*keep).agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("participants"), F.sum("words").alias("words"), ranked.alias("by_speaker"))
