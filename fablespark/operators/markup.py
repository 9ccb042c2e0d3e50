"""Markup inside a text that governs single words: emphasis, speed, pitch, volume and pauses.

Tags of a kind match like brackets within the text of their row, so nothing is shuffled: a task finds them in one pass over a text and
hands on a row a word with the effects that hold for it as bits, of which SQL functions make numbers. A word is governed by every kind
that is open around it.

What is defined where the markup is not tidy: kinds match each by themselves, so tags may overlap; a kind that is open more than
once counts once; an opening tag without a close, and a close without an opening, stay in the text as words; `*` and
`_` open and close in turn, and a last one without a partner stays. A pause lengthens the word before
it; before the first word it is dropped. Null texts have no words; curves() needs texts that differ in their keys.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import scans

# What each kind of tag does to speed, pitch (semitones), volume and the pause before its first word, and words that stress themselves.
EFFECTS = {
    "em": (0.92, 0.5, 1.1, 0.05),
    "slow": (0.8, 0.0, 1.0, 0.0),
    "fast": (1.2, 0.0, 1.0, 0.0),
    "high": (1.0, 2.0, 1.0, 0.0),
    "low": (1.0, -2.0, 1.0, 0.0),
    "whisper": (0.9, 0.0, 0.6, 0.0),
    "loud": (1.0, 0.3, 1.3, 0.0),
}
PAUSE = 0.15
AUTO_EMPHASIS = (
    "jamais", "toujours", "absolument", "vraiment", "totalement", "completement", "parfaitement", "exactement", "certainement",
    "soudain", "soudainement", "brusquement", "subitement", "enfin", "finalement", "desormais",
    "mais", "cependant", "pourtant", "neanmoins", "toutefois", "or", "donc", "ainsi", "alors",
    "rien", "personne", "aucun", "aucune", "meme", "seul", "unique", "premier", "dernier", "terrible", "incroyable", "extraordinaire",
)
TAG = r"</?(?:em|slow|fast|high|low|whisper|loud|soft)>|<pitch\s+(?:high|low)>|</pitch>|<pause\s*/?>|\[pause(?::\d+\.?\d*)?\]|[*_]"


#: Java's white space under (?U), for patterns that run in Python.
_SPACE = re.escape(T.SPACES)
_TAG = re.compile(TAG.replace(r"\s", f"[{_SPACE}]"), re.IGNORECASE)
_EXACT = re.compile(f"(?:{TAG.replace(r"\s", f"[{_SPACE}]")})\\Z")
_WORD = re.compile(f"[^{_SPACE}]+")
_BITS = {e: 1 << i for i, e in enumerate(EFFECTS)}
ROWS = 1 << 14  # words in a batch that a task hands on
STEP = 256  # blocks of a curve in one


@lru_cache(maxsize=4096)
def _meaning(tag: str) -> tuple[str | None, int, str | None, float | None]:
    """kind (brackets that match each other), 1 or -1, effect and pause of a tag; neither kind nor pause for what only looks like one."""
    low = tag.lower()
    if not _EXACT.match(low):
        return None, 0, None, None
    if low.startswith(("<pause", "[pause")):
        length = re.search(r":([0-9]+\.?[0-9]*)", low)
        return None, 0, None, float(length[1]) if length else PAUSE
    if low in "*_":
        return low, 0, "em", None
    name = re.match(r"</?([a-z]+)", low)[1]
    kind = "whisper" if name == "soft" else name
    effect = kind if name != "pitch" else low[:-1].split()[-1] if low[1] != "/" else None
    return kind, -1 if low[1] == "/" else 1, effect, None


def _cuts(text: str) -> list[list]:
    """[start, end, effect, 1, -1 or 0, pause] of each pause and each tag with a partner, in order; a close has its partner's effect."""
    found, open_ = [], {}
    for m in _TAG.finditer(text):
        kind, turn, effect, pause = _meaning(m[0])
        if pause is not None:
            found.append([*m.span(), None, 0, pause])
        elif kind is not None:
            waiting = open_.setdefault(kind, [])
            if turn > 0 or (turn == 0 and not waiting):
                waiting.append([*m.span(), effect, 0, 0.0])
                found.append(waiting[-1])
            elif waiting:
                partner = waiting.pop()
                partner[3] = 1
                found.append([*m.span(), partner[2], -1, 0.0])
    return [f for f in found if f[3] or f[2] is None]


def _governed(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, word_idx, word, effects (bits of those that hold), lead and pause of the tags right before and after it: a row a word."""
    leads = {e: v[3] for e, v in EFFECTS.items()}
    schema = scans.schema_of(texts.select(*keys), word_idx="int", word="string", effects="int", lead="double", pause="double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, said, effects, lead, pause = [], [], [], [], [], []

            def made() -> Iterator[pa.RecordBatch]:
                columns = [pa.array(row, pa.int32()), pa.array(at, pa.int32()), pa.array(said, pa.string()), pa.array(effects, pa.int32()), pa.array(lead, pa.float64()), pa.array(pause, pa.float64())]
                whole = pa.RecordBatch.from_arrays([*(batch.column(k).take(columns[0]) for k in keys), *columns[1:]], [*keys, "word_idx", "word", "effects", "lead", "pause"])
                for i in range(0, len(whole), ROWS):
                    yield whole.slice(i, ROWS)
                for c in (row, at, said, effects, lead, pause):
                    c.clear()

            for r, t in enumerate(batch.column("_text").to_pylist()):
                if t is None:
                    continue
                depth, bits, n, start, ahead, rest = dict.fromkeys(EFFECTS, 0), 0, 0, 0, 0.0, 0.0
                for a, b, effect, turn, length in [*_cuts(t), [len(t), len(t), None, 0, 0.0]]:
                    words = _WORD.findall(t, start, a)
                    if words:
                        if n:
                            pause[-1] = rest
                        k = len(words)
                        row += [r] * k
                        at += range(n, n + k)
                        said += words
                        effects += [bits] * k
                        lead.append(ahead)
                        lead += [0.0] * (k - 1)
                        pause += [0.0] * k
                        n, ahead, rest = n + k, 0.0, 0.0
                    start, rest = b, rest + length
                    if turn:
                        depth[effect] += turn
                        bits = bits | _BITS[effect] if depth[effect] else bits & ~_BITS[effect]
                        ahead = max(ahead, leads[effect]) if turn > 0 else ahead
                if n:
                    pause[-1] = rest
                if len(row) >= ROWS:
                    yield from made()
            yield from made()

    return texts.select(*keys, F.col(text).alias("_text")).mapInArrow(run, schema)


def words(texts: DataFrame, keys: list[str], text: str = "text", auto: bool = True, strength: float = 1.0) -> DataFrame:
    """keys, word_idx, word, speed, pitch, volume, pause_before, pause_after, is_emphasis, is_whisper."""
    rows = _governed(texts, keys, text)
    plain = F.regexp_replace(F.lower("word"), r"[^\p{L}\p{N}_]", "")
    rows = rows.withColumn("_auto", ((F.col("effects") == 0) & plain.isin(*AUTO_EMPHASIS)) if auto else F.lit(False))
    held = lambda e: F.col("effects").bitwiseAND(_BITS[e]) != 0
    on = lambda e: (held(e) | F.col("_auto")) if e == "em" else held(e)
    product = lambda i: reduce(lambda a, b: a * b, [F.when(on(e), v[i]).otherwise(1.0) for e, v in EFFECTS.items()])
    pitch = reduce(lambda a, b: a + b, [F.when(on(e), v[1] * strength).otherwise(0.0) for e, v in EFFECTS.items()])
    before = F.when(F.col("_auto"), EFFECTS["em"][3]).otherwise(F.col("lead"))
    return rows.select(
        *keys, "word_idx", "word", product(0).alias("speed"), pitch.alias("pitch"), product(2).alias("volume"),
        before.alias("pause_before"), F.col("pause").alias("pause_after"), on("em").alias("is_emphasis"), on("whisper").alias("is_whisper"),
    )


def clean_text(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, clean: each text without its tags, unmatched ones kept; null for a null text."""

    def cleaned(t: str) -> str:
        cuts = _cuts(t)
        return "".join(t[a:b] for a, b in zip([0, *(c[1] for c in cuts)], [*(c[0] for c in cuts), len(t)], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [None if t is None else cleaned(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(clean, pa.string())], [*keys, "clean"])

    return texts.select(*keys, F.col(text).alias("_text")).mapInArrow(run, scans.schema_of(texts.select(*keys), clean="string"))


def emphasised(text: Column | str, stressed: list[str]) -> Column:
    """Each of the words, whatever its case, between <em> and </em>; one word after the other."""
    return reduce(lambda t, w: F.regexp_replace(t, rf"(?iuU)\b(\Q{w}\E)\b", "<em>$1</em>"), stressed, T.col(text))


def curves(texts: DataFrame, rows: DataFrame, keys: list[str], samples: str = "samples", block: int = 4096) -> DataFrame:
    """keys, block, pitch, volume, speed: what holds at each sample of a text, in arrays of at most `block` samples.

    texts: keys, samples (how many); rows: as words() gives them. A word holds for its share of all characters. Its
    span is cut at the edges of blocks, so a curve is never one row and a long word is many pieces.
    """
    # A text's own row, before its words, tells how many samples it has, so that words meet it in the one sort that they need anyway.
    shape = [*keys, "word_idx", "_size", "pitch", "volume", "speed", "_samples"]
    sizes = rows.select(*keys, "word_idx", F.length("word").alias("_size"), "pitch", "volume", "speed", F.lit(None).cast("long").alias("_samples"))
    own = texts.select(*keys, F.lit(-1).alias("word_idx"), F.lit(0).alias("_size"), F.lit(0.0).alias("pitch"), F.lit(1.0).alias("volume"), F.lit(1.0).alias("speed"), F.col(samples).cast("long").alias("_samples"))
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("word_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = own.select(*shape).unionByName(sizes).withColumn("_end", F.sum("_size").over(order)).withColumns({"_all": F.sum("_size").over(whole), "_samples": F.max("_samples").over(whole)})
    at = lambda chars: F.floor(chars / F.col("_all") * F.col("_samples"))
    silent = (F.col("_all") == 0) & (F.col("word_idx") < 0)
    spans = placed.withColumn("_from", F.when(silent, 0).otherwise(at(F.col("_end") - F.col("_size")))).withColumn("_to", F.when(silent, F.col("_samples")).otherwise(at(F.col("_end"))))
    spans = spans.where("_from < _to").select(*keys, "word_idx", "_from", "_to", "pitch", "volume", "speed").sortWithinPartitions(*keys, "word_idx")
    curve = ("pitch", "volume", "speed")

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of the spans, which come in order; those of a key follow one another without gaps."""
        held, start = None, 0  # rows of a block that may go on in the next batch, and where it starts
        for batch in batches:
            if not len(batch):
                continue
            batch = batch if held is None else pa.concat_batches([held, batch])
            cut = [0, *scans._changes(batch, keys).tolist(), len(batch)]
            begin, end = (batch.column(c).to_numpy() for c in ("_from", "_to"))
            for a, b in zip(cut, cut[1:], strict=False):
                first, upto = start if a == 0 and held is not None else int(begin[a]), int(end[b - 1])
                if b == len(batch):
                    start = upto = upto // block * block
                yield from pieces(batch, a, b, first, upto, begin, end)
            held = batch.slice(min(a + int(np.searchsorted(end[a:], start, "right")), len(batch) - 1))
        if held is not None:
            begin, end = (held.column(c).to_numpy() for c in ("_from", "_to"))
            yield from pieces(held, 0, len(held), start, int(end[-1]), begin, end)

    def pieces(batch: pa.RecordBatch, a: int, b: int, first: int, upto: int, begin: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Samples first to upto of the key of rows a to b, at most STEP blocks in a batch."""
        for low in range(first, upto, STEP * block):
            high = min(upto, low + STEP * block)
            i, j = a + int(np.searchsorted(end[a:b], low, "right")), a + int(np.searchsorted(begin[a:b], high, "left"))
            n = np.minimum(end[i:j], high) - np.maximum(begin[i:j], low)
            edges = np.append(np.arange(0, high - low, block), high - low).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(np.repeat(batch.column(c).to_numpy()[i:j], n))) for c in curve]
            of = pa.array(np.full(len(edges) - 1, a))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in keys), pa.array(low // block + np.arange(len(edges) - 1)), *lists], [*keys, "block", *curve])

    return spans.mapInArrow(laid, scans.schema_of(texts.select(*keys), block="bigint", **dict.fromkeys(curve, "array<double>")))
