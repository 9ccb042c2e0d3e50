"""Where a narrator breathes: words add up until they pass a threshold that is drawn anew at each breath.

The state between two rows is one of a few: how many words are left (and, where the kind of breath matters,
the threshold in force). So a run of rows is a table from the state before to the state after it; tables compose,
and the scan over a text is made of runs of RUN rows each in its own task. Thresholds are draws from the
keys of the row at which the breath is taken, so results repeat whatever the partitioning.

rows: keys, order (a whole number, unique in a key), words (their number). Edge cases: null words count as none; an empty table gives no
rows; rows that share keys and order are taken as they come.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans

WORDS_PER_BREATH = 20
LEAST, MOST = 0.7, 1.3  # a threshold lies between these shares of the mean
RUN = 2048
LONG_SENTENCE = 25
STRONG, TENSE = ("high", "extreme"), ("suspense", "fear")


def drawn(words_per_breath: int, *key: Column) -> Column:
    """A threshold that depends on the key alone: the first 32 bits of its digest as a share."""
    share = F.conv(F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("double") / 2**32
    return F.floor(words_per_breath * (LEAST + (MOST - LEAST) * share)).cast("int")


def _scanned(rows: DataFrame, keys: list[str], order: str, states: int, start: Column, advance: Callable[[np.ndarray, int, int], tuple[np.ndarray, np.ndarray]], one: Callable[[int, int, int], tuple[int, int]], out: str) -> DataFrame:
    """rows with `out`: the code that advance gives for each of them.

    rows hold _words and _draw; start is the state before a key's first row; advance(states, words, draw) gives the
    states after a row and its codes, one the same for a single state, in plain numbers.
    """
    runs = rows.withColumn("_run", F.floor(F.col(order) / RUN))
    group = [*keys, "_run"]
    # Most keys have one run, which begins in the start state: only the others need tables.
    some = runs.where("_run <> 0").select(*keys).distinct()
    slim = scans.meet(runs.select(*group, order, "_words", "_draw"), some, keys, "left_semi")

    def change(state: np.ndarray | None, part: pa.RecordBatch) -> np.ndarray:
        now = np.arange(states) if state is None else state.astype(np.int64)
        for words, draw in zip(part.column("_words").to_pylist(), part.column("_draw").to_pylist(), strict=True):
            now, _ = advance(now, words, draw)
        return now.astype(np.float64)

    def replay(state: int | None, part: pa.RecordBatch) -> tuple[int, dict[str, pa.Array]]:
        codes = []
        if state is None:
            first, before = part.column("_start")[0].as_py(), part.column("before")[0].as_py()
            state = int(before[first]) if before else first
        for words, draw in zip(part.column("_words").to_pylist(), part.column("_draw").to_pylist(), strict=True):
            state, code = one(state, words, draw)
            codes.append(code)
        return state, {out: pa.array(codes, pa.int32())}

    changes = scans.reduced(slim, group, [order], change, "change", "array<double>")
    before = scans.prefixes(changes, keys, "_run", lambda a, b: b[a.astype(np.int64)], list(map(float, range(states))))
    entered = scans.meet(runs, before, group, "left").withColumn("_start", start)
    return scans.folded(entered, group, [order], replay, **{out: "int"}).drop("before", "_start", "_words", "_draw", "_run")


def _previous(rows: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """`out`: the value of the row before, where no task sorts more than a run or the list of runs."""
    runs = rows.withColumn("_run", F.floor(F.col(order) / RUN))
    ends = runs.groupBy(*keys, "_run").agg(F.max_by(value, order).alias("_end"))
    ends = ends.select(*keys, "_run", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_run")).alias("_end"))
    within = Window.partitionBy(*keys, "_run").orderBy(order)
    marked = scans.meet(runs, ends, [*keys, "_run"])
    return marked.withColumn(out, F.when(F.row_number().over(within) == 1, F.col("_end")).otherwise(F.lag(value).over(within))).drop("_run", "_end")


def breath_markers(rows: DataFrame, keys: list[str], order: str, words: str = "words", words_per_breath: int = WORDS_PER_BREATH, laid: bool = False) -> DataFrame:
    """rows(emotion, intensity, words) with breath_before: before a strong change of emotion, before tense
    passages, and where the words since the last breath pass the threshold.

    laid: rows lie by key and in order (see scans.laid), and are passed over once as they lie.
    """
    most = int(words_per_breath * MOST)
    ready = rows.withColumn("_words", F.coalesce(F.col(words), F.lit(0)).cast("int")).withColumn("_draw", drawn(words_per_breath, *map(F.col, keys), F.col(order)))

    def advance(left: np.ndarray, n: int, draw: int) -> tuple[np.ndarray, np.ndarray]:
        over = n > left
        return np.where(over, draw, left - n), over

    def one(left: int, n: int, draw: int) -> tuple[int, int]:
        return (draw, 1) if n > left else (left - n, 0)

    def fold(left: int | None, batch: pa.RecordBatch, opens: np.ndarray) -> tuple[int, list[pa.Array]]:
        over = []
        for words, draw, start, new in zip(*(batch.column(c).to_pylist() for c in ("_words", "_draw", "_start")), opens.tolist(), strict=True):
            left, code = one(start if new else left, words, draw)
            over.append(code)
        return left, [pa.array(over, pa.int32())]

    start = drawn(words_per_breath, *map(F.col, keys), F.lit("start"))
    if laid:
        # The first threshold is drawn for the first row of a text alone, which a generator numbers 0.
        ready = ready.withColumn("_start", F.when(F.col(order) == 0, start))
        out = scans.laid(ready, keys, order, fold, {"_emotion": "emotion"}, _over="int").drop("_words", "_draw", "_start")
    else:
        out = _previous(_scanned(ready, keys, order, most + 1, start, advance, one, "_over"), keys, order, "emotion", "_emotion")
    changed = F.col("_emotion").isNotNull() & (F.col("_emotion") != F.col("emotion")) & F.col("intensity").isin(*STRONG)
    tense = F.col("emotion").isin(*TENSE) & (F.col("intensity") != "low")
    return out.withColumn("breath_before", (F.col("_over") > 0) | F.coalesce(changed, F.lit(False)) | F.coalesce(tense, F.lit(False))).drop("_over", "_emotion")


def breath_pauses(rows: DataFrame, keys: list[str], order: str, words: str = "words", words_per_breath: int = WORDS_PER_BREATH) -> DataFrame:
    """rows with breath: soft or deep (half as many words again) before a row, once the rows before it have passed
    the threshold; null elsewhere."""
    least, most = int(words_per_breath * LEAST), int(words_per_breath * MOST)
    width = most + 3  # words left, then over, then far over
    soft, deep = most + 1, most + 2
    ready = rows.withColumn("_words", F.coalesce(F.col(words), F.lit(0)).cast("int")).withColumn("_draw", drawn(words_per_breath, *map(F.col, keys), F.col(order)))

    def advance(state: np.ndarray, n: int, draw: int) -> tuple[np.ndarray, np.ndarray]:
        threshold, left = state // width + least, state % width
        code = np.where(left == deep, 2, np.where(left == soft, 1, 0))
        threshold = np.where(code > 0, draw, threshold)
        said = np.where(code > 0, 0, threshold - np.minimum(left, threshold)) + n
        place = np.where(said <= threshold, threshold - said, np.where(said > threshold * 1.5, deep, soft))
        return (threshold - least) * width + place, code

    def one(state: int, n: int, draw: int) -> tuple[int, int]:
        threshold, left = state // width + least, state % width
        code = 2 if left == deep else 1 if left == soft else 0
        threshold = draw if code else threshold
        said = (0 if code else threshold - min(left, threshold)) + n
        place = threshold - said if said <= threshold else deep if said > threshold * 1.5 else soft
        return (threshold - least) * width + place, code

    first = drawn(words_per_breath, *map(F.col, keys), F.lit("start"))
    out = _scanned(ready, keys, order, (most - least + 1) * width, (first - least) * width + first, advance, one, "_code")
    return out.withColumn("breath", F.when(F.col("_code") == 2, "deep").when(F.col("_code") == 1, "soft")).drop("_code")


def breathing_sentence(sentence: Column | str) -> Column:
    """A sentence of more than LONG_SENTENCE words with a soft breath at its middle comma."""
    s = F.col(sentence) if isinstance(sentence, str) else sentence
    parts, n = F.split(s, ",", -1), F.size(F.regexp_extract_all(s, F.lit(r"(?U)\S+"), F.lit(0)))
    middle = F.floor(F.size(parts) / 2).cast("int")
    marked = F.transform(parts, lambda p, i: F.when(i == middle, F.concat(F.lit("[breath:soft] "), F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))).otherwise(p))
    return F.when((n > LONG_SENTENCE) & (F.size(parts) > 1), F.array_join(marked, ", ")).otherwise(s)
