"""Characters and voices: counts, gender, assignment and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Voice pools by gender; neutral characters share the female pool.
VOICES = {"F": ("ff_siwis", "af_heart", "af_bella", "af_sarah", "bf_emma"), "M": ("am_adam", "am_michael", "bm_george", "bm_lewis")}
NARRATOR = "ff_siwis"


def characters(segments: DataFrame, partition: list[str], speaker: str, order: str) -> DataFrame:
    """name (as first written), occurrences and first position of each speaker, whatever its case."""
    key = F.lower(F.trim(F.col(speaker)))
    return segments.where(F.col(speaker).isNotNull()).groupBy(*partition, key.alias("key")).agg(F.min_by(F.trim(F.col(speaker)), order).alias("name"), F.count(F.lit(1)).alias("occurrences"), F.min(order).alias("first_idx"))


def guessed_gender(name: Column | str) -> Column:
    """By the ending of a first name: F, M or null."""
    low = F.lower(F.col(name) if isinstance(name, str) else name)
    return F.when(low.rlike("(ette|elle|ine|ie|a|e)$"), "F").when(low.rlike("(o|ien|in|er|us|ert|ard)$"), "M")


def assigned(cast: DataFrame, partition: list[str]) -> DataFrame:
    """A voice for each character, most frequent first, in turn from the pool of its gender."""
    pools = F.create_map(*[x for g, v in VOICES.items() for x in (F.lit(g), F.array(*map(F.lit, v)))])
    pool = F.coalesce("gender", F.lit("F"))
    turn = F.row_number().over(Window.partitionBy(*partition, "_pool").orderBy(F.desc("occurrences"), "first_idx", "key"))
    out = cast.withColumn("_pool", F.when(pool.isin(*VOICES), pool).otherwise("F")).withColumn("_turn", turn - 1)
    return out.withColumn("voice", F.element_at(pools[F.col("_pool")], (F.col("_turn") % F.size(pools[F.col("_pool")]) + 1).cast("int"))).drop("_pool", "_turn")


def voiced(segments: DataFrame, cast: DataFrame, partition: list[str], speaker: str) -> DataFrame:
    """Segments with the voice of their speaker, the narrator's where none is assigned."""
    voices = cast.select(*partition, F.col("key").alias("_key"), F.col("voice").alias("_voice"))
    keyed = segments.withColumn("_key", F.lower(F.trim(F.col(speaker))))
    return keyed.join(voices, [*partition, "_key"], "left").withColumn("voice", F.coalesce("_voice", F.lit(NARRATOR))).drop("_key", "_voice")


def attributed(quotes: DataFrame, partition: list[str], order: str) -> DataFrame:
    """speaker and method of each quote from `explicit` names (null where none is given).

    Explicit names count; else, once two have spoken, the one of the last two different explicit
    speakers who did not speak last; else the last speaker; else UNKNOWN. The state is the last
    explicit name and the one before it that differs, both plain window values.
    """
    w = Window.partitionBy(*partition).orderBy(order)
    rows = quotes.withColumn("_last", F.last("explicit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_turned", F.when(F.col("explicit").isNotNull() & (F.col("explicit") != F.col("_last")), F.col("_last")))
    rows = rows.withColumn("_other", F.last("_turned", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_since", F.sum(F.col("explicit").isNotNull().cast("int")).over(w))
    rows = rows.withColumn("_silent", F.row_number().over(Window.partitionBy(*partition, "_since").orderBy(order)) - F.when(F.col("_since") > 0, 1).otherwise(0))
    speaker = (
        F.when(F.col("explicit").isNotNull(), F.col("explicit"))
        .when(F.col("_other").isNotNull(), F.when(F.col("_silent") % 2 == 1, F.col("_other")).otherwise(F.col("_last")))
        .when(F.col("_last").isNotNull(), F.col("_last"))
        .otherwise("UNKNOWN")
    )
    method = F.when(F.col("explicit").isNotNull(), "explicit").when(F.col("_other").isNotNull(), "alternation").when(F.col("_last").isNotNull(), "last_speaker").otherwise("unknown")
    return rows.withColumn("speaker", speaker).withColumn("method", method).drop("_last", "_turned", "_other", "_since", "_silent")


def pooled(cast: DataFrame, partition: list[str], order: str, pools: dict[str, tuple[str, ...]]) -> DataFrame:
    """The least used voice of each speaker's pool, the first listed of equals.

    A speaker without gender takes the pools by turns, by place in the order of speakers. Which pool a
    speaker takes depends on that place alone, so the least used voice is the next one in its pool.
    """
    place = F.row_number().over(Window.partitionBy(*partition).orderBy(order)) - 1
    pool = F.when(F.col("gender").isin("M", "F"), F.col("gender")).otherwise(F.when(place % 2 == 0, "M").otherwise("F"))
    turn = F.row_number().over(Window.partitionBy(*partition, "_pool").orderBy(order)) - 1
    voices = F.create_map(*[x for g, v in pools.items() for x in (F.lit(g), F.array(*map(F.lit, v)))])
    out = cast.withColumn("_pool", pool).withColumn("_turn", turn)
    return out.withColumn("voice", F.get(voices[F.col("_pool")], F.pmod("_turn", F.size(voices[F.col("_pool")])).cast("int"))).drop("_pool", "_turn")


def picked(catalog: DataFrame, asked: DataFrame, keys: list[str], fallback: str) -> DataFrame:
    """For each row of asked(keys, lang, gender) a voice of the catalogue: of its language and gender, else of its language, else the fallback.

    catalog(id, ord, lang, gender): languages match by prefix; the first by ord counts.
    """
    fits = F.col("c.lang").startswith(F.col("a.lang"))
    rows = asked.alias("a").join(catalog.alias("c"), fits, "left")
    best = F.min_by("c.id", F.struct((F.col("c.gender") != F.col("a.gender")).alias("other"), F.col("c.ord")))
    return rows.groupBy(*[F.col(f"a.{k}") for k in keys]).agg(F.coalesce(best, F.lit(fallback)).alias("voice"))
