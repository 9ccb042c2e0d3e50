"""The extended narration plan: the plain one with corrected words, styles, exaggeration, mixed voices, human pauses and breaths.

Each step adds columns to the rows of `narration.narrated`; nothing is computed twice and rows stay as they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prosody as P
from ..functions import text as T
from ..operators import breaths, casting, dictionary
from . import narration


def extended(chapters: DataFrame, keys: list[str], text: str = "content", entries: DataFrame | None = None, voice: Column | None = None, style: str | None = None, intensity: float = 0.5, exaggeration: float = 0.5) -> DataFrame:
    """narrated() rows with style, styled speed, pitch and volume, voice, clause, pauses as a person makes them, emphasis and breaths.

    entries: a dictionary of corrections (see operators.dictionary); voice: each sentence's voice; style: one for all, else each takes that of its
    context. What varies by chance elsewhere is drawn from the keys, so a plan is the same in every run.
    """
    if entries is not None:
        chapters = dictionary.rewritten(chapters.drop("n_replaced"), entries, text, closing=True).drop("n_replaced")
    rows = narration.narrated(chapters, keys, text)
    at = [*map(F.col, keys), F.col("sent_idx")]
    own = F.lit(style) if style else F.coalesce(P.style_for("narrative", "emotion", "is_dialogue"), F.lit("storytelling"))
    # Breaths between what is told by the text and what is drawn: as one step these would make a method too long to be compiled.
    voiced = P.blended_voice(F.lit(casting.NARRATOR) if voice is None else voice, "emotion", "intensity")
    rows = rows.withColumns({"style": own, "clause": T.clause_type("sentence"), "voice": voiced, "words": T.word_count("sentence")})
    rows = breaths.breath_markers(rows, keys, "sent_idx", laid=True)
    rows = rows.withColumn("_felt", P.exaggerated(F.lit(intensity), "emotion", exaggeration))
    told = P.styled("style", F.col("final_speed") * F.col("_felt.speed"), F.col("_felt.pitch") + F.col("tags.pitch"), F.col("_felt.volume") * F.col("tags.volume"), *at)
    rows = rows.withColumn("_told", told).withColumns({n: F.col(f"_told.{n}") for n in ("speed", "pitch", "volume")}).drop("_felt", "_told")
    rows = rows.withColumns(
        {
            "human_before": P.humanised_pause("pause_before", *at, F.lit("before")),
            "human_after": P.humanised_pause("pause_after", *at, F.lit("after")),
            "spoken": P.emphasis_pauses("sentence"),
        }
    )
    return rows.withColumn("has_emphasis", F.col("spoken") != F.col("sentence"))
