"""Who says what in running text: quotes and dashes cut out with their surroundings, then given to speakers.

Cutting works on a text's own row. Speakers are told from the words around a quote where these name one; what is left
depends on who has spoken so far, so the quotes of a key are folded in order, with the names heard so far as the state.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import scans
from .attribution import VERBS, explicit_speaker, pronoun_speaker

QUOTE = r'«[^»]+»|"[^"]+"|“[^”]+”'
REACH = 100  # characters of context on either side
DASH = r"(?dU)^[—–-]\s*(.+)$"
NAME = "[A-ZÀÂÄÉÈÊËÏÎÔÙÛÜÇ][a-zàâäéèêëïîôùûüç]+"


def unquoted(quote: Column) -> Column:
    """Without quotation marks and white space at either end."""
    return F.regexp_replace(quote, '(?U)^[«»"“”\\s]+|[«»"“”\\s]+$', "")


def _spoken_runs(text: Column) -> Column:
    """Quotes and what lies between them, as struct(segment, is_dialogue), blanks dropped."""
    pieces = F.regexp_extract_all(text, F.lit(rf'{QUOTE}|(?:(?!{QUOTE})(?s:.))+'), F.lit(0))
    spoken = lambda p: p.rlike(rf"^(?:{QUOTE})$")
    made = F.transform(pieces, lambda p: F.struct(F.when(spoken(p), unquoted(p)).otherwise(T.strip(p)).alias("segment"), spoken(p).alias("is_dialogue")))
    return F.filter(made, lambda s: s["segment"] != "")


def dashed(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """seg_idx, segment, is_dialogue: lines that begin with a dash are spoken; the lines between them are
    joined and cut at their quotes."""
    opens, closes = "\x02", "\x01"
    lines = F.filter(F.transform(F.split(F.translate(T.col(text), opens + closes, ""), "\n"), T.strip), lambda x: x != "")
    # A spoken line stands between two marks, so that one split gives the runs.
    laid = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(DASH), F.concat(F.lit(opens), T.strip(F.regexp_extract(x, DASH, 1)), F.lit(closes))).otherwise(x)), " ")
    runs = F.filter(F.split(laid, rf" ?{closes} ?| ?(?={opens})"), lambda r: r != "")
    cut = F.transform(runs, lambda r: F.when(F.startswith(r, F.lit(opens)), F.array(F.struct(F.substring(r, F.lit(2), F.length(r)).alias("segment"), F.lit(True).alias("is_dialogue")))).otherwise(_spoken_runs(r)))
    return df.select(*keep, F.posexplode(F.filter(F.flatten(cut), lambda s: s["segment"] != "")).alias("seg_idx", "s")).select(*keep, "seg_idx", "s.segment", "s.is_dialogue")


def quotes(df: DataFrame, keep: list[str], text: str = "text", reach: int = REACH) -> DataFrame:
    """quote_idx, quote, context of each quote; context: `reach` characters before it and after it, a space between."""
    t = T.col(text)
    # Every piece has a character at least, so that many pieces on either side hold the context.
    pieces = F.regexp_extract_all(t, F.lit(rf'{QUOTE}|[^«"“]+|[«"“]'), F.lit(0))
    near = lambda p, a, n: F.array_join(F.slice(p, a, F.greatest(n, F.lit(0))), "")
    around = lambda p, i: F.concat_ws(" ", F.right(near(p, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))), F.lit(reach)), F.left(near(p, i + 2, F.lit(reach)), F.lit(reach)))
    found = T.let(pieces, lambda p: F.filter(F.transform(p, lambda x, i: F.when(x.rlike(rf"^(?:{QUOTE})$"), F.struct(unquoted(x).alias("quote"), around(p, i).alias("context")))), lambda s: s.isNotNull()))
    return df.select(*keep, F.posexplode(found).alias("quote_idx", "q")).select(*keep, "quote_idx", "q.quote", "q.context")


def attributed(rows: DataFrame, keys: list[str], order: list[str], quote: str = "quote", context: str = "context") -> DataFrame:
    """rows with speaker, method, confidence, gender.

    A name beside a verb of speech decides. A pronoun takes the first speaker heard of its gender, or stands for
    it in brackets. Otherwise those heard so far speak in turn, from the one who spoke last; a single one goes on; with none the
    speaker is UNKNOWN.
    """
    both = F.concat_ws(" ", context, quote)
    told = rows.withColumn("_named", explicit_speaker(both)).withColumn("_pronoun", pronoun_speaker(both))

    def step(state: scans.State, part: pa.RecordBatch) -> tuple[scans.State, dict[str, pa.Array]]:
        heard, genders, last = state or ([], {}, None)
        out = []
        for named, pronoun in zip(part.column("_named").to_pylist(), part.column("_pronoun").to_pylist(), strict=True):
            if named:
                speaker, gender, row = named["name"], named["gender"], ("explicit", named["confidence"])
            elif pronoun:
                gender = pronoun["gender"]
                speaker = next((n for n, g in genders.items() if g == gender), None)
                if speaker is None:
                    out.append((f"[{gender}]", "pronoun", pronoun["confidence"] * 0.7, gender))
                    continue
                row = ("pronoun", pronoun["confidence"] * 0.9)
            elif len(heard) >= 2:
                speaker = heard[(heard.index(last) + 1) % len(heard)]
                gender, row = genders.get(speaker), ("alternation", 0.6)
            elif last:
                out.append((last, "context", 0.4, genders.get(last)))
                continue
            else:
                out.append(("UNKNOWN", "unknown", 0.0, None))
                continue
            if speaker not in heard:
                heard = [*heard, speaker]
            last, genders = speaker, genders | {speaker: gender} if gender else genders
            out.append((speaker, *row, gender))
        types = {"speaker": pa.string(), "method": pa.string(), "confidence": pa.float64(), "gender": pa.string()}
        return (heard, genders, last), {n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate(types.items())}

    done = scans.folded(told, keys, order, step, speaker="string", method="string", confidence="double", gender="string")
    return done.drop("_named", "_pronoun")


def narrated(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """seg_idx, segment, speaker, is_dialogue: quotes with their speakers and what is told between them.

    The speaker is named after the quote or in it; else the last one named goes on; UNKNOWN before any. What follows
    a quote is told by NARRATOR without its verbs of speech and a name that leads it, if more than ten characters are left.
    """
    parts, said = F.split(T.col(text), QUOTE, -1), F.regexp_extract_all(T.col(text), F.lit(QUOTE), F.lit(0))
    turns = F.transform(F.sequence(F.lit(0), F.size(said)), lambda i: F.struct(F.get(said, i - 1).alias("quote"), F.get(parts, i).alias("after")))
    rows = df.select(*keep, F.posexplode(turns).alias("_turn", "t")).select(*keep, "_turn", unquoted(F.col("t.quote")).alias("_quote"), T.strip("t.after").alias("_after"))
    named = F.coalesce(explicit_speaker("_after"), explicit_speaker("_quote"))
    rows = rows.withColumn("_named", F.when(F.col("_turn") > 0, named["name"]))
    so_far = Window.partitionBy(*keep).orderBy("_turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_speaker", F.coalesce(F.last("_named", ignorenulls=True).over(so_far), F.lit("UNKNOWN")))
    bare = F.regexp_replace(F.regexp_replace("_after", rf"(?iuU)\b(?:{'|'.join(VERBS)})\b", ""), rf"(?U)^\s*{NAME}\.?\s*", "")
    bare = F.regexp_replace(bare, "^[ ,.]+|[ ,.]+$", "")
    told = F.when(F.col("_turn") == 0, F.col("_after")).when(F.length(bare) > 10, bare).otherwise("")
    made = lambda s, who, spoken: F.struct(s.alias("segment"), who.alias("speaker"), F.lit(spoken).alias("is_dialogue"))
    both = F.filter(F.array(made(F.coalesce("_quote", F.lit("")), F.col("_speaker"), True), made(told, F.lit("NARRATOR"), False)), lambda s: s["segment"] != "")
    out = rows.select(*keep, "_turn", F.posexplode(both).alias("_i", "s"))
    place = F.row_number().over(Window.partitionBy(*keep).orderBy("_turn", "_i")) - 1
    return out.select(*keep, place.alias("seg_idx"), "s.segment", "s.speaker", "s.is_dialogue")
