"""Further named queries: speakable text, lexicons, attribution, chunks, exports, casting and mixing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as Z
from ..functions import prosody as P
from ..functions import signals as S
from ..functions import text as T
from ..operators import attribution, casting, chunking, compliance, emotion, lexicon, segments, timeline
from ..sources import sinks
from .queries import EMOTIONS_SQL, QUOTED_SQL, SENTENCES_SQL, WORDS_SQL, _emotions, _quoted, in_words_sql, query, spread, table

_MONTHS_FR = "['janvier', 'fevrier', 'mars', 'avril', 'mai', 'juin', 'juillet', 'aout', 'septembre', 'octobre', 'novembre', 'decembre']"
_MONTHS_EN = "['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December']"


def _order_text(spark, sf_dir):
    """A sentence full of dates, times, shares, measures, amounts and ordinals for each order."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    text = F.concat(
        F.lit("Le "), F.date_format(d, "dd/MM/yyyy"), F.lit(" a "), (k % 23 + 1).cast("string"), F.lit("h"), F.lpad((k % 59 + 1).cast("string"), 2, "0"), F.lit(":  "), (k % 99 + 1).cast("string"), F.lit("% de "),
        (k % 900 + 1).cast("string"), F.lit(" kg, $"), (k % 400 + 2).cast("string"), F.lit(".50 & le "), (k % 70 + 4).cast("string"), F.lit("th etc."),
    )
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))
    return orders.select("o_orderkey", F.regexp_replace(text, "th etc", "eme etc").alias("fr"), text.alias("en"))


@query(
    "speakable_text",
    f"""WITH {WORDS_SQL}, o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d FROM orders)
SELECT k AS o_orderkey,
  'Le ' || CASE WHEN day(d) = 1 THEN 'premier' ELSE f[day(d) + 1] END || ' ' || {_MONTHS_FR}[month(d)] || ' ' || {in_words_sql("year(d)", "fr")} || ' a ' || f[k % 23 + 2] || CASE WHEN k % 23 = 0 THEN ' heure ' ELSE ' heures ' END || f[k % 59 + 2]
    || ': ' || f[k % 99 + 2] || ' pourcent de ' || f[k % 900 + 2] || ' kilogrammes, ' || f[k % 400 + 3] || ' dollars et cinquante centimes et le ' || f[k % 70 + 5] || 'ieme et cetera' AS french,
  'Le ' || {_MONTHS_EN}[month(d)] || ' ' || e[day(d) + 1] || ', ' || {in_words_sql("year(d)", "en")} || ' a ' || e[k % 23 + 2] || ' ' || e[k % 59 + 2]
    || ': ' || e[k % 99 + 2] || ' percent de ' || e[k % 900 + 2] || ' kilograms, ' || e[k % 400 + 3] || ' dollar and fifty cents and le ' || e[k % 70 + 5] || 'th et cetera' AS english FROM o, words""",
)
def speakable_text(spark, sf_dir):
    rows = Z.normalized(_order_text(spark, sf_dir), "fr", "fr")
    return Z.normalized(rows, "en", "en").select("o_orderkey", F.col("fr").alias("french"), F.col("en").alias("english"))


@query(
    "spoken_phones",
    f"""WITH {WORDS_SQL}, c AS (SELECT c_custkey, right('000000000' || (c_custkey * 7919 % 1000000000), 9) AS n FROM customer), g AS (SELECT c_custkey, unnest(['0' || n[1], n[2:3], n[4:5], n[6:7], n[8:9]]) AS p, unnest(range(5)) AS i FROM c)
SELECT c_custkey, 'tel ' || string_agg(CASE WHEN p::INT = 0 THEN 'zero' ELSE f[p::INT + 1] END, ' ' ORDER BY i) || ' ok' AS said FROM g, words GROUP BY c_custkey""",
)
def spoken_phones(spark, sf_dir):
    n = F.lpad((F.col("c_custkey") * 7919 % 1000000000).cast("string"), 9, "0")
    written = F.concat(F.lit("tel 0"), F.regexp_replace(n, "^(.)(..)(..)(..)(..)$", "$1 $2.$3-$4$5"), F.lit(" ok"))
    return table(spark, sf_dir, "customer").select("c_custkey", Z.phones(written).alias("said"))


_ROMAN_SQL = "repeat('M', n // 1000) || (['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'])[n // 100 % 10 + 1] || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[n // 10 % 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[n % 10 + 1]"


@query(
    "spoken_centuries",
    f"""WITH {WORDS_SQL}, c AS (SELECT c_custkey, c_custkey % 39 + 1 AS n FROM customer), r AS (SELECT c_custkey, n, {_ROMAN_SQL} AS roman FROM c)
SELECT c_custkey, 'chap ' || CASE WHEN len(roman) = 1 THEN roman || ', ' || roman || 'e mix' ELSE f[n + 1] || ', ' || f[n + 1] || 'ieme mix' END AS said FROM r, words""",
)
def spoken_centuries(spark, sf_dir):
    n = F.col("c_custkey") % 39 + 1
    tens, ones = (F.array(*map(F.lit, x.split(","))) for x in (",X,XX,XXX", ",I,II,III,IV,V,VI,VII,VIII,IX"))
    roman = F.concat(F.get(tens, F.floor(n / 10).cast("int")), F.get(ones, (n % 10).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", Z.romans(F.concat(F.lit("chap "), roman, F.lit(", "), roman, F.lit("e mix"))).alias("said"))


@query(
    "spoken_numbers",
    f"""WITH {WORDS_SQL}, n AS (SELECT p_partkey AS k, p_partkey % 999 + 1 AS a, p_partkey * 7 % 1000 AS b FROM part)
SELECT k AS p_partkey, 'il y a ' || f[a + 1] || ' mille' || CASE WHEN b = 0 THEN '' ELSE ' ' || f[b + 1] END || ' ou ' || f[a + 1] || ' virgule ' || CASE WHEN k % 10 = 0 THEN 'zero' ELSE f[k % 10 + 1] END || ' cinq.' AS said FROM n, words WHERE a > 1
UNION ALL SELECT k, 'il y a mille' || CASE WHEN b = 0 THEN '' ELSE ' ' || f[b + 1] END || ' ou un virgule ' || CASE WHEN k % 10 = 0 THEN 'zero' ELSE f[k % 10 + 1] END || ' cinq.' FROM n, words WHERE a = 1""",
)
def spoken_numbers(spark, sf_dir):
    a, b, k = F.col("p_partkey") % 999 + 1, F.col("p_partkey") * 7 % 1000, F.col("p_partkey")
    written = F.concat(F.lit("il y a "), a.cast("string"), F.lit(" "), F.lpad(b.cast("string"), 3, "0"), F.lit(" ou "), a.cast("string"), F.lit(","), (k % 10).cast("string"), F.lit("5."))
    return table(spark, sf_dir, "part").select("p_partkey", Z.numbers(written).alias("said"))


@query(
    "spoken_links",
    r"""SELECT page_id, 'voir ' || CASE WHEN regexp_matches(url, '^https?://[^\s<>"{}|\\^`\[\]]+$') THEN ' web link ' ELSE url END || ' ou u' || page_id || ' at ex point co point uk' AS said FROM pages""",
)
def spoken_links(spark, sf_dir):
    written = F.concat(F.lit("voir "), F.col("url"), F.lit(" ou u"), F.col("page_id").cast("string"), F.lit("@ex.co.uk"))
    return table(spark, sf_dir, "pages").select("page_id", Z.emails(Z.urls(written, "en"), "en").alias("said"))


def _replace_sql(column: str, lang: str) -> str:
    for sign, words in Z.SYMBOLS[lang].items():
        column = f"regexp_replace(regexp_replace({column}, '(?m)^#+\\s*', '', 'g'), '#([\\p{{L}}\\p{{N}}_])', '\\1', 'g')" if sign == "#" else f"replace({column}, '{sign}', '{words}')"
    return column


@query("spoken_symbols", f"SELECT doc_id, md5({_replace_sql('text', 'en')}) AS digest FROM documents")
def spoken_symbols(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(Z.symbols("text", "en")).alias("digest"))


def _listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _lexicon_sql(lang: str) -> str:
    scores = []
    for name, (_, patterns) in lexicon.LEXICON[lang].items():
        marks = " + ".join(f"0.5 * regexp_matches(text, '(?i){p.replace(chr(39), chr(39) * 2).replace('$', chr(92) + 'n?$')}')::INT" for p in patterns)
        scores.append(f"round(coalesce(list_sum(list_transform(list_filter({_listed(lexicon.keywords(lang, name))}, lambda w: contains(low, w)), lambda w: CASE WHEN starts_with(low, w) OR ends_with(low, w) THEN 1.3 ELSE 1.0 END)), 0)::DOUBLE + {marks}, 6)")
    return f"[{', '.join(scores)}]"


@query(
    "lexicon_emotion",
    f"""WITH t AS (SELECT doc_id, text, strip_accents(lower(text)) AS low FROM documents), s AS (SELECT doc_id, {_lexicon_sql("en")} AS n FROM t)
SELECT doc_id, CASE WHEN list_max(n) > 0 THEN {_listed(lexicon.LEXICON["en"])}[list_position(n, list_max(n))] ELSE 'neutral' END AS emotion, round(least(list_max(n) / 3, 1.0), 4)::DOUBLE AS confidence FROM s""",
)
def lexicon_emotion(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("e", lexicon.lexicon_emotion("text", "en"))
    return rows.select("doc_id", "e.emotion", F.round("e.confidence", 4).alias("confidence"))


@query(
    "lexicon_intensity",
    rf"""WITH {SENTENCES_SQL}, w AS (SELECT doc_id, pos, sentence AS t, strip_accents(lower(sentence)) AS low, list_filter(regexp_split_to_array(sentence, '\s+'), lambda x: x <> '') AS words,
  list_transform(string_split(lower(sentence), chr(10)), lambda l: regexp_extract_all(l, '[\p{{L}}\p{{N}}_]+')) AS lines FROM sentences),
s AS (SELECT doc_id, pos, CASE WHEN regexp_matches(t, '[!?]{{2,}}') THEN 2 WHEN regexp_matches(t, '[!?]') THEN 1 ELSE 0 END + CASE WHEN contains(t, '...') THEN 0.5 ELSE 0 END
  + len(list_filter(words, lambda x: length(x) > 2 AND x = upper(x) AND x <> lower(x))) + len(list_filter({_listed(lexicon.BOOSTERS["fr"])}, lambda b: contains(low, b)))
  + CASE WHEN len(list_filter(lines, lambda l: len(list_distinct(l)) < len(l))) > 0 THEN 0.5 ELSE 0 END AS score FROM w)
SELECT doc_id, pos::INT AS sent_idx, CASE WHEN score >= 4 THEN 'extreme' WHEN score >= 2 THEN 'high' WHEN score >= 1 THEN 'medium' ELSE 'low' END AS intensity FROM s""",
)
def lexicon_intensity(spark, sf_dir):
    return segments.sentences(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "sent_idx", lexicon.lexicon_intensity("sentence", "fr").alias("intensity"))


@query(
    "sound_words",
    f"""WITH r AS (SELECT doc_id, len(list_filter({_listed(lexicon.SOUNDS["fr"])}, lambda s: contains(lower(text), s))) / greatest(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')), 1) AS ratio FROM documents)
SELECT doc_id, round(ratio, 6)::DOUBLE AS ratio, ratio > 0.3 AS found FROM r""",
)
def sound_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("o", lexicon.onomatopoeia("text", "fr")).select("doc_id", F.round("o.ratio", 6).alias("ratio"), "o.found")


@query(
    "french_narrative",
    "SELECT doc_id, "
    + ", ".join(f"len(list_filter({_listed(lexicon.FRENCH_NARRATIVE[k])}, lambda w: contains(lower(text), w)))::INT AS {k}" for k in ("action", "description", "introspection"))
    + ", "
    + ", ".join("(" + " + ".join(f"regexp_matches(lower(text), '{p}')::INT" for p in lexicon.FRENCH_NARRATIVE[k]) + f")::INT AS {k}" for k in ("thoughts", "flashback"))
    + " FROM documents",
)
def french_narrative(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[lexicon.french_hits("text", k).alias(k) for k in lexicon.FRENCH_NARRATIVE])


_CONTEXTS = ("dit Marie.", "Paul murmura", "- demanda-t-il", "elle cria", "et un silence")


def _contexts(spark, sf_dir):
    turn = F.element_at(F.array(*map(F.lit, _CONTEXTS)), ((F.col("turn") + F.col("conv_id")) % 5 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", turn.alias("context"))


@query(
    "explicit_speakers",
    """SELECT conv_id, turn, CASE (turn + conv_id) % 5 WHEN 0 THEN 'Marie' WHEN 1 THEN 'Paul' END AS name, CASE (turn + conv_id) % 5 WHEN 0 THEN 'F' WHEN 1 THEN 'M' END AS gender, CASE (turn + conv_id) % 5 WHEN 0 THEN 0.95 WHEN 1 THEN 0.9 WHEN 3 THEN 0.9 END::DOUBLE AS confidence,
  CASE (turn + conv_id) % 5 WHEN 2 THEN 'M' WHEN 3 THEN 'F' END AS pronoun FROM conversations WHERE (turn + conv_id) % 5 <> 3
UNION ALL SELECT conv_id, turn, 'elle', 'F', 0.9, 'F' FROM conversations WHERE (turn + conv_id) % 5 = 3""",
)
def explicit_speakers(spark, sf_dir):
    """Names beside verbs of speech; a pronoun before such a verb is taken for a name as well."""
    rows = _contexts(spark, sf_dir).select("conv_id", "turn", attribution.explicit_speaker("context").alias("s"), attribution.pronoun_speaker("context").alias("p"))
    return rows.select("conv_id", "turn", "s.name", "s.gender", "s.confidence", F.col("p.gender").alias("pronoun"))


@query(
    "attributed_quotes",
    """WITH RECURSIVE q AS (SELECT conv_id, turn, (conv_id + turn) % 5 AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
e AS (SELECT *, CASE k WHEN 0 THEN 'Marie' WHEN 1 THEN 'Paul' WHEN 3 THEN 'elle' END AS named FROM q),
s AS (SELECT conv_id, 0::BIGINT AS n, NULL::VARCHAR AS last, NULL::VARCHAR AS other, NULL::VARCHAR AS male, 0 AS silent, NULL::VARCHAR AS speaker, NULL::VARCHAR AS method, NULL::VARCHAR AS gender FROM (SELECT DISTINCT conv_id FROM q)
  UNION ALL SELECT conv_id, n, coalesce(told, last), CASE WHEN told IS NOT NULL AND told <> last THEN last ELSE other END, CASE WHEN named = 'Paul' THEN named ELSE male END, CASE WHEN told IS NULL THEN silent + 1 ELSE 0 END,
    CASE WHEN told IS NOT NULL THEN told WHEN other IS NOT NULL THEN CASE WHEN silent % 2 = 0 THEN other ELSE last END ELSE coalesce(last, 'UNKNOWN') END,
    CASE WHEN named IS NOT NULL THEN 'explicit' WHEN told IS NOT NULL THEN 'pronoun' WHEN other IS NOT NULL THEN 'alternation' WHEN last IS NOT NULL THEN 'last_speaker' ELSE 'unknown' END,
    CASE WHEN named IS NOT NULL THEN CASE named WHEN 'Paul' THEN 'M' ELSE 'F' END WHEN k = 2 THEN 'M' ELSE
      CASE WHEN other IS NOT NULL THEN CASE WHEN silent % 2 = 0 THEN CASE other WHEN 'Paul' THEN 'M' ELSE 'F' END ELSE CASE last WHEN 'Paul' THEN 'M' ELSE 'F' END END WHEN last = 'Paul' THEN 'M' WHEN last IS NOT NULL THEN 'F' END END
  FROM (SELECT s.*, e.n AS m, e.k, e.named, coalesce(e.named, CASE WHEN e.k = 2 THEN male END) AS told FROM s JOIN e ON e.conv_id = s.conv_id AND e.n = s.n + 1) AS x(conv_id, n0, last, other, male, silent, speaker, method, gender, n, k, named, told))
SELECT conv_id, turn, speaker, method, gender FROM s JOIN q USING (conv_id, n)""",
)
def attributed_quotes(spark, sf_dir):
    return attribution.attributed(_contexts(spark, sf_dir), ["conv_id"], "turn").select("conv_id", "turn", "speaker", "method", "gender")


@query(
    "name_genders",
    rf"""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS name FROM documents)
SELECT name, CASE WHEN lower(name) IN {tuple(attribution.FEMALE)} THEN 'F' WHEN lower(name) IN {tuple(attribution.MALE)} THEN 'M' WHEN regexp_matches(lower(name), '({'|'.join(attribution.FEMALE_ENDINGS)})$') THEN 'F' WHEN regexp_matches(lower(name), '({'|'.join(attribution.MALE_ENDINGS)})$') THEN 'M' END AS gender,
  regexp_matches(name, '^\p{{Lu}}') AND length(name) >= 2 AND lower(name) NOT IN {tuple(attribution.NO_NAMES)} AS valid FROM n""",
)
def name_genders(spark, sf_dir):
    """Every distinct word of the documents, as if it were a name."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("name")).distinct()
    return words.withColumn("gender", attribution.gender("name")).withColumn("valid", attribution.valid_name("name"))


@query("hierarchical_chunks")
def hierarchical_chunks(spark, sf_dir):
    return chunking.chunks(table(spark, sf_dir, "documents"), ["doc_id"], 200).select("doc_id", "chunk_idx", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"), "is_dialogue", "pause_after")


@query(
    "comma_chunks",
    r"""WITH RECURSIVE p AS (SELECT doc_id, unnest(s) AS part, unnest(range(len(s))) AS i FROM (SELECT doc_id, regexp_split_to_array(text, ',\s*') AS s FROM documents WHERE text IS NOT NULL)),
walk AS (SELECT doc_id, i, 0 AS chunk_idx, length(part) AS size FROM p WHERE i = 0
  UNION ALL SELECT p.doc_id, p.i, CASE WHEN w.size = 0 OR w.size + 2 + length(p.part) <= 300 THEN w.chunk_idx ELSE w.chunk_idx + 1 END, CASE WHEN w.size = 0 THEN length(p.part) WHEN w.size + 2 + length(p.part) <= 300 THEN w.size + 2 + length(p.part) ELSE length(p.part) END
  FROM walk w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1)
SELECT doc_id, chunk_idx::INT AS chunk_idx, max(size)::INT AS n_chars FROM walk GROUP BY doc_id, chunk_idx HAVING max(size) > 0""",
)
def comma_chunks(spark, sf_dir):
    cut = chunking.at_commas(F.col("text"), 300)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(cut).alias("chunk_idx", "chunk")).select("doc_id", "chunk_idx", F.length("chunk").alias("n_chars"))


@query(
    "halved_texts",
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 0 AS half, md5(array_to_string(CASE WHEN len(w) < 4 THEN w ELSE w[1:len(w) // 2] END, ' ')) AS digest FROM w UNION ALL SELECT doc_id, 1, md5(array_to_string(w[len(w) // 2 + 1:], ' ')) FROM w WHERE len(w) >= 4""",
)
def halved_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.halves("text")).alias("half", "part")).select("doc_id", "half", F.md5("part").alias("digest"))


@query(
    "pieces_handed_on",
    "SELECT conv_id, turn, CASE WHEN row_number() OVER w = 1 THEN 1 ELSE 0 END AS n_tags, CASE WHEN row_number() OVER w = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS pause_before, CASE WHEN row_number() OVER d = 1 THEN 0.8 ELSE 0.1 END::DOUBLE AS pause_after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn), d AS (PARTITION BY conv_id ORDER BY turn DESC)",
)
def pieces_handed_on(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array(F.lit("[sigh]")).alias("tags"), F.lit(0.5).alias("pause_before"), F.lit(0.8).alias("pause_after"))
    return chunking.handed_on(rows, ["conv_id"], "turn").select("conv_id", "turn", F.size("tags").alias("n_tags"), "pause_before", "pause_after")


@query(
    "first_dialogues",
    f"""WITH {QUOTED_SQL} SELECT conv_id, min(turn) AS turn FROM q WHERE regexp_matches(text, '[«»"]|^\\s*[-–—]') GROUP BY conv_id""",
)
def first_dialogues(spark, sf_dir):
    return attribution.first_dialogue(_quoted(spark, sf_dir), ["conv_id"], "turn").select("conv_id", "turn")


@query(
    "most_emotional",
    f"""WITH s AS (SELECT source, doc_id, {" + ".join(f"contains(lower(text), '{w}')::INT" for w in attribution.EMOTIONAL["en"])} + (length(text) - length(replace(text, '!', ''))) * 0.5 + (length(text) - length(replace(text, '...', ''))) / 3 * 0.3 AS score FROM documents)
SELECT source, min(doc_id) AS doc_id, round(any_value(score), 4)::DOUBLE AS score FROM s WHERE score > 0 AND (source, score) IN (SELECT (source, max(score)) FROM s GROUP BY source) GROUP BY source""",
)
def most_emotional(spark, sf_dir):
    return attribution.most_emotional(table(spark, sf_dir, "documents"), ["source"], "doc_id", "text", "en").select("source", "doc_id", F.round("score", 4).alias("score"))


@query(
    "prosody_continuity",
    f"""WITH RECURSIVE {EMOTIONS_SQL}, n AS (SELECT event_id, user_id, emotion, intensity, lag(emotion) OVER w AS a, lag(intensity) OVER w AS before, 1 + value / 997 AS x, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
t AS (SELECT *, CASE WHEN a IS NULL THEN 1.0 WHEN before IN ('high', 'extreme') AND intensity IN ('low', 'medium') AND emotion IN ('neutral', 'tenderness') THEN 0.9 WHEN intensity = 'extreme' AND emotion IN ('fear', 'anger', 'excitement') THEN 0.95 WHEN (a, emotion) IN (('joy', 'sadness'), ('sadness', 'joy'), ('excitement', 'sadness')) THEN 1.0
  WHEN emotion = 'excitement' AND NOT (a = 'sadness') THEN 1.1 WHEN emotion = 'excitement' THEN 1.0 WHEN emotion = 'anger' THEN 1.05 WHEN emotion = 'sadness' THEN 0.92 WHEN emotion = 'suspense' THEN 0.88 ELSE 1.0 END AS m FROM n),
s AS (SELECT event_id, user_id, n, (x * m)::DOUBLE AS v FROM t WHERE n = 1 UNION ALL SELECT t.event_id, t.user_id, t.n, (t.x * 0.7 + s.v * 0.3) * t.m FROM s JOIN t ON t.user_id = s.user_id AND t.n = s.n + 1)
SELECT event_id, round(v, 4) AS speed_smooth FROM s""",
)
def prosody_continuity(spark, sf_dir):
    rows = _emotions(spark, sf_dir).withColumn("speed", 1 + F.col("value") / 997).withColumn("pitch", F.lit(0.0)).withColumn("volume", F.lit(1.0)).withColumn("pause_before", F.lit(0.1))
    return emotion.continued(rows, ["user_id"], "event_id").select("event_id", F.round("speed_smooth", 4).alias("speed_smooth"))


@query(
    "climax_positions",
    f"WITH {EMOTIONS_SQL}, r AS (SELECT user_id, intensity, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS position FROM e) SELECT user_id, position FROM r WHERE intensity = 'extreme'",
)
def climax_positions(spark, sf_dir):
    return emotion.climaxes(_emotions(spark, sf_dir), ["user_id"], "event_id")


@query(
    "chapter_peaks",
    f"WITH {EMOTIONS_SQL} SELECT user_id, (['low', 'medium', 'high', 'extreme'])[max(list_position(['low', 'medium', 'high', 'extreme'], intensity))] AS max_intensity, count(*) FILTER (WHERE intensity = 'extreme') AS climaxes FROM e GROUP BY user_id",
)
def chapter_peaks(spark, sf_dir):
    return emotion.chapter_mood(_emotions(spark, sf_dir), ["user_id"], "event_id").select("user_id", "max_intensity", "climaxes")


@query(
    "intensity_arcs",
    "WITH a AS (SELECT user_id, count(*) AS n, arg_min(value / 100, event_id) AS f, arg_max(value / 100, event_id) AS l FROM events GROUP BY user_id) SELECT user_id, n, CASE WHEN n < 2 THEN 'stable' WHEN l > f + 0.2 THEN 'rising' WHEN l < f - 0.2 THEN 'falling' ELSE 'stable' END AS arc FROM a",
)
def intensity_arcs(spark, sf_dir):
    return emotion.intensity_arc(table(spark, sf_dir, "events").withColumn("intensity", F.col("value") / 100), ["user_id"], "event_id")


def _timeline(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("index"), F.col("role").alias("speaker"), F.regexp_replace("text", r"\s+", " ").alias("text"), F.lit(None).cast("string").alias("emotion"))
    return rows.withColumn("start_time", F.col("index") * 3661 + 0.25).withColumn("duration", F.lit(1.5)).withColumn("end_time", F.col("start_time") + 1.5)


@query(
    "timeline_export",
    r"""WITH c AS (SELECT conv_id, turn AS i, role, regexp_replace(text, '\s+', ' ', 'g') AS t FROM conversations)
SELECT conv_id, i AS index, md5((i + 1) || chr(10) || printf('%02d:%02d:%02d,250', i * 3661 // 3600, i * 3661 % 3600 // 60, i * 3661 % 60) || ' --> ' || printf('%02d:%02d:%02d,750', (i * 3661 + 1) // 3600, (i * 3661 + 1) % 3600 // 60, (i * 3661 + 1) % 60) || chr(10) || '[' || role || '] ' || t || chr(10)) AS srt,
  md5(i || ',' || role || ',' || CASE WHEN regexp_matches(t, '[,"]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END || ',' || printf('%.3f', i * 3661 + 0.25) || ',1.500,') AS csv FROM c""",
)
def timeline_export(spark, sf_dir):
    return sinks.timeline_rows(_timeline(spark, sf_dir)).select("conv_id", "index", F.md5("srt").alias("srt"), F.md5("csv").alias("csv"))


@query(
    "chapter_marks",
    r"""SELECT doc_id, md5(chr(10) || '[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || doc_id * 1000 || chr(10) || 'END=' || (doc_id * 1000 + n_chars) || chr(10) || 'title=A\\=' || doc_id || '\\;\\#\\') AS digest,
  printf('%02d:%02d:%02d.%03d', n_chars // 3600000, n_chars % 3600000 // 60000, n_chars % 60000 // 1000, n_chars % 1000) AS clock, 'file ''it''\''''s/' || doc_id || '''' AS line FROM documents""",
)
def chapter_marks(spark, sf_dir):
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.concat(F.lit("A="), d.cast("string"), F.lit(";#\\")).alias("title"), (d * 1000).alias("start_ms"), (d * 1000 + F.col("n_chars")).alias("end_ms"))
    return sinks.chapter_marks(rows).select("doc_id", F.md5("block").alias("digest"), sinks.clock_of_ms("n_chars").alias("clock"), sinks.concat_line(F.concat(F.lit("it's/"), d.cast("string"))).alias("line"))


@query("plain_chapters")
def plain_chapters(spark, sf_dir):
    text = sinks.plain_chapter(F.concat(F.lit("T"), F.col("doc_id").cast("string")), "text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text).alias("n_chars"), F.md5(text).alias("digest"))


@query(
    "rule_selection",
    "WITH r AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'high' WHEN 'click' THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN user_id % 4 = 0 THEN 'flag' ELSE 'replace' END AS action FROM events) SELECT * FROM r WHERE confidence IN ('high', 'medium') AND action = 'replace'",
)
def rule_selection(spark, sf_dir):
    rules = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "high").when(F.col("event_type") == "click", "medium").otherwise("low").alias("confidence"), F.when(F.col("user_id") % 4 == 0, "flag").otherwise("replace").alias("action"))
    return compliance.selected(rules, ["high", "medium"], ["replace"])


@query(
    "pooled_voices",
    """WITH p AS (SELECT nation, c_custkey, g, CASE WHEN g IS NOT NULL THEN g WHEN (row_number() OVER (PARTITION BY nation ORDER BY c_custkey) - 1) % 2 = 0 THEN 'M' ELSE 'F' END AS pool FROM (SELECT c_nationkey AS nation, c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS g FROM customer)),
r AS (SELECT *, row_number() OVER (PARTITION BY nation, pool ORDER BY c_custkey) - 1 AS n FROM p) SELECT c_custkey, CASE pool WHEN 'M' THEN (['m1', 'm2'])[n % 2 + 1] ELSE (['f1', 'f2', 'f3'])[n % 3 + 1] END AS voice FROM r""",
)
def pooled_voices(spark, sf_dir):
    gender = F.when(F.col("c_custkey") % 3 == 0, "M").when(F.col("c_custkey") % 3 == 1, "F")
    return casting.pooled(table(spark, sf_dir, "customer").withColumn("gender", gender), ["c_nationkey"], "c_custkey", {"M": ("m1", "m2"), "F": ("f1", "f2", "f3")}).select("c_custkey", "voice")


@query(
    "podcast_timeline",
    """WITH s AS (SELECT user_id, event_id % 5 AS section, event_id, abs(value) AS e FROM events), l AS (SELECT user_id, section, arg_max(e, event_id) AS e FROM s GROUP BY ALL),
o AS (SELECT user_id, section, 10.5 + coalesce(sum(e + 1.0) OVER (PARTITION BY user_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (row_number() OVER (PARTITION BY user_id ORDER BY section) - 1) * 4.3 AS start FROM l)
SELECT event_id, round(start + s.e, 3)::DOUBLE AS end_time FROM s JOIN o USING (user_id, section)""",
)
def podcast_timeline(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 5).alias("section"), F.lit(0.0).alias("start_time"), F.abs("value").alias("end_time"))
    return timeline.podcast(rows, ["user_id"], "section", "event_id", intro=10.0, jingle=4.0).select("event_id", F.round("end_time", 3).alias("end_time"))


@query(
    "mixed_signals",
    "WITH x AS (SELECT user_id % 20 AS track, event_id % 50 AS place, value, unnest(range(3)) AS i FROM events) SELECT track, place + i AS position, round(sum(value / (i + 1)), 4)::DOUBLE AS value FROM x GROUP BY ALL",
)
def mixed_signals(spark, sf_dir):
    v = F.col("value")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("track"), (F.col("event_id") % 50).alias("at"), F.array(v, v / 2, v / 3).alias("samples"))
    return timeline.mixed(rows, ["track"], "at", "samples").select("track", "position", F.round("value", 4).alias("value"))


def _signals(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", (F.col("value") / 1000).alias("x")))).alias("s"))
    return rows.select("user_id", F.transform("s", lambda z: z["x"]).alias("s"))


_SIGNALS_SQL = "v AS (SELECT user_id, list((value / 1000)::DOUBLE ORDER BY event_id) AS s FROM events GROUP BY user_id)"


@query(
    "resampled_signals",
    f"""WITH {_SIGNALS_SQL}, p AS (SELECT user_id, s, unnest(range(32)) AS i FROM v), q AS (SELECT *, i * (len(s) - 1) / 31 AS place FROM p)
SELECT user_id, i::INT AS i, round(s[floor(place)::INT + 1] + (coalesce(s[floor(place)::INT + 2], s[-1]) - s[floor(place)::INT + 1]) * (place - floor(place)), 6)::DOUBLE AS x FROM q""",
)
def resampled_signals(spark, sf_dir):
    return _signals(spark, sf_dir).select("user_id", F.posexplode(S.resampled("s", 32)).alias("i", "x")).withColumn("x", F.round("x", 6))


@query(
    "faded_signals",
    f"""WITH {_SIGNALS_SQL}, p AS (SELECT user_id, s, unnest(range(len(s))) AS i FROM v)
SELECT user_id, i::INT AS i, round(s[i + 1] * CASE WHEN i < 5 THEN pow(sin(i / 4 * pi() / 2), 2) ELSE 1 END * CASE WHEN i >= len(s) - 5 THEN pow(cos((i - len(s) + 5) / 4 * pi() / 2), 2) ELSE 1 END, 6)::DOUBLE AS x FROM p""",
)
def faded_signals(spark, sf_dir):
    return _signals(spark, sf_dir).select("user_id", F.posexplode(S.fade_out_squared(S.fade_in_squared("s", 5), 5)).alias("i", "x")).withColumn("x", F.round("x", 6))


@query(
    "signal_parts",
    f"WITH {_SIGNALS_SQL}, c AS (SELECT user_id, len(s) AS n FROM v) SELECT user_id, unnest([0, 1, 2])::INT AS part, unnest([floor(n * 0.2)::INT, floor(n * 0.7)::INT - floor(n * 0.2)::INT, n::INT - floor(n * 0.7)::INT])::INT AS size FROM c",
)
def signal_parts(spark, sf_dir):
    return _signals(spark, sf_dir).select("user_id", F.posexplode(S.weighted_split("s", [0.2, 0.5, 0.3])).alias("part", "x")).select("user_id", "part", F.size("x").alias("size"))


@query(
    "assembled_signals",
    f"WITH {_SIGNALS_SQL} SELECT user_id, (2 * len(s) + 8 + 4)::INT AS size, round(2 * list_sum(s), 4)::DOUBLE AS total, round(least(list_max(list_transform(s, lambda x: abs(x))), 0.05), 6)::DOUBLE AS peak, round(list_sum(list_transform(s, lambda x: tanh(x * 2) / tanh(2))), 4)::DOUBLE AS clipped FROM v",
)
def assembled_signals(spark, sf_dir):
    whole = S.with_pauses(F.array("s", "s"), F.array(F.lit(0.8), F.lit(0.4)), 10)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    peak = F.array_max(F.transform(S.peak_limited("s", 0.05), F.abs))
    return _signals(spark, sf_dir).select("user_id", F.size(whole).alias("size"), F.round(total(whole), 4).alias("total"), F.round(peak, 6).alias("peak"), F.round(total(S.soft_clip("s", 2.0)), 4).alias("clipped"))


def _crossfade_sql(a: str, b: str) -> str:
    n = f"least(4, len({a}), len({b}))"
    gain = f"CASE WHEN {n} > 1 THEN (1 - cos(i / ({n} - 1) * pi())) / 2 ELSE 0 END"
    return f"{a}[1:len({a}) - {n}] || list_transform(range(0, {n}), lambda i: {a}[len({a}) - {n} + 1 + i] * (1 - {gain}) + {b}[1 + i] * {gain}) || {b}[{n} + 1:]"


@query(
    "crossfaded_signals",
    f"""WITH {_SIGNALS_SQL}, p AS (SELECT user_id, s[1:floor(len(s) * 0.3)::INT] AS a, s[floor(len(s) * 0.3)::INT + 1:floor(len(s) * 0.6)::INT] AS b, s[floor(len(s) * 0.6)::INT + 1:] AS c FROM v),
m AS (SELECT user_id, {_crossfade_sql("a", "b")} AS m, c FROM p), w AS (SELECT user_id, {_crossfade_sql("m", "c")} AS w FROM m)
SELECT user_id, unnest(range(len(w)))::INT AS i, round(unnest(w), 8)::DOUBLE AS x FROM w""",
)
def crossfaded_signals(spark, sf_dir):
    return _signals(spark, sf_dir).select("user_id", F.posexplode(S.joined(S.weighted_split("s", [0.3, 0.3, 0.4]), 4)).alias("i", "x")).withColumn("x", F.round("x", 8))


@query(
    "intensity_multipliers",
    """WITH k AS (SELECT event_id, greatest(0.0, least(1.0, value / 100)) AS x FROM events), s AS (SELECT *, least(floor(x * 4), 3)::INT AS i, x * 4 - least(floor(x * 4), 3) AS r FROM k)
SELECT event_id, """
    + ", ".join(f"round(([{a}])[i + 1] + (([{a}])[i + 2] - ([{a}])[i + 1]) * r, 5)::DOUBLE AS {n}" for n, a in (("speed", "1.0, 1.02, 1.05, 1.1, 1.2"), ("pitch", "0.0, 0.1, 0.2, 0.35, 0.5"), ("volume", "1.0, 1.02, 1.05, 1.1, 1.15")))
    + " FROM s",
)
def intensity_multipliers(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", P.multipliers(F.col("value") / 100).alias("m"))
    return rows.select("event_id", *[F.round(f"m.{n}", 5).alias(n) for n in ("speed", "pitch", "volume")])


@query(
    "context_styles",
    f"""WITH {EMOTIONS_SQL}, n AS (SELECT event_id, emotion, (['action', 'description', 'introspection', 'flashback', 'suspense', 'narration'])[event_id % 6 + 1] AS kind, event_id % 4 = 0 AS spoken FROM e)
SELECT event_id, CASE WHEN spoken THEN CASE WHEN emotion IN ('anger', 'fear', 'excitement') THEN 'dramatic' ELSE 'conversational' END WHEN kind = 'action' THEN 'energetic' WHEN kind = 'description' THEN 'documentary' WHEN kind IN ('introspection', 'flashback') THEN 'intimate' WHEN kind = 'suspense' THEN 'dramatic' END AS style FROM n""",
)
def context_styles(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("action", "description", "introspection", "flashback", "suspense", "narration"))), (F.col("event_id") % 6 + 1).cast("int"))
    return _emotions(spark, sf_dir).select("event_id", P.style_for(kind, F.col("emotion"), F.col("event_id") % 4 == 0).alias("style"))


@query(
    "text_previews",
    """WITH c AS (SELECT doc_id, text, substr(text, 1, 120) AS cut FROM documents), p AS (SELECT *, 121 - strpos(reverse(cut), '.') AS stop FROM c)
SELECT doc_id, md5(CASE WHEN length(text) <= 120 THEN text WHEN contains(cut, '.') AND stop > 60 THEN substr(cut, 1, stop) ELSE cut || '...' END) AS digest, md5('T' || doc_id || chr(10) || chr(10) || text) AS whole FROM p""",
)
def text_previews(spark, sf_dir):
    title = F.concat(F.lit("T"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(P.preview("text", 120)).alias("digest"), F.md5(P.full_text(title, "text")).alias("whole"))


@query(
    "file_slugs",
    "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' - No. ' || p_partkey || '!'), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part",
)
def file_slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", sinks.slug(F.concat("p_name", F.lit(" - No. "), F.col("p_partkey").cast("string"), F.lit("!"))).alias("slug"))


@query(
    "picked_voices",
    """WITH v AS (SELECT * FROM (VALUES ('a1', 1, 'fr-fr', 'F'), ('a2', 2, 'fr-ca', 'M'), ('b1', 3, 'en-us', 'F'), ('b2', 4, 'en-gb', 'F')) AS t(id, ord, lang, gender)), a AS (SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN 'M' ELSE 'F' END AS gender FROM documents)
SELECT doc_id, CASE lang WHEN 'fr' THEN CASE gender WHEN 'M' THEN 'a2' ELSE 'a1' END WHEN 'en' THEN 'b1' ELSE 'ff_siwis' END AS voice FROM a""",
)
def picked_voices(spark, sf_dir):
    catalog = spark.createDataFrame([("a1", 1, "fr-fr", "F"), ("a2", 2, "fr-ca", "M"), ("b1", 3, "en-us", "F"), ("b2", 4, "en-gb", "F")], "id string, ord int, lang string, gender string")
    asked = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, "M").otherwise("F").alias("gender"))
    return casting.picked(catalog, asked, ["doc_id"], "ff_siwis")
