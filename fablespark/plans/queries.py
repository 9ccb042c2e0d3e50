"""Named queries over the driver's tables, each with the same question in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import signals as S
from ..functions import text as T
from ..operators import casting, catalog, compliance, emotion, segments, tags, timeline
from ..sources import sinks
from . import narration

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Narrow rows dealt over all cores before dear work on each: a file of one row group is read by one task."""
    return df.repartition(8 * df.sparkSession.sparkContext.defaultParallelism)


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """Columns of a table, its rows dealt by key over all cores before dear work on each text; nothing is sorted for that."""
    return table(spark, sf_dir, name).select(key, *columns).repartition(4 * spark.sparkContext.defaultParallelism, key)


# Inputs that the tables lack are derived alike on both sides.
EMOTIONS = {"view": "neutral", "click": "joy", "purchase": "excitement", "error": "anger", "signup": "surprise", "logout": "sadness"}
SENTENCES_SQL = r"""sentences AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS sent_idx_unused, pos, sentence FROM (
    SELECT doc_id, unnest(s) AS sentence, unnest(range(len(s))) AS pos FROM (
      SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, E' \t\n\r') <> '') AS s FROM documents WHERE text IS NOT NULL)))"""


def _emotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for kv in EMOTIONS.items() for x in kv])
    intensity = F.when(F.col("value") < 5, "low").when(F.col("value") < 20, "medium").when(F.col("value") < 60, "high").otherwise("extreme")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.coalesce(kinds[F.col("event_type")], F.lit("suspense")).alias("emotion"), intensity.alias("intensity"), "value")


EMOTIONS_SQL = (
    "e AS (SELECT event_id, user_id, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EMOTIONS.items())
    + " ELSE 'suspense' END AS emotion, CASE WHEN value < 5 THEN 'low' WHEN value < 20 THEN 'medium' WHEN value < 60 THEN 'high' ELSE 'extreme' END AS intensity, value FROM events)"
)


def _in(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN (" + ", ".join(f"'{v}'" for v in values) + ")"


def _hits_sql(column: str, needles: tuple[str, ...], regex: bool = False) -> str:
    return " + ".join(f"regexp_matches({column}, '{n}')::INT" if regex else f"contains({column}, '{n}')::INT" for n in needles)


@query(
    "sentence_split",
    f"WITH {SENTENCES_SQL} SELECT doc_id, pos::INT AS sent_idx, length(sentence)::INT AS n_chars, md5(sentence) AS digest FROM sentences",
)
def sentence_split(spark, sf_dir):
    return segments.sentences(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "sent_idx", F.length("sentence").alias("n_chars"), F.md5("sentence").alias("digest"))


@query(
    "text_stats",
    r"SELECT doc_id, length(text)::INT AS chars, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INT AS words, round(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) / 150, 4) AS minutes, round(length(text) / 1000 * 0.2, 4) AS conversion FROM documents",
)
def text_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars"), T.word_count("text").alias("words"), F.round(T.minutes("text"), 4).alias("minutes"), F.round(T.conversion_minutes("text"), 4).alias("conversion"))


def _greedy_sql(limit: int) -> str:
    return f"""WITH RECURSIVE {SENTENCES_SQL},
walk AS (
  SELECT doc_id, pos, 0 AS chunk_idx, length(sentence) AS size FROM sentences WHERE pos = 0
  UNION ALL
  SELECT s.doc_id, s.pos, CASE WHEN w.size + length(s.sentence) + 1 <= {limit} THEN w.chunk_idx ELSE w.chunk_idx + 1 END,
    CASE WHEN w.size + length(s.sentence) + 1 <= {limit} THEN w.size + length(s.sentence) + 1 ELSE length(s.sentence) END
  FROM walk w JOIN sentences s ON s.doc_id = w.doc_id AND s.pos = w.pos + 1)
SELECT doc_id, chunk_idx::INT AS chunk_idx, max(size)::INT AS n_chars FROM walk GROUP BY doc_id, chunk_idx"""


@query("greedy_chunks", _greedy_sql(250))
def greedy_chunks(spark, sf_dir):
    return segments.chunks(table(spark, sf_dir, "documents"), ["doc_id"], 250).select("doc_id", "chunk_idx", F.length("chunk").alias("n_chars"))


@query(
    "clause_timing",
    r"""WITH c AS (SELECT doc_id, unnest(cl) AS clause, unnest(range(len(cl))) AS i FROM (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?;]+[.!?;]*'), lambda x: trim(x, E' \t\n\r')), lambda x: x <> '') AS cl FROM documents)),
k AS (SELECT doc_id, i, clause, CASE WHEN clause[1] IN ('"', '«', '—') THEN 'quote' WHEN clause[1] = '(' AND clause[-1] = ')' THEN 'parenthetical'
  WHEN list_contains(["""
    + ", ".join(f"'{w}'" for w in T.SUBORDINATE_WORDS)
    + r"""], regexp_replace(regexp_extract(lower(clause), '^\S+'), '^[.,;:!?]+|[.,;:!?]+$', '', 'g'))
    OR """
    + " OR ".join(f"starts_with(array_to_string(regexp_split_to_array(lower(clause), '\\s+')[1:3], ' '), '{p}')" for p in T.SUBORDINATE_PHRASES)
    + r""" THEN 'subordinate'
  WHEN list_has_any(regexp_extract_all(lower(clause), '[\p{L}\p{N}_]+'), ["""
    + ", ".join(f"'{w}'" for w in T.EMPHASIS_WORDS)
    + r"""]) THEN 'emphasis' ELSE 'main' END AS kind FROM c)
SELECT doc_id, i::INT AS clause_idx, kind, CASE kind WHEN 'subordinate' THEN 1.05 WHEN 'parenthetical' THEN 1.08 WHEN 'quote' THEN 0.95 WHEN 'emphasis' THEN 0.97 ELSE 1.0 END::DOUBLE AS speed,
  round(CASE WHEN ends_with(clause, '...') THEN 0.6 * 1.5 WHEN clause[-1] = ',' THEN 0.3 WHEN clause[-1] = ';' THEN 0.3 * 1.2 WHEN clause[-1] = ':' THEN 0.3 * 1.1 WHEN clause[-1] = '.' THEN 0.6 WHEN clause[-1] IN ('!', '?') THEN 0.6 * 1.1 WHEN clause[-1] = '…' THEN 0.6 * 1.5 ELSE 0.2 END
    / CASE kind WHEN 'subordinate' THEN 1.05 WHEN 'parenthetical' THEN 1.08 WHEN 'quote' THEN 0.95 WHEN 'emphasis' THEN 0.97 ELSE 1.0 END, 4)::DOUBLE AS pause FROM k""",
)
def clause_timing(spark, sf_dir):
    rows = segments.clauses(table(spark, sf_dir, "documents"), ["doc_id"])
    rows = rows.withColumn("kind", T.clause_type("clause"))
    return rows.select("doc_id", "clause_idx", "kind", T.clause_speed(F.col("kind")).alias("speed"), F.round(T.pause_after("clause", F.col("kind")), 4).alias("pause"))


_CONTOURS_SQL = f"""{SENTENCES_SQL}, t AS (SELECT doc_id, pos, regexp_replace(sentence, '^\\s+|\\s+$', '', 'g') AS s FROM sentences),
c AS (SELECT doc_id, pos, length(s) / 15.0 AS seconds, CASE WHEN s = '' THEN 'neutral'
  WHEN ends_with(s, '?') THEN CASE WHEN {_in("regexp_extract(regexp_replace(lower(s), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\S+')", T.QUESTION_WORDS)} THEN 'question_wh' ELSE 'question_yn' END
  WHEN ends_with(s, '!') THEN 'exclamation' WHEN ends_with(s, '...') OR ends_with(s, '…') THEN 'suspense'
  WHEN ends_with(s, ',') OR ends_with(s, ';') OR {_in("regexp_replace(regexp_extract(lower(s), '\\S+$'), '[.,;:]+$', '')", T.CONTINUING_WORDS)} THEN 'continuation'
  WHEN ends_with(s, '.') OR regexp_matches(s, '[\\p{{L}}\\p{{N}}]$') THEN 'declarative' ELSE 'neutral' END AS contour FROM t)"""


@query("intonation_contour", f"WITH {_CONTOURS_SQL} SELECT contour, count(*) AS n FROM c GROUP BY contour")
def intonation_contour(spark, sf_dir):
    return segments.sentences(table(spark, sf_dir, "documents"), ["doc_id"]).groupBy(T.contour("sentence").alias("contour")).count().withColumnRenamed("count", "n")


@query(
    "contour_configs",
    f"""WITH {_CONTOURS_SQL}, k AS (SELECT * FROM (VALUES """
    + ", ".join(f"('{k}', {i}::INT, {sum(ws[:i])!r}::DOUBLE, {sum(ws[: i + 1])!r}::DOUBLE, {p}::DOUBLE)" for k, (ps, ws) in T.CONTOURS.items() for i, p in enumerate(ps))
    + """) AS t(contour, knot, a, b, pitch))
SELECT doc_id, pos::INT AS sent_idx, knot, round(a * seconds, 4)::DOUBLE AS start, round(b * seconds, 4)::DOUBLE AS "end", pitch FROM c JOIN k USING (contour)""",
)
def contour_configs(spark, sf_dir):
    """The intonation of each sentence of the documents, laid over the time that it takes to say it."""
    rows = segments.sentences(table(spark, sf_dir, "documents"), ["doc_id"])
    knots = T.contour_knots(F.col("_kind"), F.length(T.strip("sentence")) / T.CHARS_PER_SECOND)
    rows = rows.withColumn("_kind", T.contour("sentence")).select("doc_id", "sent_idx", F.explode(knots).alias("k"))
    return rows.select("doc_id", "sent_idx", "k.knot", F.round("k.start", 4).alias("start"), F.round("k.end", 4).alias("end"), "k.pitch")


QUOTED_SQL = "q AS (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN '« ' || text || ' » dit Marie.' ELSE 'Alors \"' || text || '\" dit Paul.' END AS text FROM conversations)"


def _quoted(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", "role", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("« "), "text", F.lit(" » dit Marie."))).otherwise(F.concat(F.lit('Alors "'), "text", F.lit('" dit Paul.'))).alias("text"))


@query(
    "dialogue_segments",
    f"""WITH {QUOTED_SQL}, r AS (SELECT conv_id, turn, unnest(s) AS raw, unnest(range(len(s))) AS i FROM (
  SELECT conv_id, turn, list_filter(regexp_extract_all(text, '«[^»]+»|"[^"]+"|[^«"]+'), lambda x: trim(x, E' \\t\\n\\r') <> '') AS s FROM q))
SELECT conv_id, turn, i::INT AS seg_idx, md5(trim(CASE WHEN raw[1] IN ('«', '"') THEN regexp_replace(raw, '^[«"]|[»"]$', '', 'g') ELSE raw END, E' \\t\\n\\r')) AS digest, raw[1] IN ('«', '"') AS is_dialogue FROM r""",
)
def dialogue_segments(spark, sf_dir):
    return segments.dialogue(_quoted(spark, sf_dir), ["conv_id", "turn"]).select("conv_id", "turn", "seg_idx", F.md5("segment").alias("digest"), "is_dialogue")


@query(
    "speaker_attribution",
    r"""WITH RECURSIVE q AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, CASE WHEN turn % 3 = 0 THEN role END AS explicit FROM conversations),
walk AS (
  SELECT conv_id, turn, n, coalesce(explicit, 'UNKNOWN') AS speaker, CASE WHEN explicit IS NULL THEN 'unknown' ELSE 'explicit' END AS method, explicit AS last, NULL::VARCHAR AS other, 0 AS silent FROM q WHERE n = 1
  UNION ALL
  SELECT q.conv_id, q.turn, q.n,
    CASE WHEN explicit IS NOT NULL THEN explicit WHEN other IS NOT NULL THEN CASE WHEN (silent + 1) % 2 = 1 THEN other ELSE last END WHEN last IS NOT NULL THEN last ELSE 'UNKNOWN' END,
    CASE WHEN explicit IS NOT NULL THEN 'explicit' WHEN other IS NOT NULL THEN 'alternation' WHEN last IS NOT NULL THEN 'last_speaker' ELSE 'unknown' END,
    coalesce(explicit, last), CASE WHEN explicit IS NOT NULL AND explicit <> last THEN last ELSE other END, CASE WHEN explicit IS NOT NULL THEN 0 ELSE silent + 1 END
  FROM walk w JOIN q ON q.conv_id = w.conv_id AND q.n = w.n + 1)
SELECT conv_id, turn, speaker, method FROM walk""",
)
def speaker_attribution(spark, sf_dir):
    quotes = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("role")).alias("explicit"))
    return casting.attributed(quotes, ["conv_id"], "turn").select("conv_id", "turn", "speaker", "method")


@query(
    "script_parse",
    r"""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS line_idx, upper(role) AS speaker, md5(trim(regexp_replace(text, '\s*\n\s*', ' ', 'g'), E' \t\n\r')) AS digest FROM conversations""",
)
def script_parse(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    scripts = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", F.upper("role"), "text").alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return segments.script_lines(scripts, ["conv_id"]).select("conv_id", "line_idx", "speaker", F.md5("line").alias("digest"))


@query(
    "merge_short_segments",
    f"""WITH {SENTENCES_SQL}, i AS (SELECT doc_id, pos, sentence, sum((length(sentence) >= 60 OR pos = 0)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM sentences)
SELECT doc_id, (k - 1)::BIGINT AS sent_idx, md5(string_agg(sentence, ' ' ORDER BY pos)) AS digest FROM i GROUP BY doc_id, k""",
)
def merge_short_segments(spark, sf_dir):
    rows = segments.sentences(table(spark, sf_dir, "documents"), ["doc_id"])
    return segments.merge_short(rows, ["doc_id"], "sentence", "sent_idx", 60).select("doc_id", "sent_idx", F.md5("sentence").alias("digest"))


# Header lines inside a document become plain lines on both sides, so that every document has its two chapters.
@query(
    "chapter_split",
    r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '(^|\n)#+[ \t]', '\1', 'g') AS t FROM documents)
SELECT doc_id, unnest([1, 2])::INT AS number, unnest(['T' || doc_id, 'Part two']) AS title, unnest([md5(trim(t, E' \t\n\r')), md5('The end.')]) AS digest FROM d""",
)
def chapter_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"(^|\n)#+[ \t]", "$1"))
    books = docs.select("doc_id", F.concat(F.lit("# T"), F.col("doc_id").cast("string"), F.lit("\n"), "text", F.lit("\n# Part two\nThe end.\n")).alias("text"))
    return segments.chapters(books, ["doc_id"]).select("doc_id", "number", "title", F.md5("content").alias("digest"))


@query(
    "html_to_text",
    r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' ')) AS digest, trim(regexp_extract(html, '(?i)<h[12][^>]*>([^<]+)</h[12]>', 1)) AS title FROM pages""",
)
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.without_tags("html")).alias("digest"), T.html_title("html").alias("title"))


@query(
    "readable_pages",
    r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<nav\b[^>]*>.*?</nav\s*>|<header\b[^>]*>.*?</header\s*>|<footer\b[^>]*>.*?</footer\s*>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, trim(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM a) SELECT page_id, length(t)::INT AS n_chars, md5(t) AS digest FROM b""",
)
def readable_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(T.html_text("html")).alias("n_chars"), F.md5(T.html_text("html")).alias("digest"))


@query(
    "clean_for_speech",
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[—–]', '-', 'g'), '[*_#`~]', '', 'g'), '\.{4,}', '...', 'g'), '!{2,}', '!', 'g'), '\?{2,}', '?', 'g'), ' ')) AS digest FROM documents""",
)
def clean_for_speech(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_for_speech("text")).alias("digest"))


@query(
    "keyword_emotion",
    "WITH h AS (SELECT doc_id, [" + ", ".join(_hits_sql("lower(text)", w) for w in emotion.KEYWORDS.values()) + "] AS n FROM documents), b AS (SELECT doc_id, list_max(n) AS top, list_position(n, list_max(n)) AS place FROM h) SELECT doc_id, CASE WHEN top > 0 THEN (["
    + ", ".join(f"'{k}'" for k in emotion.KEYWORDS)
    + "])[place] ELSE 'neutral' END AS emotion, round(CASE WHEN top > 0 THEN least(top / 3, 0.8) ELSE 0.5 END, 4)::DOUBLE AS confidence FROM b",
)
def keyword_emotion(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("e", emotion.keyword_emotion("text")).select("doc_id", "e.emotion", F.round("e.confidence", 4).alias("confidence"))


_SIZES = r"list_transform(regexp_split_to_array(text, '[.!?]'), lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')))"


@query(
    "narrative_scores",
    f"""WITH t AS (SELECT doc_id, text, lower(text) AS low, {_SIZES} AS sizes FROM documents)
SELECT doc_id,
  round(least(({_hits_sql("low", emotion.ACTION)} + (len(list_filter(sizes, lambda n: n < 8)) > len(sizes) / 2)::INT + CASE WHEN length(text) - length(replace(text, '!', '')) > 1 THEN 0.5 ELSE 0 END + CASE WHEN contains(text, '...') THEN 0.3 ELSE 0 END) / 3, 1.0), 4)::DOUBLE AS action,
  round(least(({_hits_sql("low", emotion.DESCRIPTION)} + (len(list_filter(sizes, lambda n: n > 15)) > len(sizes) / 2)::INT + CASE WHEN regexp_matches(low, '[\\p{{L}}\\p{{N}}_](?:e|eux|euse|ant|ent)s?[^\\p{{L}}\\p{{N}}_\\n].*[\\p{{L}}\\p{{N}}_](?:e|eux|euse|ant|ent)s?($|[^\\p{{L}}\\p{{N}}_])') THEN 0.5 ELSE 0 END + CASE WHEN {_hits_sql("low", emotion.ACTION)} = 0 THEN 0.3 ELSE 0 END) / 3, 1.0), 4)::DOUBLE AS description,
  round(least(({_hits_sql("low", emotion.FLASHBACK, True)}) / 2, 1.0), 4)::DOUBLE AS flashback
FROM t""",
)
def narrative_scores(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(emotion.action_score("text"), 4).alias("action"), F.round(emotion.description_score("text"), 4).alias("description"), F.round(emotion.flashback_score("text"), 4).alias("flashback"))


@query(
    "narrative_types",
    f"""WITH {SENTENCES_SQL}, t AS (SELECT doc_id, pos, sentence AS text, lower(sentence) AS low FROM sentences), z AS (SELECT *, {_SIZES} AS sizes, regexp_matches(text, '[«»"]|^\\s*[-–—]') AS spoken FROM t),
s AS (SELECT doc_id, pos, spoken, [
  least(({_hits_sql("low", emotion.ACTION)} + (len(list_filter(sizes, lambda n: n < 8)) > len(sizes) / 2)::INT + CASE WHEN length(text) - length(replace(text, '!', '')) > 1 THEN 0.5 ELSE 0 END + CASE WHEN contains(text, '...') THEN 0.3 ELSE 0 END)::DOUBLE / 3, 1.0),
  least(({_hits_sql("low", emotion.DESCRIPTION)} + (len(list_filter(sizes, lambda n: n > 15)) > len(sizes) / 2)::INT + CASE WHEN regexp_matches(low, '[\\p{{L}}\\p{{N}}_](?:e|eux|euse|ant|ent)s?[^\\p{{L}}\\p{{N}}_\\n].*[\\p{{L}}\\p{{N}}_](?:e|eux|euse|ant|ent)s?($|[^\\p{{L}}\\p{{N}}_])') THEN 0.5 ELSE 0 END + CASE WHEN {_hits_sql("low", emotion.ACTION)} = 0 THEN 0.3 ELSE 0 END)::DOUBLE / 3, 1.0),
  least(({_hits_sql("low", emotion.INTROSPECTION)} + {_hits_sql("low", emotion.THOUGHTS, True)} + CASE WHEN regexp_matches(text, '\\*[^*]+\\*|_[^_]+_') THEN 0.5 ELSE 0 END + CASE WHEN contains(text, '?') AND NOT spoken THEN 0.5 ELSE 0 END)::DOUBLE / 3, 1.0),
  least(({_hits_sql("low", emotion.FLASHBACK, True)})::DOUBLE / 2, 1.0)] AS n FROM z)
SELECT doc_id, pos::INT AS sent_idx, CASE WHEN spoken THEN 'dialogue' WHEN list_max(n) < 0.3 THEN 'narration' ELSE (['action', 'description', 'introspection', 'flashback'])[list_position(n, list_max(n))] END AS type,
  round(CASE WHEN spoken THEN 0.9 WHEN list_max(n) < 0.3 THEN 0.7 ELSE list_max(n) END, 4)::DOUBLE AS confidence FROM s""",
)
def narrative_types(spark, sf_dir):
    rows = emotion.narrative_types(segments.sentences(table(spark, sf_dir, "documents"), ["doc_id"]), "sentence", "n")
    return rows.select("doc_id", "sent_idx", "n.type", F.round("n.confidence", 4).alias("confidence"))


_DISTANCE_SQL = (
    "CASE WHEN a = b THEN 0.0 "
    + " ".join(f"WHEN a = '{k}' AND {_in('b', v)} THEN 0.3" for k, v in emotion.COMPATIBLE.items())
    + " WHEN a = 'neutral' OR b = 'neutral' THEN 0.5 "
    + " ".join(f"WHEN (a = '{p}' AND b = '{q}') OR (a = '{q}' AND b = '{p}') THEN 1.0" for p, q in emotion.OPPOSITE)
    + " ELSE 0.7 END"
)


@query(
    "emotion_transitions",
    f"""WITH {EMOTIONS_SQL}, p AS (SELECT event_id, user_id, emotion AS b, intensity, lag(emotion) OVER w AS a, lag(intensity) OVER w AS before FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
d AS (SELECT *, {_DISTANCE_SQL} AS d FROM p),
k AS (SELECT *, CASE WHEN a IS NULL THEN 'smooth' WHEN before IN ('high', 'extreme') AND intensity IN ('low', 'medium') AND b IN ('neutral', 'tenderness') THEN 'resolution' WHEN intensity = 'extreme' AND b IN ('fear', 'anger', 'excitement') THEN 'dramatic' WHEN d > 0.8 THEN 'sudden' WHEN d > 0.4 THEN 'gradual' ELSE 'smooth' END AS transition FROM d)
SELECT event_id, user_id, coalesce(a, 'neutral') AS from_emotion, b AS emotion, transition,
  round(CASE WHEN a IS NULL THEN 0.3 ELSE CASE transition WHEN 'smooth' THEN 0.2 WHEN 'gradual' THEN 0.4 WHEN 'sudden' THEN 0.6 WHEN 'dramatic' THEN 0.8 ELSE 0.5 END * (1 + d * 0.5) END, 4)::DOUBLE AS pause,
  (CASE WHEN a IS NULL THEN 1.0 WHEN transition = 'dramatic' THEN 0.95 WHEN transition = 'resolution' THEN 0.9 WHEN transition = 'sudden' THEN 1.0 ELSE CASE b WHEN 'excitement' THEN 1.1 WHEN 'anger' THEN 1.05 WHEN 'sadness' THEN 0.92 WHEN 'tenderness' THEN 0.95 WHEN 'suspense' THEN 0.88 ELSE 1.0 END END)::DOUBLE AS speed FROM k""",
)
def emotion_transitions(spark, sf_dir):
    out = emotion.transitions(_emotions(spark, sf_dir), ["user_id"], "event_id")
    return out.select("event_id", "user_id", "from_emotion", "emotion", "transition", F.round("pause", 4).alias("pause"), "speed")


@query(
    "prosody_smoothing",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT event_id, user_id, n, value::DOUBLE AS x FROM e WHERE n = 1 UNION ALL SELECT e.event_id, e.user_id, e.n, e.value * 0.7 + s.x * 0.3 FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT event_id, round(x, 4) AS value_smooth FROM s""",
)
def prosody_smoothing(spark, sf_dir):
    return emotion.smoothed(table(spark, sf_dir, "events"), ["user_id"], "event_id", ["value"]).select("event_id", F.round("value_smooth", 4).alias("value_smooth"))


@query(
    "emotional_arc",
    f"""WITH {EMOTIONS_SQL}, n AS (SELECT *, (emotion IS DISTINCT FROM lag(emotion) OVER (PARTITION BY user_id ORDER BY event_id))::INT AS new FROM e), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM n)
SELECT user_id, run::BIGINT AS run, emotion, min(event_id) AS first, count(*) AS duration FROM r GROUP BY user_id, run, emotion""",
)
def emotional_arc(spark, sf_dir):
    return emotion.arc(_emotions(spark, sf_dir), ["user_id"], "event_id")


@query(
    "chapter_mood",
    f"""WITH {EMOTIONS_SQL}, c AS (SELECT user_id, emotion, count(*) AS n, min(event_id) AS f FROM e GROUP BY ALL), t AS (SELECT user_id, sum(n)::BIGINT AS segments, arg_max(emotion, n * 1000000000 - f) AS dominant FROM c GROUP BY user_id)
SELECT user_id, segments, dominant, CASE dominant {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in emotion.TONES.items())} ELSE 'mixte' END AS tone, (CASE dominant {" ".join(f"WHEN '{k}' THEN {v}" for k, v in emotion.BASE_SPEEDS.items())} ELSE 1.0 END)::DOUBLE AS base_speed FROM t""",
)
def chapter_mood(spark, sf_dir):
    return emotion.chapter_mood(_emotions(spark, sf_dir).drop("intensity"), ["user_id"], "event_id")


@query(
    "mood_trend",
    f"""WITH {EMOTIONS_SQL}, w AS (SELECT event_id, row_number() OVER o AS n, sum((emotion IN ('joy', 'excitement', 'tenderness'))::INT) OVER f AS good, sum((emotion IN ('sadness', 'anger', 'fear'))::INT) OVER f AS bad FROM e
  WINDOW o AS (PARTITION BY user_id ORDER BY event_id), f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN n < 5 THEN 'stable' WHEN good > bad THEN 'improving' WHEN bad > good THEN 'declining' ELSE 'stable' END AS trend FROM w""",
)
def mood_trend(spark, sf_dir):
    return emotion.mood_trend(_emotions(spark, sf_dir), ["user_id"], "event_id").select("event_id", "trend")


@query(
    "conversation_timeline",
    """WITH t AS (SELECT conv_id, turn, length(text) / 15 AS duration, CASE WHEN turn % 2 = 0 THEN 0.0 ELSE 0.5 END AS pause FROM conversations),
s AS (SELECT *, coalesce(sum(duration + coalesce(nullif(pause, 0), 0.3)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_time FROM t)
SELECT conv_id, turn, round(start_time, 3)::DOUBLE AS start_time, round(start_time + duration, 3)::DOUBLE AS end_time FROM s""",
)
def conversation_timeline(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") / 15).alias("duration"), F.when(F.col("turn") % 2 == 0, 0.0).otherwise(0.5).alias("pause_after"))
    return timeline.conversation_timeline(lines, ["conv_id"], "turn").select("conv_id", "turn", F.round("start_time", 3).alias("start_time"), F.round("end_time", 3).alias("end_time"))


@query(
    "chapter_offsets",
    "SELECT source, doc_id, coalesce(sum(n_chars * 1000 // 15) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms, (n_chars * 1000 // 15)::BIGINT AS ms FROM documents",
)
def chapter_offsets(spark, sf_dir):
    chapters = table(spark, sf_dir, "documents").select("source", "doc_id", F.floor(F.col("n_chars") * 1000 / 15).alias("ms"))
    return timeline.running(chapters, ["source"], "doc_id", "ms", "start_ms").select("source", "doc_id", "start_ms", "ms")


@query(
    "segment_pauses",
    "SELECT conv_id, turn, greatest(0.3, CASE WHEN role = 'assistant' OR coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn) <> role, false) THEN 0.4 ELSE 0.0 END)::DOUBLE AS pause_after FROM conversations",
)
def segment_pauses(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), (F.col("role") == "assistant").alias("is_dialogue"))
    return timeline.segment_pauses(rows, ["conv_id"], "turn").select("conv_id", "turn", "pause_after")


@query(
    "cache_eviction",
    """WITH e AS (SELECT event_id AS key, ts, (abs(value) * 100)::BIGINT AS size FROM events), r AS (SELECT key, sum(size) OVER () - coalesce(sum(size) OVER w, 0) AS bytes_left, count(*) OVER () - coalesce(count(*) OVER w, 0) AS left_n, sum(size) OVER () AS total, count(*) OVER () AS n FROM e WINDOW w AS (ORDER BY ts, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT key FROM r WHERE (total > 1000000 OR n > 5000) AND (bytes_left > 800000 OR left_n > 4000)""",
)
def cache_eviction(spark, sf_dir):
    entries = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("ts").alias("created_at"), F.round(F.abs("value") * 100).cast("long").alias("size_bytes"))
    return timeline.evicted(entries, 1_000_000, 5000).select("key")


@query(
    "cache_hits",
    "WITH k AS (SELECT doc_id, md5(text || '|ff_siwis|1.00') AS key FROM documents) SELECT doc_id, key, EXISTS (SELECT 1 FROM k c WHERE c.doc_id % 2 = 0 AND c.key = k.key) AS hit FROM k",
)
def cache_hits(spark, sf_dir):
    keys = table(spark, sf_dir, "documents").select("doc_id", T.cache_key("text", F.lit("ff_siwis"), F.lit(1.0)).alias("key"))
    cached = keys.where("doc_id % 2 = 0").select("key").distinct().withColumn("hit", F.lit(True))
    return keys.join(cached, "key", "left").select("doc_id", "key", F.coalesce("hit", F.lit(False)).alias("hit"))


@query(
    "voice_assignment",
    """WITH c AS (SELECT conv_id, role AS key, count(*) AS n, min(turn) AS f, CASE role WHEN 'assistant' THEN 'F' WHEN 'user' THEN 'M' END AS gender FROM conversations GROUP BY conv_id, role),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, coalesce(gender, 'F') ORDER BY n DESC, f, key) - 1 AS t FROM c)
SELECT conv_id, key AS name, n AS occurrences, CASE WHEN gender = 'M' THEN (['am_adam', 'am_michael', 'bm_george', 'bm_lewis'])[t % 4 + 1] ELSE (['ff_siwis', 'af_heart', 'af_bella', 'af_sarah', 'bf_emma'])[t % 5 + 1] END AS voice FROM r""",
)
def voice_assignment(spark, sf_dir):
    cast = casting.characters(table(spark, sf_dir, "conversations"), ["conv_id"], "role", "turn")
    cast = cast.withColumn("gender", F.when(F.col("key") == "assistant", "F").when(F.col("key") == "user", "M"))
    return casting.assigned(cast, ["conv_id"]).select("conv_id", "name", "occurrences", "voice")


@query(
    "voiced_segments",
    """WITH c AS (SELECT conv_id, role AS key, count(*) AS n, min(turn) AS f FROM conversations GROUP BY conv_id, role HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, f, key) - 1 AS t FROM c)
SELECT s.conv_id, s.turn, coalesce((['ff_siwis', 'af_heart', 'af_bella', 'af_sarah', 'bf_emma'])[t % 5 + 1], 'ff_siwis') AS voice FROM conversations s LEFT JOIN r ON r.conv_id = s.conv_id AND r.key = s.role""",
)
def voiced_segments(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    cast = casting.characters(turns, ["conv_id"], "role", "turn").where("occurrences >= 2").withColumn("gender", F.lit("F"))
    return casting.voiced(turns, casting.assigned(cast, ["conv_id"]), ["conv_id"], "role").select("conv_id", "turn", "voice")


METRICS_SQL = "m AS (SELECT event_id, value % 10 - 25 AS rms_db, value % 7 - 6 AS peak_db, value % 5 - 3 AS true_peak_db, value % 13 - 66 AS noise_floor_db, CASE WHEN event_id % 11 = 0 THEN 22050 ELSE 44100 END AS sample_rate, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS channels FROM events)"


def _metrics(spark, sf_dir):
    v, e = F.col("value"), F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", (v % 10 - 25).alias("rms_db"), (v % 7 - 6).alias("peak_db"), (v % 5 - 3).alias("true_peak_db"), (v % 13 - 66).alias("noise_floor_db"), F.when(e % 11 == 0, 22050).otherwise(44100).alias("sample_rate"), F.when(e % 5 == 0, 2).otherwise(1).alias("channels"))


@query(
    "compliance_report",
    f"""WITH {METRICS_SQL}, r AS (SELECT event_id, (rms_db < -23 OR rms_db > -18)::INT + (peak_db > -3)::INT + (sample_rate < 44100)::INT AS failed, (true_peak_db > -1)::INT + (noise_floor_db > -60)::INT + (channels > 1)::INT AS warned FROM m)
SELECT event_id, (failed + warned)::INT AS n_issues, CASE WHEN failed > 0 THEN 'fail' WHEN warned > 0 THEN 'warning' ELSE 'pass' END AS status, failed = 0 AS is_compliant FROM r""",
)
def compliance_report(spark, sf_dir):
    return compliance.report(_metrics(spark, sf_dir), "event_id")


@query(
    "compliance_issues",
    f"""WITH {METRICS_SQL}, i AS (SELECT 'RMS/Loudness' AS parameter, 'fail' AS level FROM m WHERE rms_db < -23 OR rms_db > -18 UNION ALL SELECT 'Peak', 'fail' FROM m WHERE peak_db > -3 UNION ALL SELECT 'True Peak', 'warning' FROM m WHERE true_peak_db > -1
  UNION ALL SELECT 'Noise Floor', 'warning' FROM m WHERE noise_floor_db > -60 UNION ALL SELECT 'Sample Rate', 'fail' FROM m WHERE sample_rate < 44100 UNION ALL SELECT 'Channels', 'warning' FROM m WHERE channels > 1)
SELECT parameter, level, count(*) AS n FROM i GROUP BY parameter, level""",
)
def compliance_issues(spark, sf_dir):
    return compliance.issues(_metrics(spark, sf_dir), "event_id").groupBy("parameter", "level").agg(F.count(F.lit(1)).alias("n"))


@query(
    "rule_stats",
    "SELECT confidence, action, section, count(*) AS n FROM (SELECT CASE event_type WHEN 'view' THEN 'high' WHEN 'click' THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN user_id % 4 = 0 THEN 'flag' ELSE 'replace' END AS action, 's' || (event_id % 3) AS section FROM events) GROUP BY GROUPING SETS ((), (confidence), (action), (section))",
)
def rule_stats(spark, sf_dir):
    rules = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "view", "high").when(F.col("event_type") == "click", "medium").otherwise("low").alias("confidence"), F.when(F.col("user_id") % 4 == 0, "flag").otherwise("replace").alias("action"), F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("section"))
    return compliance.rule_stats(rules)


RULES = (
    {"ord": 1, "pattern": r"(?U)\b(the)\b", "replacement": r"<\1>", "flags": ["i"]},
    {"ord": 2, "pattern": r"^(\w)", "replacement": r"[\1]", "flags": ["m"]},
    {"ord": 3, "pattern": r"tion", "replacement": "sion", "flags": []},
)


# Word boundaries of the two engines differ beside letters that are not ASCII, so the SQL names them as a class.
@query(
    "rule_rewrite",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(^|[^\p{L}\p{N}_])(the)($|[^\p{L}\p{N}_])', '\1<\2>\3', 'gi'), '(^|[^\p{L}\p{N}_<])(the)($|[^\p{L}\p{N}_>])', '\1<\2>\3', 'gi'), '(?m)^([0-9A-Za-z_])', '[\1]', 'g'), 'tion', 'sion', 'g')) AS digest FROM documents""",
)
def rule_rewrite(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(compliance.rewritten(F.col("text"), list(RULES))).alias("digest"))


# Number words once more, by rules written in SQL alone.
_FR_WORDS = "['', 'un', 'deux', 'trois', 'quatre', 'cinq', 'six', 'sept', 'huit', 'neuf', 'dix', 'onze', 'douze', 'treize', 'quatorze', 'quinze', 'seize', 'dix-sept', 'dix-huit', 'dix-neuf']"
_EN_WORDS = "['', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen']"
_FR_TENS, _EN_TENS = "['', '', 'vingt', 'trente', 'quarante', 'cinquante', 'soixante']", "['', '', 'twenty', 'thirty', 'forty', 'fifty', 'sixty', 'seventy', 'eighty', 'ninety']"
_FR99 = f"CASE WHEN r < 20 THEN {_FR_WORDS}[r + 1] WHEN r < 70 THEN {_FR_TENS}[r // 10 + 1] || CASE r % 10 WHEN 0 THEN '' WHEN 1 THEN '-et-un' ELSE '-' || {_FR_WORDS}[r % 10 + 1] END WHEN r < 80 THEN 'soixante-' || {_FR_WORDS}[r - 59] WHEN r = 80 THEN 'quatre-vingts' ELSE 'quatre-vingt-' || {_FR_WORDS}[r - 79] END"
_EN99 = f"CASE WHEN r < 20 THEN {_EN_WORDS}[r + 1] ELSE {_EN_TENS}[r // 10 + 1] || CASE r % 10 WHEN 0 THEN '' ELSE '-' || {_EN_WORDS}[r % 10 + 1] END END"
WORDS_SQL = f"""words AS (SELECT list(trim(CASE WHEN h = 0 THEN '' WHEN h = 1 THEN 'cent ' ELSE {_FR_WORDS}[h + 1] || ' cent' || CASE WHEN r = 0 THEN 's' ELSE ' ' END END || ({_FR99})) ORDER BY n) AS f,
  list(trim(CASE WHEN h = 0 THEN '' ELSE {_EN_WORDS}[h + 1] || ' hundred ' END || ({_EN99})) ORDER BY n) AS e FROM (SELECT n, n // 100 AS h, n % 100 AS r FROM range(1000) AS t(n)))"""


def in_words_sql(n: str, lang: str) -> str:
    """SQL for a positive whole number under 10^12 in words; needs the table `words`."""
    w = "f" if lang == "fr" else "e"
    groups = [("milliard", "milliards"), ("million", "millions")] if lang == "fr" else [("billion", "billion"), ("million", "million")]
    parts = [f"CASE WHEN {n} // {size} % 1000 = 0 THEN '' ELSE {w}[{n} // {size} % 1000 + 1] || CASE WHEN {n} // {size} % 1000 = 1 THEN ' {one} ' ELSE ' {many} ' END END" for size, (one, many) in zip((10**9, 10**6), groups, strict=True)]
    thousand = "mille" if lang == "fr" else "thousand"
    first = "'mille '" if lang == "fr" else "e[2] || ' thousand '"
    parts.append(f"CASE WHEN {n} // 1000 % 1000 = 0 THEN '' WHEN {n} // 1000 % 1000 = 1 THEN {first} ELSE {w}[{n} // 1000 % 1000 + 1] || ' {thousand} ' END")
    return "trim(" + " || ".join([*parts, f"{w}[{n} % 1000 + 1]"]) + ")"


@query(
    "numbers_in_words",
    f"""WITH {WORDS_SQL}, o AS (SELECT o_orderkey, (round(o_totalprice * 100) * (1 + o_orderkey % 50))::BIGINT AS n FROM orders)
SELECT o_orderkey, {in_words_sql("n", "fr")} AS french, {in_words_sql("n", "en")} AS english FROM o, words""",
)
def numbers_in_words(spark, sf_dir):
    n = (F.round(F.col("o_totalprice") * 100) * (1 + F.col("o_orderkey") % 50)).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", N.in_words(n, "fr").alias("french"), N.in_words(n, "en").alias("english"))


@query(
    "dates_in_words",
    f"""WITH {WORDS_SQL}, d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)
SELECT strftime(d, '%Y-%m-%d') AS d, CASE WHEN day(d) = 1 THEN 'premier' ELSE f[day(d) + 1] END || ' ' || (['janvier', 'février', 'mars', 'avril', 'mai', 'juin', 'juillet', 'août', 'septembre', 'octobre', 'novembre', 'décembre'])[month(d)] || ' ' || {in_words_sql("year(d)", "fr")} AS said FROM d, words""",
)
def dates_in_words(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return days.select(F.date_format("d", "yyyy-MM-dd").alias("d"), N.date_in_words("d").alias("said"))


@query(
    "prices_in_words",
    f"""WITH {WORDS_SQL}, p AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice * 100)::BIGINT // 100 AS n, round(l_extendedprice * 100)::BIGINT % 100 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN n = 0 THEN 'zéro' ELSE {in_words_sql("n", "fr")} END || CASE WHEN n > 1 THEN ' euros' ELSE ' euro' END || CASE WHEN c = 0 THEN '' WHEN c = 1 THEN ' et un centime' ELSE ' et ' || f[c + 1] || ' centimes' END AS said FROM p, words""",
)
def prices_in_words(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.money_in_words("l_extendedprice").alias("said"))


@query(
    "emotion_distribution",
    f"WITH {EMOTIONS_SQL} SELECT emotion, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE AS share FROM e GROUP BY emotion ORDER BY n DESC, emotion LIMIT 5",
)
def emotion_distribution(spark, sf_dir):
    """The five most frequent emotions with their share of all segments (a top-k report)."""
    counts = _emotions(spark, sf_dir).groupBy("emotion").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("emotion", "n", F.round(F.col("n") * 100.0 / F.col("total"), 4).alias("share")).orderBy(F.desc("n"), "emotion").limit(5)


@query(
    "script_statistics",
    "SELECT role AS speaker, count(*) AS lines, sum(length(text))::BIGINT AS chars, round(avg(length(text)), 4) AS mean_chars, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role",
)
def script_statistics(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("speaker")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).cast("long").alias("chars"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.countDistinct("conv_id").alias("conversations"))


@query(
    "inter_phrase_variation",
    f"WITH {SENTENCES_SQL} SELECT doc_id, pos::INT AS sent_idx, round(1 + sin((pos + 1) * 0.7) * 0.03, 6)::DOUBLE AS variation FROM sentences",
)
def inter_phrase_variation(spark, sf_dir):
    rows = segments.sentences(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select("doc_id", "sent_idx", F.round(1 + F.sin((F.col("sent_idx") + 1) * 0.7) * 0.03, 6).alias("variation"))


@query(
    "roman_numerals",
    "SELECT event_id, (1 + event_id % 3999)::INT AS value FROM events",
)
def roman_numerals(spark, sf_dir):
    n = 1 + F.col("event_id") % 3999
    numeral = F.lit("")
    digits = (("M", "", ""), ("C", "D", "M"), ("X", "L", "C"), ("I", "V", "X"))
    for (one, five, ten), place in zip(digits, (1000, 100, 10, 1), strict=True):
        d = F.floor(n / place) % 10
        numeral = F.concat(numeral, F.when(d == 9, one + ten).when(d == 4, one + five).otherwise(F.concat(F.when(d >= 5, F.lit(five)).otherwise(""), F.repeat(F.lit(one), (d % F.lit(5 if five else 10)).cast("int")))))
    return table(spark, sf_dir, "events").select("event_id", T.roman_value(numeral).alias("value"))


TAGGED_SQL = "g AS (SELECT event_id, '[' || event_type || '] go [' || (['laughs', 'mad', 'long', 'pause', 'soft', 'thunder'])[event_id % 6 + 1] || '] now' AS text FROM events)"


def _tagged(spark, sf_dir):
    second = F.element_at(F.array(*map(F.lit, ("laughs", "mad", "long", "pause", "soft", "thunder"))), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("["), "event_type", F.lit("] go ["), second, F.lit("] now")).alias("text"))


_TAG_ROWS = ", ".join(
    f"('{n}', '{t[0]}', {t[3]}::DOUBLE, {t[4]}::DOUBLE, {t[5]}::DOUBLE, {t[6]}::DOUBLE, {t[7]}::DOUBLE)" for t in tags.TAGS for n in [t[0], *(a for a, of in tags.ALIASES.items() if of == t[0])]
)
_TAGS_SQL = f"known AS (SELECT * FROM (VALUES {_TAG_ROWS}) AS t(name, tag, speed, volume, pitch, before, after))"


@query(
    "inline_tags",
    f"WITH {TAGGED_SQL}, {_TAGS_SQL}, n AS (SELECT event_id, unnest(regexp_extract_all(text, '\\[([A-Za-z_ -]+)\\]', 1)) AS name FROM g) SELECT tag, count(*) AS n FROM n JOIN known USING (name) GROUP BY tag",
)
def inline_tags(spark, sf_dir):
    return segments.tags(_tagged(spark, sf_dir), ["event_id"], tags.known_tags(spark)).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "tag_prosody",
    f"""WITH {TAGGED_SQL}, {_TAGS_SQL}, n AS (SELECT event_id, lower(unnest(regexp_extract_all(text, '\\[([A-Za-z_ -]+)\\]', 1))) AS name FROM g),
a AS (SELECT event_id, product(speed) AS speed, product(volume) AS volume, sum(pitch) AS pitch, max(before) AS b, max(after) AS f FROM n JOIN known USING (name) GROUP BY event_id)
SELECT g.event_id, round(least(greatest(coalesce(speed, 1.0), 0.5), 1.5), 4)::DOUBLE AS speed, round(least(greatest(coalesce(volume, 1.0), 0.3), 1.5), 4)::DOUBLE AS volume, round(least(greatest(coalesce(pitch, 0.0), -1.0), 1.0), 4)::DOUBLE AS pitch, coalesce(b, 0)::DOUBLE AS pause_before, coalesce(f, 0)::DOUBLE AS pause_after FROM g LEFT JOIN a USING (event_id)""",
)
def tag_prosody(spark, sf_dir):
    p = _tagged(spark, sf_dir).select("event_id", tags.prosody("text").alias("p"))
    return p.select("event_id", *[F.round(f"p.{c}", 4).alias(c) for c in ("speed", "volume", "pitch")], "p.pause_before", "p.pause_after")


@query(
    "voice_blends",
    """WITH s AS (SELECT event_id, event_id % 80 AS a FROM events), v AS (
  SELECT event_id, 0 AS pos, 'a' AS voice, a::DOUBLE AS share FROM s UNION ALL SELECT event_id, 1, 'b', (100 - a) / 2 FROM s UNION ALL SELECT event_id, 2, 'c', (100 - a) / 2 FROM s)
SELECT event_id, pos::INT AS pos, voice, round(share / 100, 6)::DOUBLE AS weight FROM v""",
)
def voice_blends(spark, sf_dir):
    specs = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("a:"), (F.col("event_id") % 80).cast("string"), F.lit(", b,c")).alias("spec"))
    return segments.voice_blend(specs, ["event_id"], "spec").withColumn("weight", F.round("weight", 6))


@query(
    "signal_crossfade",
    """WITH v AS (SELECT user_id, list(value / 1000 ORDER BY event_id) AS s FROM events GROUP BY user_id), k AS (SELECT user_id, s[1:len(s) // 2] AS a, s[len(s) // 2 + 1:] AS b FROM v),
o AS (SELECT *, least(4, len(a), len(b)) AS n FROM k),
z AS (SELECT user_id, list_concat(list_concat(a[1:len(a) - n], list_transform(range(0, n), lambda i: a[len(a) - n + 1 + i] * (1 - CASE WHEN n > 1 THEN i / (n - 1) ELSE 0 END) + b[1 + i] * CASE WHEN n > 1 THEN i / (n - 1) ELSE 0 END)), b[n + 1:]) AS m FROM o)
SELECT user_id, unnest(range(len(m)))::INT AS i, round(unnest(m), 6)::DOUBLE AS x FROM z""",
)
def signal_crossfade(spark, sf_dir):
    """Each user's signal, its second half faded into its first."""
    signals = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", (F.col("value") / 1000).alias("x")))).alias("s"))
    signals = signals.select("user_id", F.transform("s", lambda z: z["x"]).alias("s")).withColumn("half", F.floor(F.size("s") / 2).cast("int"))
    mixed = signals.select("user_id", S.crossfade(F.slice("s", F.lit(1), F.col("half")), F.slice("s", F.col("half") + 1, F.size("s")), 4, curve="linear").alias("m"))
    return mixed.select("user_id", F.posexplode("m").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(
    "signal_levels",
    """WITH v AS (SELECT user_id, list(value / 1000 ORDER BY event_id) AS s FROM events GROUP BY user_id)
SELECT user_id, round(20 * log10(list_max(list_transform(s, lambda x: abs(x)))), 4)::DOUBLE AS peak, round(10 * log10(list_sum(list_transform(s, lambda x: x * x)) / len(s)), 4)::DOUBLE AS rms FROM v""",
)
def signal_levels(spark, sf_dir):
    signals = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", (F.col("value") / 1000).alias("x")))).alias("s"))
    signals = signals.select("user_id", F.transform("s", lambda z: z["x"]).alias("s"))
    return signals.select("user_id", F.round(S.peak_db("s"), 4).alias("peak"), F.round(S.rms_db("s"), 4).alias("rms"))


@query(
    "corrections_merge",
    "WITH u AS (SELECT 'k' || event_id AS original, 'a' || event_id % 7 AS replacement, 0 AS r FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT 'k' || event_id, 'b', 1 FROM events WHERE event_id % 2 = 0) SELECT original, arg_max(replacement, r) AS replacement FROM u GROUP BY original",
)
def corrections_merge(spark, sf_dir):
    """Two tables of corrections that share a third of their keys."""
    events = table(spark, sf_dir, "events").withColumn("original", F.concat(F.lit("k"), F.col("event_id").cast("string")))
    base = events.where("event_id % 3 <> 0").select("original", F.concat(F.lit("a"), (F.col("event_id") % 7).cast("string")).alias("replacement"))
    later = events.where("event_id % 2 = 0").select("original", F.lit("b").alias("replacement"))
    return catalog.merged([base, later], "original")


@query(
    "style_blends",
    "WITH s AS (SELECT * FROM (VALUES (0, 'formal', 0.95, 1.2, false), (1, 'conversational', 1.05, 0.9, true), (2, 'dramatic', 0.9, 1.3, true)) AS t(n, style, base_speed, pause_multiplier, dynamic)), e AS (SELECT event_id, event_id % 3 AS a, user_id % 3 AS b, least(greatest(value / 97.3, 0), 1) AS f FROM events) SELECT event_id, x.style AS a, y.style AS b, round(x.base_speed + (y.base_speed - x.base_speed) * f, 6)::DOUBLE AS base_speed, round(x.pause_multiplier + (y.pause_multiplier - x.pause_multiplier) * f, 6)::DOUBLE AS pause_multiplier, x.dynamic OR y.dynamic AS dynamic FROM e JOIN s x ON x.n = e.a JOIN s y ON y.n = e.b",
)
def style_blends(spark, sf_dir):
    """Two styles mixed for each event, by its value."""
    rows = [("formal", 0.95, 1.2, False), ("conversational", 1.05, 0.9, True), ("dramatic", 0.9, 1.3, True)]
    styles = spark.createDataFrame(rows, "style string, base_speed double, pause_multiplier double, dynamic boolean")
    named = lambda c: F.element_at(F.array(*[F.lit(r[0]) for r in rows]), (F.col(c) % 3 + 1).cast("int"))
    pairs = table(spark, sf_dir, "events").select("event_id", named("event_id").alias("a"), named("user_id").alias("b"), F.least(F.greatest(F.col("value") / 97.3, F.lit(0)), F.lit(1)).alias("factor"))
    out = catalog.blended(styles, pairs, ["base_speed", "pause_multiplier"], ["dynamic"])
    return out.select("event_id", "a", "b", F.round("base_speed", 6).alias("base_speed"), F.round("pause_multiplier", 6).alias("pause_multiplier"), "dynamic")


@query(
    "book_manifest",
    r"SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS number, 'T' || doc_id AS title, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INT AS words, length(text)::INT AS chars FROM documents",
)
def book_manifest(spark, sf_dir):
    docs = timeline.running(table(spark, sf_dir, "documents").withColumn("one", F.lit(1)), ["source"], "doc_id", "one", "before")
    chapters = docs.select("source", (F.col("before") + 1).cast("int").alias("number"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"))
    return sinks.manifest(chapters, ["source"]).drop("minutes")


@query(
    "rss_feeds",
    r"""WITH i AS (SELECT lang, 1 AS part, 'http://h/' || doc_id AS url, '<item>' || chr(10) || '<title>D ' || doc_id || ' &amp; co</title>' || chr(10) || '<enclosure url="http://h/' || doc_id || '" length="' || n_chars || '" type="audio/mpeg" />' || chr(10) || '<guid>http://h/' || doc_id || '</guid>' || chr(10) || '<pubDate>' || strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id * 61), '%a, %d %b %Y %H:%M:%S') || ' +0000</pubDate>' || chr(10) || '</item>' AS xml FROM documents),
c AS (SELECT DISTINCT lang FROM documents)
SELECT lang, part, url, xml FROM i UNION ALL
SELECT lang, 0, NULL, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<rss version="2.0">' || chr(10) || '<channel>' || chr(10) || '<title>' || lang || '</title>' || chr(10) || '<link>http://h</link>' || chr(10) || '<language>fr</language>' FROM c UNION ALL
SELECT lang, 2, NULL, '</channel>' || chr(10) || '</rss>' FROM c""",
)
def rss_feeds(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    date = F.timestamp_add("MINUTE", F.col("doc_id") * 61, F.lit("2024-01-01").cast("timestamp"))
    items = table(spark, sf_dir, "documents").select("lang", F.concat(F.lit("D "), d, F.lit(" & co")).alias("title"), F.concat(F.lit("http://h/"), d).alias("url"), F.col("n_chars").alias("size"), F.lit("audio/mpeg").alias("type"), date.alias("date"))
    return sinks.rss(items, ["lang"], F.col("lang"), "http://h").select("lang", "part", "url", "xml")


@query("narration_plan")
def narration_plan(spark, sf_dir):
    rows = narration.narrated(dealt(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"], "text")
    return rows.select("doc_id", "sent_idx", "emotion", "narrative", "contour", "transition", F.round("final_speed", 4).alias("final_speed"), F.round("start_time", 3).alias("start_time"), F.round("end_time", 3).alias("end_time"))


@query("chapter_report")
def chapter_report(spark, sf_dir):
    rows = narration.narrated(dealt(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"], "text")
    return narration.chapter_report(rows, ["doc_id"])


from . import files, marked, more, ordered, spoken  # noqa: E402, F401  (register their queries in the tables above)
