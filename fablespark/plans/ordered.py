"""Named queries of ordered work: filters and dynamics of long signals, noise, breaths, previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import breath_sounds as B
from ..functions import text as T
from ..operators import breaths, preview, segments, waves
from ..operators.attribution import EMOTIONAL
from .queries import SENTENCES_SQL, query, spread, table

BLOCK = 4096
RATE = 100.0


def _blocks(spark, sf_dir):
    """Each user's values as a signal, in blocks of at most BLOCK events, with the events' ids beside the samples."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("event_id") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("event_id", (F.col("value") / 1000).alias("x")))).alias("s"))
    return rows.select("user_id", "block", F.transform("s", lambda z: z["x"]).alias("samples"))


def _each(blocks):
    return blocks.select("user_id", "block", F.posexplode("samples").alias("i", "x")).withColumn("x", F.round("x", 5))


_PLACED = f"row_number() OVER (PARTITION BY user_id, event_id // {BLOCK} ORDER BY event_id) - 1"


def _zero_phase_sql(section: waves.Section) -> str:
    """A section run forth and back over each user's signal, one row at a time."""
    b0, b1, b2, a1, a2 = map(repr, section)
    gain = sum(section[:3]) / (1 + section[3] + section[4])
    r0, r1 = repr(gain - section[0]), repr(section[2] - section[4] * gain)
    run = lambda name, source: f"""{name} AS (
  SELECT user_id, n, {b0} * x + {r0} * x AS y, {b1} * x - {a1} * ({b0} * x + {r0} * x) + {r1} * x AS s0, {b2} * x - {a2} * ({b0} * x + {r0} * x) AS s1 FROM {source} WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, {b0} * x + s0, {b1} * x - {a1} * ({b0} * x + s0) + s1, {b2} * x - {a2} * ({b0} * x + s0) FROM {name} f JOIN {source} e ON e.user_id = f.user_id AND e.n = f.n + 1)"""  # noqa: E731
    return f"""WITH RECURSIVE v AS MATERIALIZED (
  SELECT user_id, event_id // {BLOCK} AS block, {_PLACED} AS i, (value / 1000)::DOUBLE AS x, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
e AS MATERIALIZED (
  SELECT user_id, n + 9 AS n, x FROM v WHERE c > 9
  UNION ALL SELECT a.user_id, 11 - b.n, 2 * a.x - b.x FROM v a JOIN v b USING (user_id) WHERE a.n = 1 AND a.c > 9 AND b.n BETWEEN 2 AND 10
  UNION ALL SELECT a.user_id, a.c + 9 + a.c - b.n, 2 * a.x - b.x FROM v a JOIN v b USING (user_id) WHERE a.n = a.c AND a.c > 9 AND b.n BETWEEN a.c - 9 AND a.c - 1),
{run("forth", "e")},
r AS MATERIALIZED (SELECT user_id, max(n) OVER (PARTITION BY user_id) + 1 - n AS n, y AS x, max(n) OVER (PARTITION BY user_id) AS m FROM forth),
{run("back", "r")}
SELECT v.user_id, v.block, v.i::INT AS i, round(coalesce(b.y, v.x), 5)::DOUBLE AS x FROM v LEFT JOIN back b ON b.user_id = v.user_id AND b.n = v.c + 10 - v.n AND v.c > 9
"""


_BELL, _SHELF = waves.peak_section(RATE, 12.0, 6.0, 1.5), waves.high_shelf_section(RATE, 30.0, -4.0)


@query("bell_equalised", _zero_phase_sql(_BELL))
def bell_equalised(spark, sf_dir):
    return _each(waves.peak_eq(_blocks(spark, sf_dir), ["user_id"], RATE, 12.0, 6.0, 1.5))


@query("shelf_equalised", _zero_phase_sql(_SHELF))
def shelf_equalised(spark, sf_dir):
    return _each(waves.high_shelf(_blocks(spark, sf_dir), ["user_id"], RATE, 30.0, -4.0))


@query(
    "compressed_signals",
    f"""WITH RECURSIVE v AS MATERIALIZED (SELECT user_id, event_id // {BLOCK} AS block, {_PLACED} AS i, (value / 1000)::DOUBLE AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
e AS (SELECT user_id, n, (CASE WHEN abs(x) > 0 THEN 1 - exp(-1.0 / 3) ELSE 1 - exp(-1.0 / 20) END * abs(x))::DOUBLE AS e FROM v WHERE n = 1
  UNION ALL SELECT v.user_id, v.n, CASE WHEN abs(x) > e THEN exp(-1.0 / 3) * e + (1 - exp(-1.0 / 3)) * abs(x) ELSE exp(-1.0 / 20) * e + (1 - exp(-1.0 / 20)) * abs(x) END FROM e JOIN v ON v.user_id = e.user_id AND v.n = e.n + 1),
t AS (SELECT pow(10, -34.0 / 20) AS t)
SELECT user_id, block, i::INT AS i, round(x * CASE WHEN e > t THEN (t + (e - t) / 3) / e ELSE 1 END, 5)::DOUBLE AS x FROM v JOIN e USING (user_id, n), t""",
)
def compressed_signals(spark, sf_dir):
    return _each(waves.compressed(_blocks(spark, sf_dir), ["user_id"], RATE, threshold_db=-34.0, attack_ms=30.0, release_ms=200.0))


_DRAW_SQL = "('0x' || substr(md5(user_id || ':{k}:' || ({i})), 1, 8))::BIGINT / 2147483648.0 - 1"


@query(
    "room_tone",
    f"""WITH v AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
SELECT user_id, i::INT AS i, round(({" + ".join("(" + _DRAW_SQL.format(k=k, i=f"i // {1 << k}") + ")" for k in range(6))}) * 0.01 / sqrt(6), 8)::DOUBLE AS pink, round(({_DRAW_SQL.format(k=-1, i="i")}) * 0.0001, 10)::DOUBLE AS white FROM v""",
)
def room_tone(spark, sf_dir):
    """A sample of noise for each event of a user, made by blocks of 64 that know nothing of each other."""
    counts = table(spark, sf_dir, "events").groupBy("user_id").count()
    blocks = counts.select("user_id", "count", F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / 64))).alias("b")).select("user_id", (F.col("b") * 64).alias("start"), F.least(F.lit(64), F.col("count") - F.col("b") * 64).alias("n"))
    key, start, n = F.col("user_id"), F.col("start"), F.col("n")
    rows = blocks.select("user_id", "start", F.posexplode(F.arrays_zip(waves.pink_noise(key, start, n, 6, 0.01).alias("pink"), waves.white_noise(key, start, n, 0.0001).alias("white"))).alias("i", "z"))
    return rows.select("user_id", (F.col("start") + F.col("i")).cast("int").alias("i"), F.round("z.pink", 8).alias("pink"), F.round("z.white", 10).alias("white"))


def _spoken(spark, sf_dir):
    """Sentences with their words, and a mood by their closing mark."""
    rows = segments.sentences(table(spark, sf_dir, "documents"), ["doc_id"]).withColumn("words", T.word_count("sentence"))
    mark = F.substring(T.strip("sentence"), -1, 1)
    comma = F.contains("sentence", F.lit(","))
    return rows.withColumn("emotion", F.when(mark == "!", "excitement").when(comma, "suspense").otherwise("neutral")).withColumn("intensity", F.when(mark == "!", "high").when(F.col("words") > 12, "medium").otherwise("low"))


_BREATHS_SQL = rf"""WITH RECURSIVE {SENTENCES_SQL},
s AS (SELECT doc_id, pos, len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda w: w <> '')) AS words, right(trim(sentence, E' \t\n\r'), 1) AS mark, contains(sentence, ',') AS comma,
  floor(20 * (0.7 + 0.6 * (('0x' || substr(md5(doc_id || ':' || pos), 1, 8))::BIGINT / 4294967296.0)::DOUBLE))::INT AS draw FROM sentences),
d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, CASE WHEN mark = '!' THEN 'excitement' WHEN comma THEN 'suspense' ELSE 'neutral' END AS emotion,
  CASE WHEN mark = '!' THEN 'high' WHEN words > 12 THEN 'medium' ELSE 'low' END AS intensity,
  floor(20 * (0.7 + 0.6 * (('0x' || substr(md5(doc_id || ':start'), 1, 8))::BIGINT / 4294967296.0)::DOUBLE))::INT AS first FROM s)"""


@query(
    "breath_markers",
    _BREATHS_SQL
    + """,
w AS (SELECT doc_id, n, words > first AS over, CASE WHEN words > first THEN 0 ELSE words END AS said, CASE WHEN words > first THEN draw ELSE first END AS threshold FROM d WHERE n = 1
  UNION ALL SELECT d.doc_id, d.n, said + d.words > threshold, CASE WHEN said + d.words > threshold THEN 0 ELSE said + d.words END, CASE WHEN said + d.words > threshold THEN d.draw ELSE threshold END FROM w JOIN d ON d.doc_id = w.doc_id AND d.n = w.n + 1)
SELECT doc_id, (pos)::INT AS sent_idx, over OR (intensity IN ('high', 'extreme') AND coalesce(lag(emotion) OVER (PARTITION BY doc_id ORDER BY n) <> emotion, false)) OR (emotion IN ('suspense', 'fear') AND intensity <> 'low') AS breath_before FROM w JOIN d USING (doc_id, n)""",
)
def breath_markers(spark, sf_dir):
    return breaths.breath_markers(_spoken(spark, sf_dir), ["doc_id"], "sent_idx").select("doc_id", "sent_idx", "breath_before")


@query(
    "breath_pauses",
    _BREATHS_SQL
    + """,
w AS (SELECT doc_id, n, NULL::VARCHAR AS breath, words AS said, first AS threshold FROM d WHERE n = 1
  UNION ALL SELECT d.doc_id, d.n, CASE WHEN said > threshold * 1.5 THEN 'deep' WHEN said > threshold THEN 'soft' END, CASE WHEN said > threshold THEN d.words ELSE said + d.words END, CASE WHEN said > threshold THEN d.draw ELSE threshold END FROM w JOIN d ON d.doc_id = w.doc_id AND d.n = w.n + 1)
SELECT doc_id, pos::INT AS sent_idx, breath FROM w JOIN d USING (doc_id, n)""",
)
def breath_pauses(spark, sf_dir):
    return breaths.breath_pauses(_spoken(spark, sf_dir), ["doc_id"], "sent_idx").select("doc_id", "sent_idx", "breath")


def _score_sql(p: str) -> str:
    words = " + ".join(f"contains(lower({p}), '{w}')::INT" for w in EMOTIONAL["en"])
    return f"({words} + (length({p}) - length(replace({p}, '!', ''))) * 0.5 + (length({p}) - length(replace({p}, '...', ''))) / 3 * 0.3)"


@query(
    "preview_selection",
    rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents),
e AS (SELECT doc_id, i, p[i] AS t, p[1] AS opening FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)),
one AS (SELECT doc_id, t AS s1, length(t) AS n1 FROM e WHERE i = 1),
spoken AS (SELECT doc_id, arg_min(t, i) AS t FROM e WHERE i > 1 AND regexp_matches(t, '[«"].*?[»"]|[-–—]\s*.+') GROUP BY doc_id),
moved AS (SELECT doc_id, t FROM (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY {_score_sql("t")} DESC, i) AS r, {_score_sql("t")} AS score FROM e WHERE i > 1) WHERE r = 1 AND score > 0),
two AS (SELECT doc_id, [s1] || CASE WHEN n1 + length(t) < 450 THEN [t] ELSE [] END AS s FROM one LEFT JOIN spoken USING (doc_id)),
three AS (SELECT doc_id, s || CASE WHEN list_sum(list_transform(s, lambda x: length(x))) + length(t) < 450 AND NOT list_contains(s, t) THEN [t] ELSE [] END AS s FROM two LEFT JOIN moved USING (doc_id)),
size AS (SELECT doc_id, s, list_sum(list_transform(s, lambda x: length(x))) AS n FROM three),
others AS (SELECT e.doc_id, t, min(i) AS i FROM e JOIN size USING (doc_id) WHERE i > 1 AND NOT list_contains(s, t) GROUP BY ALL),
running AS (SELECT doc_id, i, t, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM others),
filled AS (SELECT doc_id, list(t ORDER BY i) AS f FROM running JOIN size USING (doc_id) WHERE n < 450 * 0.7 AND n + total < 450 GROUP BY doc_id),
whole AS (SELECT doc_id, array_to_string(s || coalesce(f, []), chr(10) || chr(10)) AS w FROM size LEFT JOIN filled USING (doc_id)),
cut AS (SELECT doc_id, w, substr(w, 1, 450) AS c FROM whole), ends AS (SELECT *, greatest(CASE WHEN contains(c, '.') THEN length(c) - strpos(reverse(c), '.') + 1 ELSE 0 END, CASE WHEN contains(c, '!') THEN length(c) - strpos(reverse(c), '!') + 1 ELSE 0 END, CASE WHEN contains(c, '?') THEN length(c) - strpos(reverse(c), '?') + 1 ELSE 0 END) AS stop FROM cut)
SELECT doc_id, md5(coalesce(CASE WHEN length(w) <= 450 THEN w WHEN stop - 1 > 225 THEN substr(c, 1, stop) ELSE c END, substr(text, 1, 450))) AS digest FROM documents LEFT JOIN ends USING (doc_id)""",
)
def preview_selection(spark, sf_dir):
    """Previews of all documents, their lines taken for paragraphs."""
    text = F.regexp_replace("text", "\n", "\n\n")
    shown = T.let(text, lambda t: preview.preview(t, "en"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.when(T.strip("text") == "", F.substring("text", 1, 450)).otherwise(shown)).alias("digest"))


@query(
    "breathing_sentences",
    rf"""WITH {SENTENCES_SQL}, p AS (SELECT doc_id, pos, sentence, string_split(sentence, ',') AS p, len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda w: w <> '')) AS n FROM sentences)
SELECT doc_id, pos::INT AS sent_idx, md5(CASE WHEN n > 25 AND len(p) > 1 THEN array_to_string(list_transform(p, lambda x, i: CASE WHEN i = len(p) // 2 + 1 THEN '[breath:soft] ' || trim(x, E' \t\n\r') ELSE x END), ', ') ELSE sentence END) AS digest FROM p""",
)
def breathing_sentences(spark, sf_dir):
    return segments.sentences(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "sent_idx", F.md5(breaths.breathing_sentence("sentence")).alias("digest"))


_TAGS_AT = ("gasp", "sigh", "breath", "breath:soft", "breath:deep", "inhale", "exhale", "beat", "door")
_STEADY_SQL = "((('0x' || substr(md5(event_id || ':-1:' || {i}), 1, 8))::BIGINT / 2147483648.0)::DOUBLE - 1) * sqrt(3)"


@query(
    "tag_sounds",
    f"""WITH k AS (SELECT * FROM (VALUES {", ".join(f"('{t}', '{k}', {s}, {B.KINDS[k][0]}, {max(1, round(B.KINDS[k][1] * 800 / 24000))})" for t, (k, s) in B.TAG_SOUNDS.items())}) AS t(tag, kind, seconds, loud, width)),
e AS (SELECT event_id, ([{", ".join(f"'{t}'" for t in _TAGS_AT)}])[event_id % 9 + 1] AS tag FROM events),
r AS (SELECT event_id, kind, loud, width, floor(seconds::DOUBLE * (0.9 + 0.2 * (('0x' || substr(md5(event_id || ':length'), 1, 8))::BIGINT / 4294967296.0)::DOUBLE) * 800)::INT AS n FROM e JOIN k USING (tag)),
x AS (SELECT event_id, kind, loud, width, n, i, i / greatest(n - 1, 1) AS t FROM (SELECT *, unnest(range(n)) AS i FROM r)),
s AS (SELECT event_id, i, n, width, {_STEADY_SQL.format(i="i")} * CASE kind WHEN 'soft' THEN pow(sin(pi() * t), 2) WHEN 'sharp' THEN sqrt(t) * pow(1 - t, 4) * 5 WHEN 'deep' THEN t * t * sqrt(1 - t) * 2 WHEN 'gasp' THEN exp(-5 * t) * (1 - exp(-20 * t)) * 3 ELSE pow(t, 0.3) * exp(-2 * t) * 2.5 END * loud * 0.5 AS v FROM x),
g AS (SELECT event_id, i, sum(v) OVER (PARTITION BY event_id ORDER BY i RANGE BETWEEN width - 1 - (width - 1) // 2 PRECEDING AND (width - 1) // 2 FOLLOWING) / width AS y FROM s)
SELECT event_id, count(*)::INT AS n, round(sum(y), 6)::DOUBLE AS total, round(sum(y * y), 8)::DOUBLE AS power FROM g GROUP BY event_id
UNION ALL SELECT event_id, 240, round(sum({_STEADY_SQL.format(i="i")} * 0.0001), 6)::DOUBLE, round(sum(pow({_STEADY_SQL.format(i="i")} * 0.0001, 2)), 8)::DOUBLE FROM (SELECT event_id, unnest(range(240)) AS i FROM e WHERE tag = 'beat') GROUP BY event_id
UNION ALL SELECT event_id, 0, NULL, NULL FROM e WHERE tag = 'door'""",
)
def tag_sounds(spark, sf_dir):
    """The sound of a tag for each event, at 800 samples a second."""
    tag = F.element_at(F.array(*map(F.lit, _TAGS_AT)), (F.col("event_id") % 9 + 1).cast("int"))
    rows = B.tag_sounds(spread(table(spark, sf_dir, "events").select("event_id")), tag, F.col("event_id"), "s", 0.5, 800)
    total = lambda f: F.aggregate("s", F.lit(0.0), lambda a, x: a + f(x))
    return rows.select("event_id", F.coalesce(F.size("s"), F.lit(0)).alias("n"), F.round(total(lambda x: x), 6).alias("total"), F.round(total(lambda x: x * x), 8).alias("power"))


@query(
    "softened_silences",
    """WITH v AS (SELECT user_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, (value / 1000)::DOUBLE AS x, lead(value / 1000) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
t AS (SELECT user_id, i, n, CASE WHEN abs(x) >= 0.02 AND abs(next) < 0.02 THEN 1 WHEN abs(x) < 0.02 AND abs(next) >= 0.02 THEN -1 END AS turn FROM v),
f AS (SELECT user_id, i AS start, least(5, n - i) AS len, false AS rising FROM t WHERE turn = 1 AND i > 5 UNION ALL SELECT user_id, greatest(i - 5, 0), i - greatest(i - 5, 0), true FROM t WHERE turn = -1 AND i < n - 5),
g AS (SELECT user_id, start + j AS i, CASE WHEN rising THEN c ELSE 1 - c END AS gain FROM (SELECT *, (1 - cos(j / greatest(len - 1, 1) * pi())) / 2 AS c FROM (SELECT *, unnest(range(len)) AS j FROM f))),
p AS (SELECT user_id, i, product(gain) AS gain FROM g GROUP BY ALL)
SELECT user_id, (i // 64)::BIGINT AS block, (i % 64)::INT AS i, round(x * coalesce(gain, 1), 9)::DOUBLE AS x FROM v LEFT JOIN p USING (user_id, i)""",
)
def softened_silences(spark, sf_dir):
    return waves.softened_silences(_blocks(spark, sf_dir), ["user_id"], RATE, 0.02, 0.05, 64).select("user_id", "block", F.posexplode("samples").alias("i", "x")).withColumn("x", F.round("x", 9))
