"""Named queries of word-level markup, prosody curves, dictionaries, names and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html
from ..functions import text as T
from ..operators import catalog, dictionary, markup
from .queries import query, spread, table

_LISTED = ", ".join(f"'{w}'" for w in markup.AUTO_EMPHASIS)

#: Words of a document, 0-based, as they are wrapped: <em>, <slow> over two words, <loud> with a pitch inside, *, a pause, and a tag left open at the end.
_WORDS_SQL = rf"""w AS (SELECT doc_id, w, i, len(all_words) AS n FROM (SELECT doc_id, a AS all_words, unnest(a) AS w, unnest(range(len(a))) AS i FROM (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, '*_<>[]', ''), '\s+'), lambda x: x <> '') AS a FROM documents))),
k AS (SELECT *, i % 11 = 3 AS em, i % 11 = 8 AS star, (i % 11 = 5 AND i + 1 < n) OR i % 11 = 6 AS slow, i % 11 = 9 AS loud FROM w),
p AS (SELECT *, em OR star OR (NOT slow AND NOT loud AND regexp_replace(lower(w), '[^\p{{L}}\p{{N}}_]', '', 'g') IN ({_LISTED})) AS stressed FROM k),
words AS (SELECT doc_id, i::INT AS word_idx, w AS word, round(CASE WHEN stressed THEN 0.92 WHEN slow THEN 0.8 ELSE 1.0 END, 4)::DOUBLE AS speed, round(CASE WHEN stressed THEN 0.5 WHEN loud THEN 2.3 ELSE 0 END, 4)::DOUBLE AS pitch,
  round(CASE WHEN stressed THEN 1.1 WHEN loud THEN 1.3 ELSE 1.0 END, 4)::DOUBLE AS volume, CASE WHEN stressed THEN 0.05 ELSE 0.0 END::DOUBLE AS pause_before, CASE WHEN i % 11 = 0 AND i + 1 < n THEN 0.4 ELSE 0.0 END::DOUBLE AS pause_after, stressed AS is_emphasis FROM p
  UNION ALL SELECT doc_id, n::INT, '<fast>', 1.0, 0.0, 1.0, 0.0, 0.0, false FROM w WHERE i = 0)"""


def _marked(spark, sf_dir):
    a = T.words(F.translate("text", "*_<>[]", ""))
    on = lambda i, k: i % 11 == k

    def wrapped(w, i, n):
        tight = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
        return (
            F.when(on(i, 3), tight("<EM>", w, "</em>"))
            .when(on(i, 8), tight("*", w, "*"))
            .when(on(i, 5) & (i + 1 < n), tight("<slow>", w))
            .when(on(i, 6), tight(w, "</slow>"))
            .when(on(i, 9), tight("<loud><pitch  high>", w, "</loud></pitch>"))
            .when(on(i, 0) & (i + 1 < n), tight(w, "[pause:0.25]<pause/>"))
            .otherwise(w)
        )

    text = T.let(a, lambda x: F.array_join(F.concat(F.transform(x, lambda w, i: wrapped(w, i, F.size(x))), F.when(F.size(x) > 0, F.array(F.lit("<fast>"))).otherwise(F.expr("cast(array() as array<string>)"))), " "))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")).select("doc_id", "n_chars", text.alias("text"))


@query("word_prosody", f"WITH {_WORDS_SQL} SELECT * FROM words")
def word_prosody(spark, sf_dir):
    rows = markup.words(_marked(spark, sf_dir), ["doc_id"])
    return rows.select("doc_id", "word_idx", "word", *[F.round(c, 4).alias(c) for c in ("speed", "pitch", "volume", "pause_before", "pause_after")], "is_emphasis")


@query("marked_clean", rf"WITH {_WORDS_SQL} SELECT doc_id, md5(coalesce(string_agg(word, ' ' ORDER BY word_idx), '')) AS digest FROM documents LEFT JOIN words USING (doc_id) GROUP BY doc_id")
def marked_clean(spark, sf_dir):
    return markup.clean_text(_marked(spark, sf_dir), ["doc_id"]).select("doc_id", F.md5("clean").alias("digest"))


@query(
    "prosody_curves",
    rf"""WITH {_WORDS_SQL}, t AS (SELECT doc_id, floor(n_chars / 15.0 * 20)::BIGINT AS samples FROM documents),
c AS (SELECT doc_id, pitch, volume, speed, length(word) AS n, sum(length(word)) OVER (PARTITION BY doc_id ORDER BY word_idx) - length(word) AS before, sum(length(word)) OVER (PARTITION BY doc_id) AS every FROM words),
s AS (SELECT doc_id, pitch, volume, speed, floor(before::DOUBLE / every::DOUBLE * samples)::BIGINT AS a, floor((before + n)::DOUBLE / every::DOUBLE * samples)::BIGINT AS b FROM c JOIN t USING (doc_id)
  UNION ALL SELECT doc_id, 0, 1, 1, 0, samples FROM t WHERE doc_id NOT IN (SELECT doc_id FROM words) AND samples > 0),
g AS (SELECT *, unnest(range(a // 256, (b - 1) // 256 + 1)) AS block FROM s WHERE a < b),
o AS (SELECT doc_id, block, least(b, (block + 1) * 256) - greatest(a, block * 256) AS n, pitch, volume, speed FROM g)
SELECT doc_id, block, sum(n)::INT AS n, round(sum(n * pitch), 3)::DOUBLE AS pitch, round(sum(n * volume), 3)::DOUBLE AS volume, round(sum(n * speed), 3)::DOUBLE AS speed FROM o GROUP BY ALL""",
)
def prosody_curves(spark, sf_dir):
    texts = _marked(spark, sf_dir).withColumn("samples", F.floor(F.col("n_chars") / 15.0 * 20))
    out = markup.curves(texts, markup.words(texts, ["doc_id"]), ["doc_id"], block=256)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 3).alias(c)
    return out.select("doc_id", "block", F.size("pitch").alias("n"), total("pitch"), total("volume"), total("speed"))


def _dictionary(spark, sf_dir):
    """A key for each word of five letters or more of the benchmark, and the word turned round."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("key")).where(F.length("key") >= 5)
    return words.select(F.lower("key").alias("key")).distinct().withColumn("replacement", F.concat(F.lit("<"), F.reverse("key"), F.lit(">")))


_DICTIONARY_SQL = r"""keys AS (SELECT DISTINCT lower(w) AS key, '<' || reverse(lower(w)) || '>' AS replacement FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM benchmark) WHERE length(w) >= 5),
pieces AS (SELECT doc_id, unnest(p) AS p, unnest(range(len(p))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]') AS p FROM documents)),
done AS (SELECT doc_id, md5(string_agg(coalesce(replacement, p), '' ORDER BY i)) AS digest, count(key)::INT AS n_replaced FROM pieces LEFT JOIN keys ON key = lower(p) GROUP BY doc_id)"""


@query("dictionary_rewrite", f"WITH {_DICTIONARY_SQL} SELECT doc_id, CASE WHEN text = '' THEN md5('') ELSE digest END AS digest, coalesce(n_replaced, 0)::INT AS n_replaced FROM documents LEFT JOIN done USING (doc_id)")
def dictionary_rewrite(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dictionary.rewritten(docs, _dictionary(spark, sf_dir)).select("doc_id", F.md5("text").alias("digest"), "n_replaced")


@query("dictionary_rewrite_joined", f"WITH {_DICTIONARY_SQL} SELECT doc_id, CASE WHEN text = '' THEN md5('') ELSE digest END AS digest, coalesce(n_replaced, 0)::INT AS n_replaced FROM documents LEFT JOIN done USING (doc_id)")
def dictionary_rewrite_joined(spark, sf_dir):
    """The same by the join that takes a dictionary of any size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dictionary.rewritten(docs, _dictionary(spark, sf_dir), most=0).select("doc_id", F.md5("text").alias("digest"), "n_replaced")


@query(
    "phoneme_lookup",
    r"""WITH b AS (SELECT p_name AS word, 'ʃ' || p_partkey || 'ɛ' AS ipa FROM part), g AS (SELECT word, min(ipa) AS ipa FROM b GROUP BY word),
c AS (SELECT lower(word) AS word, min('œ' || ipa) AS ipa FROM g WHERE length(word) % 3 = 0 GROUP BY lower(word)), w AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE p_name || '?' END AS word FROM part)
SELECT p_partkey, coalesce(c.ipa, e.ipa, l.ipa) AS ipa, replace(replace(replace(coalesce(c.ipa, e.ipa, l.ipa), 'ɛ', 'è'), 'œ', 'eu'), 'ʃ', 'ch') AS spelled FROM w LEFT JOIN c ON c.word = lower(w.word) LEFT JOIN g e ON e.word = w.word LEFT JOIN g l ON l.word = lower(w.word)""",
)
def phoneme_lookup(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    builtin = part.select(F.col("p_name").alias("word"), F.concat(F.lit("ʃ"), k.cast("string"), F.lit("ɛ")).alias("ipa"))
    custom = builtin.where(F.length("word") % 3 == 0).groupBy("word").agg(F.min("ipa").alias("ipa")).withColumn("ipa", F.concat(F.lit("œ"), "ipa"))
    words = part.select("p_partkey", F.when(k % 3 == 0, F.upper("p_name")).when(k % 3 == 1, F.col("p_name")).otherwise(F.concat("p_name", F.lit("?"))).alias("word"))
    return dictionary.phonemes(words, custom, builtin).select("p_partkey", "ipa", dictionary.readable_phonemes("ipa").alias("spelled"))


@query(
    "voices_by_name",
    """WITH v AS (SELECT s_name || ' ' || p_name AS name, p_partkey AS ord, 'voice' || p_partkey AS voice FROM part JOIN supplier ON s_suppkey = p_partkey % 100),
a AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN substr(p_name, 2, 4) WHEN 2 THEN substr(p_name, 1, 2) WHEN 3 THEN s_name || ' ' || p_name ELSE lpad(c_custkey::VARCHAR, 5, '0') || ' ' || p_name END AS name FROM customer LEFT JOIN part ON p_partkey = c_custkey % 200 JOIN supplier ON s_suppkey = c_custkey % 100),
e AS (SELECT name, min(ord) AS ord FROM v GROUP BY name), h AS (SELECT n.name, min(ord) AS ord FROM (SELECT DISTINCT name FROM a) n JOIN v ON contains(lower(v.name), lower(n.name)) GROUP BY n.name)
SELECT c_custkey, 'voice' || coalesce(e.ord, h.ord) AS voice FROM a LEFT JOIN e USING (name) LEFT JOIN h USING (name)""",
)
def voices_by_name(spark, sf_dir):
    part, supplier, customer = (table(spark, sf_dir, t) for t in ("part", "supplier", "customer"))
    named = F.concat("s_name", F.lit(" "), "p_name")
    voices = part.join(supplier, F.col("s_suppkey") == F.col("p_partkey") % 100).select(named.alias("name"), F.col("p_partkey").alias("ord"), F.concat(F.lit("voice"), F.col("p_partkey").cast("string")).alias("voice"))
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, F.upper("p_name")).when(k % 5 == 1, F.substring("p_name", 2, 4)).when(k % 5 == 2, F.substring("p_name", 1, 2)).when(k % 5 == 3, named).otherwise(F.concat(F.lpad(k.cast("string"), 5, "0"), F.lit(" "), "p_name"))
    asked = customer.join(part, F.col("p_partkey") == k % 200, "left").join(supplier, F.col("s_suppkey") == k % 100).select("c_custkey", name.alias("name"))
    return catalog.found_by_name(asked, voices, "name", "ord", "voice").select("c_custkey", "voice")


@query(
    "page_lines",
    rf"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script[^>]*>|<style\b[^>]*>.*?</style[^>]*>|<[!?][^>]*>', '', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(h, '(?is)<nav\b[^>]*>.*?</nav[^>]*>|<header\b[^>]*>.*?</header[^>]*>|<footer\b[^>]*>.*?</footer[^>]*>', '', 'g') AS h FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '(?i)<h[1-3]\b[^>]*>', chr(10) || chr(10), 'g'), '(?i)<(?:p|div|h[4-6]|br)\b[^>]*>|</(?:p|div|h[1-6])\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g') AS h FROM b),
d AS (SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&amp;', '&'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' +', ' ', 'g'), E' \t\n\r' || chr(160)) AS h FROM c)
SELECT page_id, length(h)::INT AS n_chars, md5(h) AS digest, (length(h) - length(replace(h, chr(10), '')))::INT AS n_breaks FROM d""",
)
def page_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", html.page_lines("html").alias("t"))
    return rows.select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"), (F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit("")))).alias("n_breaks"))


@query(
    "page_markdown",
    r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script[^>]*>|<style\b[^>]*>.*?</style[^>]*>|<[!?][^>]*>', '', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', E'\n## \\1\n', 'g'), '(?is)<h2\b[^>]*>(.*?)</h2\s*>', E'\n### \\1\n', 'g'), '(?is)<h3\b[^>]*>(.*?)</h3\s*>', E'\n#### \\1\n', 'g'), '(?is)<h4\b[^>]*>(.*?)</h4\s*>', E'\n##### \\1\n', 'g') AS h FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)</p\s*>', E'\n\n', 'g'), '<[^>]+>', '', 'g') AS h FROM b)
SELECT page_id, md5(regexp_replace(replace(replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&copy;', '©'), '&amp;', '&'), '\n{3,}', E'\n\n', 'g')) AS digest FROM c""",
)
def page_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(html.page_markdown("html")).alias("digest"))
