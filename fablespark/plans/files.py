"""Named queries that write files in the shared folder and read them back: audio and the cache index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import audio
from ..sources.cache import CacheIndex, entry_columns
from ..sources.staging import shared_folder
from .queries import query, table

BLOCK = 4096


@query(
    "wav_files",
    f"""WITH s AS (SELECT user_id, event_id, greatest(-32767, least(32767, round(greatest(-1.0, least(1.0, value / 1000)) * 32767)))::BIGINT AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
SELECT 'u' || user_id % 10 || '/' || user_id || '.wav' AS path, (i // 64)::BIGINT AS block, count(*)::INT AS n, sum(v)::BIGINT AS total, sum(v * (i % 64 + 1))::BIGINT AS weighted FROM s GROUP BY ALL""",
)
def wav_files(spark, sf_dir):
    """Each user's values as an audio file of 16 bits, written and read again in blocks of 64 frames."""
    u = F.col("user_id").cast("string")
    path = F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"), F.lit("/"), u, F.lit(".wav"))
    s = F.array_sort(F.collect_list(F.struct("event_id", (F.col("value") / 1000).alias("x"))))
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("event_id") / BLOCK).alias("block")).agg(s.alias("s"))
    rows = rows.select(path.alias("path"), "block", F.lit(24000).alias("rate"), F.lit(1).alias("channels"), F.lit(2).alias("width"), audio.as_pcm(F.transform("s", lambda z: z["x"])).alias("samples"))
    folder = f"{shared_folder(spark)}/fable-wav-{uuid.uuid4().hex}"
    audio.write_wav(rows, folder)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    weighted = F.transform("samples", lambda x, i: x.cast("long") * (i + 1))
    return audio.read_wav(spark, folder, 64).select("path", "block", F.size("samples").alias("n"), total("samples").alias("total"), total(weighted).alias("weighted"))


@query(
    "cache_lookup",
    """WITH e AS (SELECT event_id, md5(event_type || '|' || 'v' || user_id % 5 || '|' || printf('%.2f', 1 + floor(value) % 40 / 100)) AS key, '/a/' || event_id || '.wav' AS path, 1000 + event_id % 500 AS size FROM events),
one AS (SELECT key, arg_max(path, event_id) AS path FROM e WHERE event_id % 4 = 0 GROUP BY key), two AS (SELECT key, arg_max(path, event_id) AS path FROM e WHERE event_id % 4 = 1 GROUP BY key),
gone AS (SELECT DISTINCT key FROM e WHERE event_id % 97 = 3), back AS (SELECT key, arg_max(path, event_id) AS path FROM e WHERE event_id % 211 = 5 GROUP BY key),
live AS (SELECT * FROM back UNION ALL SELECT * FROM two WHERE key NOT IN (SELECT key FROM back) AND key NOT IN (SELECT key FROM gone)
  UNION ALL SELECT * FROM one WHERE key NOT IN (SELECT key FROM back) AND key NOT IN (SELECT key FROM gone) AND key NOT IN (SELECT key FROM two)),
kept AS (SELECT key, path FROM live JOIN e USING (key, path) WHERE event_id % 7 <> 0)
SELECT event_id, kept.path FROM e LEFT JOIN kept USING (key)""",
)
def cache_lookup(spark, sf_dir):
    """Two puts, a removal and a third put, then requests for which some files are gone."""
    text, voice = F.col("event_type"), F.concat(F.lit("v"), (F.col("user_id") % 5).cast("string"))
    speed = 1 + F.floor("value") % 40 / 100
    events = table(spark, sf_dir, "events").select("event_id", *entry_columns(text, voice, speed), F.concat(F.lit("/a/"), F.col("event_id").cast("string"), F.lit(".wav")).alias("path"))
    rows = events.select("*", F.timestamp_seconds("event_id").alias("created_at"), (1000 + F.col("event_id") % 500).alias("size_bytes"), F.lit(1.0).alias("duration"))
    index = CacheIndex(spark, f"{shared_folder(spark)}/fable-cache-{uuid.uuid4().hex}")
    index.put(rows.where("event_id % 4 = 0"))
    index.put(rows.where("event_id % 4 = 1"))
    index.remove(rows.where("event_id % 97 = 3"))
    index.compact()
    index.put(rows.where("event_id % 211 = 5"))
    files = rows.where("event_id % 7 <> 0")
    return index.looked_up(events.select("event_id", "key"), files).select("event_id", "path")
