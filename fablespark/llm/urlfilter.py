"""Temporal list join: every capture against the list entries in force when it was fetched.

A list is a log of dated changes: at `since`, a pattern is put on the list (listed = true, with a
category) or taken off it. Window functions turn the log into validity intervals [since, until);
of changes of one pattern at one moment the last by (listed, category) counts. Patterns are hosts,
which cover their subdomains, or a host with a leading path (host/path), which covers that path
and what lies below it. A capture asks for each of its patterns - the host and its parents of two
labels or more, the host with each leading path, to any depth - and the as-of join takes the
interval that holds its fetch time.

Intervals are dealt into buckets of BUCKET_DAYS and joined on (pattern, bucket), so neither a host
with most captures nor a pattern with a long log makes more than the entries of one bucket meet;
both sides are plain equi-joins, which adaptive execution splits where a host is hot.

Edge cases: a null or unparsable url has no patterns and is never blocked; a null fetch time
matches nothing; log rows with a null pattern or date are void; repeated rows are all kept; an
empty log blocks nothing; an empty capture table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DAYS = 64


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a leading www."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def patterns(url: Column) -> Column:
    """All patterns that cover a url, the most specific first."""
    host, parts = host_of(url), F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    labels = F.split(host, r"\.")
    depth = F.size(parts)
    paths = F.when(depth > 0, F.transform(F.sequence(depth, F.lit(1), F.lit(-1)), lambda n: F.concat_ws("/", host, F.array_join(F.slice(parts, F.lit(1), n), "/")))).otherwise(F.array().cast("array<string>"))
    hosts = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    return F.when(host != "", F.concat(paths, hosts)).otherwise(F.array().cast("array<string>"))


def intervals(log: DataFrame) -> DataFrame:
    """pattern, category, since, until (null: still in force) of all listed stretches."""
    known = log.where("pattern is not null and since is not null").select("pattern", F.col("since").cast("timestamp"), F.coalesce("listed", F.lit(True)).alias("listed"), "category")
    at_once = known.groupBy("pattern", "since").agg(F.max(F.struct("listed", "category")).alias("last"))
    order = Window.partitionBy("pattern").orderBy("since")
    return (
        at_once.select("pattern", "since", F.lead("since").over(order).alias("until"), "last.listed", "last.category")
        .where("listed")
        .drop("listed")
    )


def _bucket(time: Column) -> Column:
    return F.floor(F.unix_seconds(time) / (86400 * BUCKET_DAYS))


def verdicts(captures: DataFrame, log: DataFrame, horizon: Column | None = None) -> DataFrame:
    """page_id, host, fetched, blocked, n_entries, pattern and category (of the most specific entry in force).

    horizon: the time up to which open intervals are dealt into buckets; the last fetch time by default.
    """
    from .common import staged

    urls = captures.select("page_id", "url", F.col("fetched").cast("timestamp"))
    keyed = urls.select("page_id", "url", "fetched", F.posexplode(patterns(F.col("url"))).alias("rank", "pattern")).withColumn("bucket", _bucket(F.col("fetched")))
    if horizon is None:
        horizon = F.lit(captures.agg(F.max(F.col("fetched").cast("timestamp"))).first()[0])
    spread = staged(
        intervals(log)
        .where(F.col("since") <= horizon)
        .withColumn("bucket", F.explode(F.sequence(_bucket(F.col("since")), _bucket(F.least(F.coalesce("until", horizon), horizon)))))
        .withColumn("until", F.coalesce("until", F.lit("9999-01-01").cast("timestamp"))),
        "intervals",
    )
    # The most specific entry is the smallest rank; one partial minimum per capture, at most a few ranks gathered.
    hit = (
        keyed.join(spread, ["pattern", "bucket"])
        .where("fetched >= since and fetched < until")
        .groupBy(F.col("page_id").alias("_page"), F.col("url").alias("_url"), F.col("fetched").alias("_fetched"))
        .agg(F.size(F.collect_set("rank")).cast("long").alias("n_entries"), F.min(F.struct("rank", "pattern", "category")).alias("top"))
    )
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("url") == F.col("_url")) & (F.col("fetched") == F.col("_fetched"))
    return urls.join(hit, same, "left").select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        "fetched",
        F.col("n_entries").isNotNull().alias("blocked"),
        F.coalesce("n_entries", F.lit(0).cast("long")).alias("n_entries"),
        F.col("top.pattern").alias("pattern"),
        F.col("top.category").alias("category"),
    )
