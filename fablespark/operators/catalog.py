"""Small keyed tables: corrections, voices, styles; upserts, unions and lookups as joins and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(tables: list[DataFrame], key: str) -> DataFrame:
    """Rows of all tables, the last table winning where they share a key."""
    out = None
    for rank, df in enumerate(tables):
        ranked = df.withColumn("_rank", F.lit(rank))
        out = ranked if out is None else out.unionByName(ranked)
    latest = Window.partitionBy(key).orderBy(F.desc("_rank"))
    return out.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_rank", "_n")


def removed(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def renamed(df: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key changes, moved behind all others in their old order; changes: key, new_key, value."""
    kept = removed(df, changes, key).select(key, "value", order)
    last = df.agg(F.max(order).alias("_last"))
    moved = df.select(key, order).join(changes, key).join(last, F.lit(True)).select(F.col("new_key").alias(key), "value", (F.col("_last") + F.col(order) + 1).alias(order))
    return kept.unionByName(moved)


def searched(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows that hold a text in one of the columns, whatever its case."""
    test = F.lit(False)
    for c in columns:
        test = test | F.contains(F.lower(c), F.lit(text.lower()))
    return df.where(test)


def blended(styles: DataFrame, pairs: DataFrame, numbers: list[str], flags: list[str]) -> DataFrame:
    """Styles mixed by pairs(a, b, factor): numbers interpolated, flags joined by or."""
    left, right = styles.select(F.col("style").alias("a"), *[F.col(c).alias(f"_a_{c}") for c in numbers + flags]), styles.select(F.col("style").alias("b"), *[F.col(c).alias(f"_b_{c}") for c in numbers + flags])
    out = pairs.join(left, "a").join(right, "b")
    mixed = [(F.col(f"_a_{c}") + (F.col(f"_b_{c}") - F.col(f"_a_{c}")) * F.col("factor")).alias(c) for c in numbers]
    return out.select(*pairs.columns, *mixed, *[(F.col(f"_a_{c}") | F.col(f"_b_{c}")).alias(c) for c in flags])


GRAM = 3


def _grams(text: str, n: int) -> Column:
    t = F.col(text)
    return F.when(F.length(t) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))))


def _firsts(entries: DataFrame, name: str, order: str, value: str) -> DataFrame:
    """_name and the first of the entries whose names differ in case alone: it answers for all, so that what is cut into parts grows with the names."""
    return entries.where(F.col(name).isNotNull()).groupBy(F.lower(name).alias("_name")).agg(F.min(F.struct(order, name, value)).alias("_e")).select("_name", "_e.*")


def found_by_name(asked: DataFrame, entries: DataFrame, name: str, order: str, value: str) -> DataFrame:
    """asked with `value`: that of the entry with this very name, else of the first entry whose name holds it, whatever the case; null if none does.

    Names of up to GRAM characters are looked up among the parts of all entries' names. A longer one
    is looked for only in entries that share its rarest part of GRAM characters, so no pair of tables is compared whole:
    every join is by equality, and a name that many entries have takes part once. An empty name is held by all; a null one by none.
    """
    first = lambda *by: F.min_by(value, F.struct(order, name)).alias(by[0])
    exact = entries.groupBy(name).agg(first("_exact"))
    low = _firsts(entries, name, order, value)
    wanted = asked.where(F.col(name).isNotNull()).select(F.lower(name).alias("_asked")).distinct()
    parts = low.select(F.explode(F.concat(*[F.coalesce(_grams("_name", n), F.array().cast("array<string>")) for n in range(1, GRAM + 1)])).alias("_asked"), name, order, value)
    short = parts.groupBy("_asked").agg(first("_held"))
    every = low.agg(first("_held")).select(F.lit("").alias("_asked"), "_held")
    postings = low.select("_name", name, order, value, F.explode(_grams("_name", GRAM)).alias("_gram"))
    counts = postings.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = wanted.where(F.length("_asked") > GRAM).select("_asked", F.explode(_grams("_asked", GRAM)).alias("_gram")).join(counts, "_gram", "left")
    rarest = rarest.groupBy("_asked").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("r")).where("r.n > 0").select("_asked", F.col("r.gram").alias("_gram"))
    long = rarest.join(postings, "_gram").where(F.contains("_name", F.col("_asked"))).groupBy("_asked").agg(first("_held"))
    held = short.unionByName(every).unionByName(long)
    out = asked.withColumn("_asked", F.lower(name)).join(exact, name, "left").join(held, "_asked", "left")
    return out.select(*asked.columns, F.coalesce("_exact", "_held").alias(value))
