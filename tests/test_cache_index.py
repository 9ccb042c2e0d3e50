"""The cache index: newest row of a key, writers at once, changes that never came into force, compaction."""

import threading

import pytest
from pyspark.sql import functions as F

from fablespark.sources.cache import ENTRY, ROW, CacheIndex


def rows(spark, *pairs, size=10):
    data = [(k, "v", 1.0, p, size, 1.0, "t") for k, p in pairs]
    frame = spark.createDataFrame(data, "key string, voice_id string, speed double, path string, size_bytes long, duration double, text_preview string")
    return frame.withColumn("created_at", F.lit("2024-01-01").cast("timestamp")).withColumn("extra", F.lit(1))


def held(index):
    return {r.key: r.path for r in index.entries().collect()}


@pytest.fixture
def index(spark, tmp_path):
    return CacheIndex(spark, str(tmp_path / "index"))


def test_newest_counts(spark, index):
    assert held(index) == {}
    index.put(rows(spark, ("a", "1"), ("b", "1"), (None, "1"), ("d", "1"), ("d", "2")))
    index.put(rows(spark, ("a", "2"), ("c", "2")))
    assert held(index) == {"a": "2", "b": "1", "c": "2", "d": "2"}
    index.remove(rows(spark, ("b", ""), ("zz", "")))
    assert set(held(index)) == {"a", "c", "d"}
    index.compact()
    index.compact()
    assert held(index) == {"a": "2", "c": "2", "d": "2"} and len(index._changes()) == 1
    index.put(rows(spark, ("b", "3")))
    assert held(index)["b"] == "3"
    index.clear()
    assert held(index) == {}


def test_an_older_put_that_comes_late_does_not_win(spark, tmp_path):
    slow, fast = (CacheIndex(spark, str(tmp_path / "i"), clock=lambda t=t: t) for t in (1, 2))
    fast.put(rows(spark, ("a", "new")))
    fast.remove(rows(spark, ("b", "")))
    fast.compact()
    slow.put(rows(spark, ("a", "old"), ("b", "old")))
    assert held(fast) == {"a": "new"}


def test_writers_at_once_lose_nothing(spark, index):
    errors = []

    def write(i):
        try:
            index.put(rows(spark, (f"k{i}", str(i)), ("shared", str(i))))
            if i % 3 == 0:
                index.compact()
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(9)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and set(held(index)) == {"shared", *(f"k{i}" for i in range(9))}


def test_a_change_without_its_marker_is_not_in_force(spark, index):
    index.put(rows(spark, ("a", "1")))
    dead = rows(spark, ("a", "9"), ("x", "9")).drop("extra").selectExpr(*[c.split()[0] for c in ENTRY.split(", ")], "false removed", "9999999999999999999 % 9000000000000000000 version", "'dead' change")
    dead.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in ROW.split(", ")], "change").write.parquet(f"{index.folder}/data/dead")
    assert held(index) == {"a": "1"}


def test_lookups(spark, index):
    index.put(rows(spark, ("a", "1"), ("b", "2"), ("c", "3"), size=1 << 20))
    files = spark.createDataFrame([("1",), ("3",), ("3",)], "path string")
    asked = spark.createDataFrame([("a",), ("b",), ("b",), ("zz",), (None,)], "key string")
    answers = index.looked_up(asked, files)
    assert sorted(map(str, ((r.key, r.path) for r in answers.collect()))) == sorted(map(str, [("a", "1"), ("b", None), ("b", None), ("zz", None), (None, None)]))
    assert index.stats(answers).first().asDict() == {"entries": 3, "size_mb": 3.0, "hits": 1, "misses": 4}
    index.drop_stale(files, asked)
    assert set(held(index)) == {"a", "c"} and index.stats().first().hits == 0
    gone = index.evict(max_bytes=1 << 30, max_entries=1)
    assert {r.key for r in gone.collect()} == {"a", "c"} and held(index) == {}
