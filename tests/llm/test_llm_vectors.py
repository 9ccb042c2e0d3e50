"""Integer k-means, product codes and the quality model against brute-force versions, edge cases included."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from fablespark.llm import centroids, quality, vectorcodes

VECTORS = "vec_id long, embedding array<float>, label int, x long, code string, cluster string"


def vectors(dims=64, n=300):
    r = random.Random(11)
    ways = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    rows = [(i, [float(np.float32(0.2 * a + r.gauss(0, 0.05))) for a in ways[i % 12]], i % 3 if i % 5 else None) for i in range(n)]
    rows += [(i, rows[i][1], 1) for i in range(0, 40, 2)]  # repeated ids, equal vectors
    rows += [(None, rows[7][1], 2), (n, [0.0] * dims, 0), (n + 1, [1.5] * dims, 0)]
    rows += [(n + 2, None, 0), (n + 3, [math.nan] * dims, 0), (n + 4, [1.0] * (dims - 1) + [None], 0), (n + 5, [math.inf] + [0.0] * (dims - 1), 0)]
    rows += [(n + 6, [0.5] * (dims - 3), 4), (n + 7, [], 4), (n + 8, [1e30] + [0.0] * (dims - 1), 5)]
    return [(*row, 1, "c", "d") for row in rows]


def whole(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def kmeans_by_force(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v, *_ in rows if whole(v) and len(v) == dims and max(map(abs, v)) < 1e20]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, v in start]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in set(own):
            some = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            centres[j] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    last = [nearest(v) for _, v in kept]
    by = {j: sum(d for d, c in last if c == j) for j in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, j, d, by[j], sum(by.values()), sha[j]) for (i, _), (d, j) in zip(kept, last, strict=True)]


def text(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("k,rounds", [(8, 10), (400, 2), (1, 1)])
def test_centroids(spark, k, rounds):
    rows = vectors()
    got = [tuple(r) for r in centroids.clustered(spark.createDataFrame(rows, VECTORS).repartition(5), k, rounds).collect()]
    assert [r for r in got if r[0] == 308] == [(308, None, None, None, None, None)]
    assert text(r for r in got if r[1] is not None) == text(kmeans_by_force(rows, k, rounds, 64, 1024))


def test_centroids_of_nothing(spark):
    assert centroids.clustered(spark.createDataFrame([], VECTORS)).collect() == []
    assert centroids.clustered(spark.createDataFrame([(1, [1.0] * 3, 1, 1, "", "")], VECTORS)).collect() == []


@pytest.mark.parametrize("bits,dims", [(4, 3), (20, 64), (25, 64), (25, 7)])
def test_screening_never_loses_the_nearest(bits, dims):
    """Centroids one unit apart, far beyond what float32 can tell."""
    rng = np.random.default_rng(bits)
    base = rng.integers(-(1 << bits), 1 << bits, dims)
    c = base + rng.integers(-1, 2, (40, dims))
    x = np.concatenate((base + rng.integers(-2, 3, (500, dims)), rng.integers(-(1 << bits), 1 << bits, (500, dims)), c))
    want = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (centroids.nearest(x, c) == want).all()
    assert bits > 4 or centroids.shortlist(x, rng.integers(-16, 16, (40, dims))).sum() < 1000 * 40


def codes_by_force(rows, entries, rounds, scale, dims):
    kept = [(i, v and [math.floor(scale * c) for c in v], label) for i, v, label, *_ in rows if whole(v)]
    good = [(i, v, label) for i, v, label in kept if len(v) == dims and max(map(abs, v)) < 1 << 21]
    size = dims // 16
    first = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, v, _ in first] for p in range(16)]
    nearest = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(16):
            own = [nearest(p, cut(v, p))[1] for _, v, _ in good]
            new = list(books[p])
            for j in set(own):
                some = [cut(v, p) for (_, v, _), o in zip(good, own, strict=True) if o == j]
                new[j] = [sum(c) // len(some) for c in zip(*some, strict=True)]
            books[p] = new
    out, sums = [], {}
    for i, v, label in kept:
        found = [nearest(p, cut(v, p)) for p in range(16)] if (i, v, label) in good else None
        error = found and sum(d for d, _ in found)
        out.append((i, found and "".join(f"{j:02x}" for _, j in found), error, label))
        if found:
            sums[label] = sums.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, code, error, sums.get(label), sha) for i, code, error, label in out]


@pytest.mark.parametrize("dims,entries,rounds", [(64, 64, 2), (16, 200, 1), (48, 3, 2)])
def test_codes(spark, dims, entries, rounds):
    rows = vectors(dims, 150)
    got = vectorcodes.coded(spark.createDataFrame(rows, VECTORS).repartition(5), entries=entries, rounds=rounds).collect()
    assert text(map(tuple, got)) == text(codes_by_force(rows, entries, rounds, 256, dims))


def test_codes_of_nothing(spark):
    assert vectorcodes.coded(spark.createDataFrame([], VECTORS)).collect() == []
    [only] = vectorcodes.coded(spark.createDataFrame([(1, [], 3, 1, "", "")], VECTORS)).collect()
    assert tuple(only)[:4] == (1, None, None, None)


@pytest.mark.parametrize("entries,high", [(1, 10), (4, 10), (5, 3), (64, 2), (64, 200), (256, 1 << 20)])
def test_tree_search_finds_what_brute_force_finds(entries, high, monkeypatch):
    rng = np.random.default_rng(entries)
    books = rng.integers(-high, high, (3, entries, 4))
    x, part = rng.integers(-high, high, (2000, 4)), rng.integers(0, 3, 2000)
    x[:50] = books[part[:50], rng.integers(0, entries, 50)]
    code, squares = vectorcodes.search(vectorcodes.forest(books), x, part)
    every = ((x[:, None, :] - books[part]) ** 2).sum(axis=2)
    assert (code == every.argmin(axis=1)).all() and (squares == every.min(axis=1)).all()


def test_tree_search_skips_far_halves():
    """Of 256 entries in well-parted groups, a search measures only a few."""
    rng = np.random.default_rng(1)
    books = (rng.integers(-1000, 1000, (1, 32, 1, 4)) * 1000 + rng.integers(-9, 9, (1, 32, 8, 4))).reshape(1, 256, 4)
    trees, seen = vectorcodes.forest(books), []
    real = trees.members
    trees.members = type("Counted", (), {"__getitem__": lambda self, at: (seen.append(len(at[1])), real[at])[1]})()
    x = books[0, rng.integers(0, 256, 500)] + rng.integers(-3, 3, (500, 4))
    code, _ = vectorcodes.search(trees, x, np.zeros(500, np.int64))
    assert (code == ((x[:, None, :] - books[0]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert sum(seen) < 500 * 256 / 2


TEXTS = "doc_id long, text string, lang string, score double, quality string, predicted int"
WORDS = ["harbour", "lantern", "of", "the", "slowly", "river", "and", "winter", "a", "carried", "été", "Straße"]


def prose(r, n):
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


def junk(r, n):
    kind = r.randrange(4)
    words = [r.choice(WORDS) for _ in range(n)]
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " | ".join(words)
    if kind == 2:
        return " ".join(w for w in words[: n // 8 + 1] for _ in range(8))
    return " ".join(w + "###" for w in words)


def corpus(n=1200):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        bad = r.random() < 0.2
        parts = [prose(r, r.randrange(5, 150))] + ([junk(r, r.randrange(20, 90))] if bad else [])
        r.shuffle(parts)
        docs.append((i, "\n".join(parts), "en", 0.5, "x", 1))
        labels.append((i, 0 if bad else 1, 0))
    return docs, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality(spark):
    docs, labels = corpus()
    extra = [(2000, None, None, None, None, None), (2001, "", None, None, None, None), (None, "the river", None, None, None, None), (0, docs[0][1], "en", 0.5, "x", 1), (2002, "x" * 300_000, "en", 1.0, "", 0), (2003, "ab " * 200_000, "en", 1.0, "", 0)]
    frame = spark.createDataFrame(docs + extra, TEXTS).repartition(4)
    marks = spark.createDataFrame(labels + [(1, None, 0), (2, 7, 0), (None, 0, 0), labels[3], (99_999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.predict(frame, quality.train(frame, marks)).collect()
    assert len(got) == len(docs) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (r.doc_id is None or held(r.doc_id)) for r in got)
    by = {r.doc_id: r for r in got}
    out = [(by[i].predicted, y) for i, y, _ in labels if held(i)]
    assert sum(p == y for p, y in out) >= 0.97 * len(out)
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    assert by[2003].predicted == 0  # one phrase over and over


def test_quality_learns_nothing_from_held_out_rows(spark):
    docs, labels = corpus(400)
    frame = spark.createDataFrame(docs, TEXTS)
    flipped = [(i, 1 - y if held(i) else y, t) for i, y, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (quality.predict(frame, quality.train(frame, spark.createDataFrame(x, schema))).collect() for x in (labels, flipped))
    assert sorted(a) == sorted(b)


def test_quality_without_labels(spark):
    docs, labels = corpus(30)
    frame, schema = spark.createDataFrame(docs, TEXTS), "doc_id long, quality int, toxic int"
    assert {r.score for r in quality.predict(frame, quality.train(frame, spark.createDataFrame([], schema))).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1, 0) for i, *_ in labels], schema)
    assert all(r.score > 0.99 for r in quality.predict(frame, quality.train(frame, ones)).collect())
    none = spark.createDataFrame([], TEXTS)
    assert quality.predict(none, quality.train(none, ones)).collect() == []


def test_quality_features_do_not_depend_on_neighbours():
    import pyarrow as pa

    r = random.Random(4)
    texts = [prose(r, 30), "", None, "| a |", junk(r, 40), "|", "| |", "É ÀB", "Ab", "x\n\ny", "a a a", "a"]
    together = quality.describe(pa.array(texts))
    alone = np.concatenate([quality.describe(pa.array([t], pa.string())) for t in texts])
    assert (together == alone).all()
    row = dict(zip(quality.FEATURES, alone[texts.index("| a |")], strict=True))
    assert row["bare"] == 2 / 3 and row["run_marked"] == 3 and row["words"] == math.log(4)


def test_quality_tables_have_pairs():
    """A label that only a pair of features decides is learned by the pair's table."""
    rng = np.random.default_rng(5)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.Model()
    model.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    assert (model.pairs[0][0], model.pairs[0][1]) == (0, 1)
    shuffled = rng.permutation(len(x))
    again = quality.Model()
    again.fit(x[shuffled], y[shuffled])
    assert np.allclose(model.score(x), again.score(x))


def test_archives_are_read_in_linear_time():
    """Every byte behind a record is looked at once, not once a record."""
    import time

    from fablespark.llm import warc

    def seconds(n):
        records = [warc.record(i, f"http://h/{i}", b"body %d " % i * 20, "X", None) for i in range(n)]
        data = b"".join(warc.archive(records))
        start = time.perf_counter()
        assert [f["warc-record-id"] for f, _ in warc.records_of(data)] == [f"<urn:page:{i}>" for i in range(n)]
        return time.perf_counter() - start

    seconds(500)
    assert seconds(24_000) < 12 * seconds(4_000) + 0.2
    whole = b"".join(warc.archive([warc.record(1, "u", b"x" * 100, "X", None)]))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records_of(whole[:-3]))


def leaks_by_force(text, item):
    """Item words found, words of the item and the longest passage's worth, every shift tried and no seed asked."""
    import re

    cut = lambda t: [w for w in (re.sub(r"[!-/:-@\[-`{-~]", "", x.lower()) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")) if w]
    words, own = cut(text), cut(item)
    n, best, found = len(own), [False] * len(own), [False] * len(own)
    for shift in range(-n + 1, len(words)):
        equal = [0 <= shift + j < len(words) and words[shift + j] == own[j] for j in range(n)]
        at = [j for j in range(n) if equal[j]]
        if len(at) > sum(best):
            best = equal
        parts = [[]]
        for j in at:
            if parts[-1] and j - parts[-1][-1] > 3:
                parts.append([])
            parts[-1].append(j)
        for part in parts:
            if len(part) >= 4 and len(part) >= 0.6 * (part[-1] - part[0] + 1):
                for j in part:
                    found[j] = True
    found = [a or b for a, b in zip(best, found, strict=True)]
    worth = most = 0
    for f in found:
        worth = max(0, worth + (1 if f else -2))
        most = max(most, worth)
    return sum(found), n, most


def test_decontamination_against_every_shift(spark):
    """No pair is reported that brute force clears; of those it finds, nearly all are reported, of clear ones all."""
    from fablespark.llm import decontaminate

    r = random.Random(21)
    vocabulary = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r", "s")]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(r.choice([5, 8, 12, 20, 40, 90])))) for i in range(40)]
    docs = []
    for d in range(260):
        item = items[r.randrange(len(items))][1].split()
        kept = item[r.randrange(len(item)) :] if r.random() < 0.3 else list(item)
        for _ in range(r.randrange(0, 1 + len(kept) // 2)):
            at = r.randrange(len(kept))
            kept[at : at + r.choice([1, 1, 1, 0])] = [r.choice(vocabulary)]
        docs.append((d, " ".join([*say(r.randrange(60)), *(kept if r.random() < 0.8 else []), *say(r.randrange(60))])))
    got = {(x.doc_id, x.item_id): x.n_equal for x in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    leak, clear = set(), set()
    for d, text in docs:
        for i, item in items:
            found, n, worth = leaks_by_force(text, item)
            if (found >= min(8, n) and found >= 0.6 * n) or worth >= 13:
                leak.add((d, i))
                if (found >= min(8, n) and found >= 0.8 * n) or worth >= 20:
                    clear.add((d, i))
            assert got.get((d, i), 0) <= found
    assert got.keys() <= leak and clear <= got.keys()
    assert len(leak) > 80 and len(got) >= 0.9 * len(leak)
