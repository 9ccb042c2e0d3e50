"""Every operator against a brute-force version on small fixtures, edge cases included."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fablespark.llm import chat, decontaminate, embeddings, jaccard, langid, packing, pii, substrings, urlfilter, warc

DOCS = "doc_id long, text string, lang string, node long, spans string"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sa", "to", "vi") for b in ("ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lu", "mo")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus():
    base = prose(1, 300)
    rows = [(1, base), (2, base), (3, base.replace(" ", "\n", 3)), (4, base + " tail"), (5, prose(2, 200)), (6, None), (7, ""), (8, "  \t"), (9, "one"), (10, "One"), (11, "one two"), (12, "a b c"), (None, base), (5, prose(2, 200)), (13, prose(3, 4000)), (14, "x" * 5000), (15, "lala " * 400), (16, "lala " * 390 + "lalo")]
    words = base.split()
    r = random.Random(5)
    for i in range(20, 60):
        w = words[:]
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        rows.append((i, " ".join(w)))
    for i in range(60, 70):
        rows.append((i, prose(i, 60) + " " + prose(999, 120) + " " + prose(i + 100, 60)))
    return [(a, b, "en", 1, "x") for a, b in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components_by_force(rows, k, num):
    sets = [(d, shingle_set(t, k)) for d, t, *_ in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= num * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in sets}


@pytest.mark.parametrize("k,num,small,part", [(3, 90, 16, 1 << 20), (5, 80, 16, 1 << 20), (3, 90, 3, 700)])
def test_jaccard_components(docs, monkeypatch, k, num, small, part):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "PART_SHINGLES", part)
    got = jaccard.components_of(docs, k, num, 100).collect()
    assert len(got) == len(corpus())
    want = components_by_force(corpus(), k, num)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)
    sizes = {d: len(shingle_set(t, k)) for d, t, *_ in corpus()}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got)


def test_jaccard_keeps_one_of_each(docs, nothing):
    want = components_by_force(corpus(), 5, 80)
    kept = jaccard.one_of_each(docs).collect()
    assert {r.doc_id for r in kept} == {None, *want.values()}
    assert kept[0].asDict().keys() == {"doc_id", "text", "lang", "node", "spans"}
    assert jaccard.components_of(nothing, 3, 90, 100).count() == 0


def test_jaccard_links_every_text_of_a_repeated_id(spark):
    a, b = prose(1, 80), prose(2, 80)
    for first, second in ((a, b), (b, a)):
        frame = spark.createDataFrame([(1, first), (1, second), (2, a + " tail"), (3, b + " tail")], "doc_id long, text string")
        assert {r.doc_id: r.component_id for r in jaccard.components_of(frame, 3, 90, 100).collect()} == {1: 1, 2: 1, 3: 1}


def test_tree_bound_loses_no_link():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, rng.integers(50, 120)).astype(np.uint64)) for _ in range(150)]
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    points = jaccard.points(np.concatenate(sets), offsets)
    sizes = np.diff(offsets)
    found = {(i, int(j)) for i, hits in jaccard.RTree(points, sizes).search(points, sizes, 30, 100) for j in hits}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            if 100 * both >= 30 * (len(a) + len(b) - both):
                assert (i, j) in found


def test_cells_meet_for_every_link():
    rng = np.random.default_rng(4)
    levels = jaccard.Levels(80, 100)
    for n in (5, 9, 30, 200, 1500):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
            gone = rng.integers(0, max(1, len(a) // 5) + 1)
            b = np.unique(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 1 << 60, rng.integers(0, 1 + max(1, len(a) // 12))).astype(np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both) and len(a) + len(b) != 2 * both:
                keys, offsets = jaccard.cells(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), levels)
                assert np.intersect1d(keys[: offsets[1]], keys[offsets[1] :]).size


PAGES = "page_id long, url string, html string, digest string"


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "<p>é</p>"), (2, "http://b/ x", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "http://c/\r\nX: y", "z" * 200000), (6, "u", "once"), (6, "u", "once"), (None, "u", "<p>é</p>")]
    rows += [(i, f"http://h/{i}", f"<html><body>{prose(i % 40, 80)}</body></html>") for i in range(10, 200)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], PAGES).repartition(3)
    folder = warc.archive_folder(spark)
    written = warc.write_archives(pages, folder).collect()
    assert sum(r.records for r in written) == len(rows)
    got = warc.read_archives(spark, folder).collect()
    assert len(got) == len(rows)
    largest = {}
    for p, _, h in rows:
        if p is not None:
            largest[h or ""] = max(p, largest.get(h or "", p))
    texts = Counter((p, h or "") for p, _, h in rows)
    for r in got:
        data = next((h or "").encode() for p, _, h in rows if p == r.page_id)
        assert r.payload_bytes == len(data)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if r.page_id is None or largest[data.decode()] == r.page_id:
            assert r.record_type == "response" and r.refers_to is None and r.payload == data
        else:
            assert r.record_type == "revisit" and r.refers_to == largest[data.decode()] and r.payload == b""
    assert sum(texts.values()) == len(got)
    assert warc.read_archives(spark, folder, payloads=False).where("payload is not null").count() == 0


def test_warc_small_payloads_are_no_revisits(spark):
    pages = spark.createDataFrame([(i, "u", "ab") for i in range(3)] + [(i, "u", "long enough") for i in range(3, 6)], "page_id long, url string, html string")
    folder = warc.archive_folder(spark)
    warc.write_archives(pages, folder, min_payload=5).collect()
    kinds = {r.page_id: r.record_type for r in warc.read_archives(spark, folder).collect()}
    assert kinds == {0: "response", 1: "response", 2: "response", 3: "revisit", 4: "revisit", 5: "response"}


def test_warc_frames_stand_alone():
    records = [warc.record(i, "u", prose(i, 50).encode(), "D", None) for i in range(50)]
    data = b"".join(warc.archive(records))
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert [head["warc-record-id"] for head, _ in warc.records_of(data)] == [f"<urn:page:{i}>" for i in range(50)]


def removed_by_force(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        gone[-1] = False
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter((d, *x) for (d, *_), x in zip(rows, out, strict=True))


def shared_by_force(rows, size):
    """Bytes in windows of `size` that another row has too, for ids that are not repeated; where the lengths are equal, any other place counts."""
    texts = [(t or "").encode() for _, t, *_ in rows]
    holders = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - size + 1):
            holders.setdefault(t[i : i + size], []).append(k)
    out = {}
    for (d, *_), t, k in zip(rows, texts, range(len(rows)), strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            found = holders[t[i : i + size]]
            if len(set(found)) > 1 or (size < substrings.PASSAGE and len(found) > 1):
                gone[i : i + size] = True
        out[d] = int(gone.sum())
    return {d: n for d, n in out.items() if d not in (None, 5)}


@pytest.mark.parametrize("crowd,length,gram", [(256, 400, 32), (2, 400, 32), (3, 60, 8)])
def test_substrings(docs, nothing, monkeypatch, crowd, length, gram):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    got = substrings.remove_repeats(docs, length, gram).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removed_by_force(corpus(), length)
    assert {r.doc_id: r.n_shared for r in got if r.doc_id not in (None, 5)} == shared_by_force(corpus(), min(length, substrings.PASSAGE))
    if crowd == 2:
        assert substrings.remove_repeats(nothing).count() == 0


def test_decontaminate(spark, docs):
    item = prose(50, 40)
    words = item.split()
    near = words[:]
    for i in (5, 17, 29):
        near[i] = "zzz"
    rows = [(1, prose(7, 100) + " " + item.upper() + "! " + prose(8, 100)), (2, prose(9, 30) + " " + " ".join(near)), (3, prose(10, 200)), (4, None), (5, ""), (6, "very short item here now"), (7, " ".join(words[:12])), (None, item)]
    items = spark.createDataFrame([(100, item, "x"), (101, "short item here", "x"), (102, None, "x"), (103, "", "x"), (104, item, "x")], "item_id long, text string, doc_id string")
    frame = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id): r.n_equal for r in decontaminate.leaks(frame, items).collect()}
    assert got == {(1, 100): 40, (1, 104): 40, (2, 100): 37, (2, 104): 37, (6, 101): 3, (None, 100): 40, (None, 104): 40}
    assert {r.doc_id for r in decontaminate.clean(frame, items).collect()} == {3, 4, 5, 7, None}
    assert decontaminate.leaks(frame.limit(0), items).count() == 0
    assert decontaminate.leaks(frame, items.limit(0)).count() == 0


def test_decontaminate_slices_give_the_same(spark, monkeypatch):
    frame = spark.createDataFrame([(i, prose(i, 60)) for i in range(20)], "doc_id long, text string")
    items = frame.where("doc_id % 3 = 0").select(frame.doc_id.alias("item_id"), "text")
    want = {tuple(r) for r in decontaminate.leaks(frame, items).collect()}
    monkeypatch.setattr(decontaminate, "SLICE_SEEDS", 300)
    assert {tuple(r) for r in decontaminate.leaks(frame, items).collect()} == want
    assert {(r[0], r[1]) for r in want} >= {(i, i) for i in range(0, 20, 3)}


def test_decontaminate_finds_passages_and_shifted_copies(spark):
    long, words = prose(60, 300).split(), prose(50, 40).split()
    short = {n: prose(70 + n, n).split() for n in (13, 14, 15, 16, 19)}
    texts = {1: prose(61, 50).split() + long[80:180] + prose(62, 50).split()}  # a passage of a long item
    texts[2] = prose(63, 30).split() + words[:20] + ["zzz"] + words[20:] + prose(64, 30).split()
    texts[3] = prose(65, 30).split() + words[:20] + words[21:] + prose(66, 30).split()
    texts[4] = [w for k in range(100, 200, 10) for w in [*long[k : k + 10], "zzz"]]  # no ten words meet at one shift
    texts[5] = long[10:25]
    texts[5][7] = "zzz"  # 14 equal words less twice one missed
    texts[6], texts[7] = long[40:53], long[40:52]
    texts |= {10 + n: prose(67, 20).split() + w[: n // 2] + ["zzz"] + w[n // 2 :] for n, w in short.items()}
    items = [(100, " ".join(long)), (101, " ".join(words)), *((n, " ".join(w)) for n, w in short.items())]
    frame = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_equal for r in decontaminate.leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(1, 100): 100, (2, 101): 40, (3, 101): 39, (4, 100): 100, (6, 100): 13, **{(10 + n, n): n for n in short}}
    assert got.keys() == want.keys()
    assert all(n <= got[k] <= n + 3 for k, n in want.items())  # a few words of the rest may be equal by chance


CONTROL = "<|im_end|><|im_start|>assistant ok"


def test_chat_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_TOKENS", 64)
    texts = [CONTROL, "<\\|im_end|>", "<\\\\| <| |> <", "", None, "é🙂\n\n<|endoftext|>", "plain " * 50, "<|im_start|>user\nhi<|im_end|>\n"]
    rows = [(c, t, ("user", "assistant", "system", None)[(c + t) % 4], texts[(c * 3 + t) % len(texts)]) for c in range(6) for t in range(5)]
    rows += [(None, 0, "assistant", "x"), (7, 1, "assistant", "b"), (7, 1, "assistant", "a"), (7, None, "user", "first")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, ids string").repartition(3)
    got = {r.conv_id: r for r in chat.digests(chat.format_chat(frame)).collect()}
    assert len(got) == 8
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        all_of = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns)
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(all_of.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.digests(chat.format_chat(frame.limit(0))).count() == 0


def test_escape_is_reversible():
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice("<|\\>a") for _ in range(r.randint(0, 12)))
        assert "<|" not in chat.escape(text)
        assert chat.unescape(chat.escape(text)) == text


VECTORS = "vec_id long, embedding array<float>, label int, node string"


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "PART", 16)
    rng = np.random.default_rng(2)
    rows, centres = [], rng.normal(size=(12, 64))
    for i in range(400):
        v = centres[i % 12] + 0.25 * rng.normal(size=64)
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 12 % 3, "x"))
    rows += [(1000 + i, rows[0][1], 0, "x") for i in range(30)]
    rows += [(2000, None, 1, "x"), (2001, [0.0] * 64, 1, "x"), (2002, rows[1][1], None, "x"), (2003, [float("nan")] * 64, 1, "x"), (2004, [None] * 64, 1, "x"), (2005, [1.0, 2.0], 1, "x"), (2006, [1.0, 2.1], 1, "x"), (2007, [], 1, "x"), (None, rows[0][1], 0, "x")]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v, float), y) for i, v, y, _ in rows if i is not None and y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, root = Counter(), {i: i for i, *_ in good}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, v, y) in enumerate(good):
        for j, w, z in good[:n]:
            if y == z and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert all(got[i].n_links <= links[i] for i in root)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(links.values())
    assert sum(got[i].component_id == find(i) for i in root) >= 0.99 * len(root)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (2000, 2001, 2002, 2003, 2004, 2007))
    assert got[None].component_id is None and not got[None].kept
    assert embeddings.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_embedding_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    for dims in (3, 16, 64, 128):
        x = rng.normal(size=(1000, dims))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        g = rng.normal(size=x.shape)
        g -= (g * x).sum(1, keepdims=True) * x
        y = 0.931 * x + np.sqrt(1 - 0.931**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
        met = [np.intersect1d(a, b).size > 0 for a, b in zip(embeddings.decode(x), embeddings.decode(y), strict=True)]
        assert np.mean(met) >= 0.95


@pytest.mark.parametrize("dims", [64, 128, 384])
@pytest.mark.parametrize("shape", ["even", "padded", "half", "falling", "few"])
def test_embedding_recall_of_uneven_dimensions(dims, shape):
    at = np.arange(dims)
    scale = {"even": np.ones(dims), "padded": at < dims // 2, "half": np.where(at < dims // 2, 1, 0.05), "falling": 1 / (at + 1), "few": at < 8}[shape]
    rng = np.random.default_rng(6)
    x, z = (embeddings._unit(rng.normal(size=(300, dims)) * scale) for _ in range(2))
    z = embeddings._unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    found = [len(np.intersect1d(a, b)) > 0 for a, b in zip(embeddings.decode(x), embeddings.decode(0.931 * x + np.sqrt(1 - 0.931**2) * z), strict=True)]
    assert np.mean(found) >= 0.95


def test_embedding_decodes_every_direction_of_a_cap():
    x = embeddings._unit(np.random.default_rng(7).normal(size=(40, 64)))
    x[0] = embeddings.rotation(64) @ np.concatenate([c[0] for _, c in embeddings.codes(64)]) / np.sqrt(2)  # a filter's own direction
    turned = x @ embeddings.rotation(64)
    left, right = (turned[:, s] @ c.T / np.sqrt(2) for s, c in embeddings.codes(64))
    for k, got in enumerate(embeddings.decode(x)):
        want = np.flatnonzero((left[k][:, None] + right[k] >= embeddings.SIGMAS / 8).ravel())
        assert np.isin(want, got).all() and len(got) == max(len(want), embeddings.FEWEST)


def test_language(spark):
    r = random.Random(3)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "äöüßk"}
    rows = [(i, " ".join("".join(r.choice(letters[lang]) for _ in range(5)) for _ in range(r.choice([2, 20, 200]))), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 100)]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 !?", "bb"), (903, "äöüß 🙂", None), (None, "abc abd", "aa")]
    frame = spark.createDataFrame([(*x, "n") for x in rows], "doc_id long, text string, lang string, score string").repartition(3)
    got = {x.doc_id: x for x in langid.predict(frame, langid.train(frame)).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows[:300] if got[i].held_out]) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred == "cc" and got[None].held_out
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got if i is not None)
    assert all(0 <= x.score <= 1 for x in got.values())
    kept = langid.accepted(frame)
    assert kept.columns == frame.columns and {900, 901, 902}.isdisjoint({x.doc_id for x in kept.collect()})
    nothing = frame.limit(0)
    assert langid.predict(nothing, langid.train(nothing)).count() == 0
    assert {x.lang_pred for x in langid.predict(frame, langid.train(nothing)).collect()} == {"und"}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    out = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if holds(k, m[0])]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def test_pii(spark):
    r = random.Random(8)
    texts = [None, "", "🙂 a@b.co, x@y@z.com a@b.c_d@e.f.g", "1.2.3.4.5.6.7.8 256.1.1.1 007.08.9.10 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (319) 555-5132 +12 +1((((((2 +49 30 1234567", "call me: (319) 555-5132 or jo (at) mail dot com", "9" * 30000, "a" * 60000 + "@", "a." * 20000 + "x@" + "b." * 9000 + "c", "x@y.com " * 300]
    texts += ["".join(r.choice("0123456789 .-+@()aé🙂") for _ in range(r.randint(5, 80))) for _ in range(400)]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, candidates string, base string").repartition(3)
    got = {x.doc_id: x for x in pii.report(frame).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t or "")[:100]
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(w.startswith(k) for w in want) for k in BASE]
        assert set(want) <= set(filter(None, got[i].spans.split(",")))
    assert pii.report(frame.limit(0)).count() == 0


def test_pii_redacts(spark):
    frame = spark.createDataFrame([(1, "é mail a@b.co now", "k"), (2, None, "k"), (3, "clean", "k")], "doc_id long, text string, spans string")
    out = pii.redact(frame)
    assert out.columns == frame.columns
    assert {x.doc_id: x.text for x in out.collect()} == {1: "é mail [email] now", 2: None, 3: "clean"}


def test_pii_redacts_beside_clashing_columns_and_whole_overlaps(spark, monkeypatch):
    frame = spark.createDataFrame([(1, "k", "mail a@b.co now", "c", "t", 7)], "doc_id long, spans string, text string, candidates string, _text string, row int")
    out = pii.redact(frame)
    assert out.columns == frame.columns
    assert [tuple(r) for r in out.collect()] == [(1, "k", "mail [email] now", "c", "t", 7)]
    struct = "struct<start:int,rank:int,end:int,base:boolean,kind:string>"
    spans = F.expr(f"cast(array(struct(2, 0, 6, true, 'ip'), struct(4, 1, 9, true, 'card'), struct(5, 1, 7, true, 'card')) as array<{struct}>)")
    monkeypatch.setattr(pii, "fit", lambda found: {})
    monkeypatch.setattr(pii, "spans", lambda found, weights: found.withColumn("spans", spans))
    assert [r.text for r in pii.redact(spark.createDataFrame([("0123456789",)], "text string")).collect()] == ["01[ip]9"]


def test_pii_labelers_learn(spark):
    frame = spark.createDataFrame([(i, f"mail a{i}@b.com and 10.0.0.{i % 250} version 999.1.2.3") for i in range(200)], "doc_id long, text string")
    weights = pii.fit(pii.candidates(frame))
    assert weights["validity:+"] > weights["validity:-"]


def test_packing(spark, docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i, x) for i, x in enumerate([None, "", "a<|endoftext|>b", "　 x y", "🙂" * 50, " " * 3000, "x" * 20000, *(prose(i, 30 * i) for i in range(60))])]
    frame = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, shard int").repartition(3)
    got = packing.pack(frame).collect()
    by_doc = {}
    for p in got:
        by_doc.setdefault(p.doc_id, []).append(p)
    assert by_doc.keys() == {i for i, _ in rows}
    for i, x in rows:
        ids, at = [*t.encode(x or "", add_special_tokens=False).ids, 0], 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            piece = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(piece))
            at += p.length
        assert at == len(ids)
    sequences = {}
    for p in got:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack(nothing).count() == 0


def test_packing_ids_of_single_and_double_spaces():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(5)
    pieces = ["a", "B", "é", "中", "1", "٣", "'s", "'", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u3000", "\u200b", ".", "<|endoftext|>", "😀"]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 12))) for _ in range(5000)] + [None]
    got = [np.frombuffer(x, "<u2").tolist() for x in packing._ids(pa.array(texts))]
    assert got == [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def test_packing_puts_neighbours_together():
    terms = [np.array([1, 2]), np.array([3]), np.array([1, 2]), np.array([4])]
    rows = [(300, 10, x, np.ones(len(x), int)) for x in terms]
    order = packing._ordered(rows, np.ones(1 << packing.TERM_BITS), 10.0)
    assert order[:2] == [0, 2] and sorted(order) == [0, 1, 2, 3]


def test_packing_asks_with_all_terms():
    terms = [np.arange(60), np.arange(100, 160), np.arange(50, 110)]  # the last shares ten late terms with both
    terms.append(np.append(np.arange(200, 259), 59))  # and this one a single term with the first
    rows = [(300, 60, x, np.ones(60, int)) for x in terms]
    idf = np.linspace(2, 1, 1 << packing.TERM_BITS)
    assert packing._ordered(rows, idf, 60.0) == [0, 2, 3, 1]


def bm25_by_hand(rows, idf, mean, window=packing.WINDOW, k1=1.2, b=0.75):
    """The order of a shard with every score made anew from the counts of each document."""
    tf = [dict(zip(terms.tolist(), counts.tolist(), strict=True)) for _, _, terms, counts in rows]
    shared = {t for t in set().union(*tf) if sum(t in d for d in tf) > 1}
    score = lambda q, d: sum(idf[t] * tf[d][t] * (k1 + 1) / (tf[d][t] + k1 * (1 - b + b * rows[d][1] / mean)) for t in sorted(tf[q]) if t in shared and t in tf[d])
    left, order, filled = list(range(len(rows))), [], 0
    while left:
        seed = left.pop(0)
        order.append(seed)
        filled = (filled + rows[seed][0]) % window
        room = window - filled
        for s, d in sorted((-round(score(seed, d), 9), d) for d in left):
            if s == 0:
                break
            left.remove(d)
            order.append(d)
            filled = (filled + rows[d][0]) % window
            if rows[d][0] >= room:
                break
            room -= rows[d][0]
    return order


@pytest.mark.parametrize("seed", range(6))
def test_packing_order_is_that_of_bm25(seed):
    rng = np.random.default_rng(seed)
    idf = rng.uniform(0.5, 6, 200)
    rows = []
    for _ in range(120):
        terms = np.sort(rng.choice(200, rng.integers(0, 25), replace=False))
        rows.append((int(rng.integers(1, 700)), int(rng.integers(1, 60)), terms, rng.integers(1, 5, len(terms))))
    assert packing._ordered(rows, idf, 30.0) == bm25_by_hand(rows, idf, 30.0)


def test_packing_numbers_sequences_of_any_task():
    last = packing.MOST_TASKS - 1
    numbers = [s for task in (0, 1, 32_768, last) for index in (0, 1, (1 << packing.INDEX_BITS) - 1) for _, _, _, s, _ in packing._cut([3000, 5], task, index)]
    assert numbers == sorted(numbers) and len(set(numbers)) > 40 and 0 <= min(numbers) and max(numbers) < 1 << 63
    with pytest.raises(OverflowError):
        packing._numbered(packing.MOST_TASKS, 0, 0)


def test_packing_deals_a_common_term_by_the_next_one():
    df = np.full(1 << packing.TERM_BITS, 1_000_000)
    terms, bounds = np.array([5 << 14, 9 << 14, 7 << 14, 9 << 14, 5 << 14, 8 << 14], np.int64), np.array([0, 2, 2, 4, 6])
    df[9] = 4
    first, second = packing._rarest(terms, bounds, df)
    assert first.tolist() == [9 << 14, -1, 9 << 14, 5 << 14] and second.tolist() == [5 << 14, -1, 7 << 14, 8 << 14]
    shards = packing._shards([1, 2, 3, 4], first, second, df)
    assert shards[0] == shards[2] and shards[1] < 0 and len(set(shards.tolist())) == 3
    common = packing._shards(list(range(1000)), np.full(1000, 5 << 14), np.arange(1000) % 10 << 14, df)
    assert len(set(common.tolist())) == 10  # as many as there are next terms, however the ids run


def test_packing_ranks_by_score_then_position():
    scores = np.random.default_rng(3).integers(0, 40, 300).astype(float)
    assert list(packing._ranked(scores)) == sorted(np.flatnonzero(scores).tolist(), key=lambda i: (-scores[i], i))


def test_packing_documents_meet_at_their_rarest_shared_word(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 8)
    rows = [(2 * k + j, f"shared{k} {prose(k, 20)} only{k}x{j} once{j}y{k}") for k in range(64) for j in range(2)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # Documents of one task meet in one index.
    tasks = {p.doc_id: p.sequence_id >> packing.INDEX_BITS + packing.SEQUENCE_BITS for p in got}
    assert len(tasks) == 128 and len(set(tasks.values())) > 8
    assert np.mean([tasks[2 * k] == tasks[2 * k + 1] for k in range(64)]) > 0.95


def test_url_filter(spark):
    captures = spark.createDataFrame(
        [(1, "http://www.a.example.com/x/y?q", "2024-03-01"), (2, "https://example.com:80/", "2024-03-01"), (3, "http://u:p@b.org/ads/1", "2024-01-01"), (4, None, "2024-03-01"), (5, "junk", "2024-03-01"), (6, "http://example.com/", None), (7, "http://b.org/adsense", "2024-06-01"), (8, "http://b.org/ads", "2024-05-31"), (8, "http://b.org/ads", "2024-05-31"), (9, "http://notexample.com/", "2024-03-01"), (10, "http://example.com/", "2025-01-01")],
        "page_id long, url string, fetched string",
    )
    log = spark.createDataFrame(
        [("example.com", "2024-02-01", True, "spam"), ("example.com", "2024-04-01", False, None), ("a.example.com", "2024-03-01", True, "adult"), ("b.org/ads", "2023-01-01", True, "path"), ("b.org/ads", "2024-06-01", False, "path"), (None, "2024-01-01", True, "x"), ("c.org", None, True, "x")],
        "pattern string, since string, listed boolean, category string",
    )
    got = [(r.page_id, r.blocked, r.n_entries, r.category) for r in urlfilter.verdicts(captures, log).collect()]
    assert Counter(got) == Counter([(1, True, 2, "adult"), (2, True, 1, "spam"), (3, True, 1, "path"), (4, False, 0, None), (5, False, 0, None), (6, False, 0, None), (7, False, 0, None), (8, True, 1, "path"), (8, True, 1, "path"), (9, False, 0, None), (10, False, 0, None)])
    assert urlfilter.verdicts(captures, log.limit(0)).where("blocked").count() == 0
    assert urlfilter.verdicts(captures.limit(0), log).count() == 0


def test_url_filter_asks_to_any_depth(spark):
    deep, wide = "h.org/a/b/c/d/e/f", "a.b.c.d.e.f.g.h.example.com"
    captures = spark.createDataFrame([(1, f"http://{deep}/g"), (2, f"http://{deep}"), (3, "http://h.org/a/b/c/d/e"), (4, f"http://{wide}/x"), (5, f"http://z.{wide}/"), (6, "http://h.example.com/"), (7, "http://h.org/" + "a/" * 300)], "page_id long, url string").selectExpr("*", "'2024-03-01' as fetched")
    log = spark.createDataFrame([(p, "2024-01-01", True, "x") for p in (deep, wide, "b.c.d.e.f.g.h.example.com", "h.org" + "/a" * 299)], "pattern string, since string, listed boolean, category string")
    got = {r.page_id: (r.n_entries, r.pattern) for r in urlfilter.verdicts(captures, log).collect()}
    assert got == {1: (1, deep), 2: (1, deep), 3: (0, None), 4: (2, wide), 5: (2, wide), 6: (0, None), 7: (1, "h.org" + "/a" * 299)}


@pytest.mark.parametrize("n,equal", [(8, 8), (10, 8), (12, 8), (13, 8), (20, 12), (40, 24)])
def test_decontamination_finds_pairs_at_its_threshold(spark, n, equal):
    """Items of n words of which a copy keeps as few as a leak must: at least nine of ten are found."""
    r = random.Random(n)
    items, docs = [], []
    for i in range(150):
        words = prose(1000 * n + i, n).split()
        items.append((i, " ".join(words)))
        for at in r.sample(range(n), n - equal):
            words[at] = f"other{i}x{at}"
        docs.append((i, " ".join([*prose(i, 30).split(), *words, *prose(i + 500, 30).split()])))
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sum(x.doc_id == x.item_id for x in found) >= 135
    assert sum(x.doc_id != x.item_id for x in found) <= 3


def test_embedding_rows_of_one_id_are_nodes_of_their_own(spark):
    rng = np.random.default_rng(4)
    a, b, c = embeddings._unit(rng.normal(size=(3, 32)))
    near = embeddings._unit((a + 0.1 * c)[None, :])[0]
    frame = spark.createDataFrame([(1, a.tolist(), "x"), (1, b.tolist(), "x"), (2, near.tolist(), "x"), (3, b.tolist(), "x")], "vec_id long, embedding array<double>, label string")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(frame).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
