"""Lexical retrieval packing: BM25 neighbours fill the window that a seed document opens.

Terms are 32-bit hashes of words; document frequencies come from all documents, counted in slots of
several terms. Each document is tokenised once and keeps all its distinct terms; the rarest that
another document seems to have too decides its shard, so that documents whose rarest shared word is
the same meet. Where a term's slot is too common for one shard, the next rarest deals its documents over several,
so those that share both still meet. In a shard an inverted index of all terms scores the unused documents against all terms of each seed
by BM25; the best follow it until the window is full. A shard is split where its ids and terms
reach SHARD_BYTES. Where a document does not fit it is cut, and
its rest opens the next window. The last window of a shard is cut into powers of two, which need
no padding.

A sequence's number is its task, index and place in 20, 21 and 22 bits: tasks are at most MOST_TASKS, whatever the
number of documents, and a number that would not fit is an error. Documents of equal BM25 scores follow in the order of their place in the shard.

Edge cases: a null or empty text is the separator id alone; a very long text is cut over as many
windows as it fills, and its index holds it alone beside what came before it; a null doc_id is kept as a document
of its own, as is every repeated row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import bounded, in_arrow

WINDOW = 1024
SEPARATOR = 0
TERM_BITS = 18
SHARD_DOCS = 2500
MOST_TASKS = 1 << 20
INDEX_BITS, SEQUENCE_BITS = 21, 22
SHARD_BYTES = 1 << 26
K1, B = 1.2, 0.75
FIRST_RANKS = 32
TOKENIZER = "byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's own pattern, its runs possessive, so that they match the same and are not tried again.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
# The same for texts in which no two spaces meet: nothing looks ahead, so that the matcher never backtracks.
SINGLE_SPACED = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"""
TWO_SPACES = r"[\s\x0b\x{85}\p{Z}]{2}"


@cache
def _ranks(name: str) -> dict[bytes, int]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as lines:
        return {base64.b64decode(k): int(v) for k, v in map(bytes.split, lines)}


@cache
def encoder(name: str = TOKENIZER, pattern: str = PATTERN):
    """The public byte-level vocabulary through tiktoken, whose ids equal those of its tokenizers file."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=_ranks(name), special_tokens={"<|endoftext|>": 50256})


def _terms(words: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each row and their counts, with the bounds of the rows."""
    both, counts = np.unique((row.astype(np.uint64) << tk.U(32)) | (words >> tk.U(32)), return_counts=True)
    return (both & tk.U(0xFFFFFFFF)).astype(np.int64), counts, np.searchsorted(both, np.arange(rows + 1).astype(np.uint64) << tk.U(32))


def _slots(terms: np.ndarray) -> np.ndarray:
    return terms >> (32 - TERM_BITS)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of one partition; term -1 counts documents and -2 words."""
    df, n, total = np.zeros(1 << TERM_BITS, np.int64), 0, 0
    for batch in batches:
        for a, b, data, offsets in tk.chunks(batch.column(0)):
            words, row = tk.word_hashes(data, offsets)
            np.add.at(df, _slots(_terms(words, row, b - a)[0]), 1)
            n, total = n + b - a, total + len(words)
    used = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((used, [-1, -2])).astype(np.int32)), pa.array(np.concatenate((df[used], [n, total])))], ["term", "n"])


def _ids(texts: pa.Array) -> list[bytes]:
    """The ids of each text as bytes, two an id, the separator last."""
    two_spaces = pc.match_substring_regex(texts, TWO_SPACES).to_pylist()
    encoders = (encoder(pattern=PATTERN if two else SINGLE_SPACED) for two in two_spaces)
    encoded = (e.encode_to_numpy(t or "", allowed_special="all") for e, t in zip(encoders, texts.to_pylist(), strict=True))
    return [np.append(ids, SEPARATOR).astype("<u2").tobytes() for ids in encoded]


def _ordered(docs: list[tuple], idf: np.ndarray, mean_words: float) -> list[int]:
    """The order of a shard: each seed, then its best unused neighbours until its window is full.

    docs: (tokens, words, terms, tf) by position; idf: by term.
    """
    n = len(docs)
    lengths = np.array([d[0] for d in docs])
    norm = K1 * (1 - B + B * np.array([d[1] for d in docs]) / max(mean_words, 1e-9))
    sizes = [len(d[2]) for d in docs]
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    term = np.concatenate([d[2] for d in docs]).astype(np.int32) if n else np.zeros(0, np.int32)
    tf = np.concatenate([d[3] for d in docs]) if n else np.zeros(0)
    # A term of one document in the shard scores no other.
    keep = np.bincount(term, minlength=len(idf))[term] > 1
    asked = np.split(term[keep], np.cumsum(np.bincount(owner[keep], minlength=n))[:-1])
    owner, term, tf = owner[keep], term[keep], tf[keep]
    weight = idf[term] * tf * (K1 + 1) / (tf + norm[owner])
    by_term = np.argsort(term, kind="stable")
    owner, weight, term = owner[by_term], weight[by_term], term[by_term]
    bounds = _bounds(term, len(idf))
    free, order, filled, seed, live = np.ones(n, bool), [], 0, 0, n
    while len(order) < n:
        while not free[seed]:
            seed += 1
        filled = (filled + lengths[seed]) % WINDOW
        free[seed] = False
        order.append(seed)
        if 2 * (n - len(order)) < live:
            # Half of the indexed documents are used: their postings go.
            keep, live = free[owner], n - len(order)
            owner, weight, term = owner[keep], weight[keep], term[keep]
            bounds = _bounds(term, len(idf))
        starts = bounds[asked[seed]]
        sizes = bounds[asked[seed] + 1] - starts
        total = int(sizes.sum())
        if not total:
            continue
        postings = np.arange(total) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        scores = np.bincount(owner[postings], weight[postings], minlength=n) * free
        room = WINDOW - filled
        for i in _ranked(scores):
            free[i] = False
            order.append(i)
            filled = (filled + lengths[i]) % WINDOW
            if lengths[i] >= room:
                break
            room -= lengths[i]
    return order


def _bounds(term: np.ndarray, terms: int) -> np.ndarray:
    """Where the postings of each term begin and end, in order of terms."""
    return np.concatenate(([0], np.cumsum(np.bincount(term, minlength=terms))))


def _rarest(terms: np.ndarray, bounds: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rarest term of each row that another document seems to have too (else the rarest), and the next one; -1 for none."""
    first, second = np.full(len(bounds) - 1, -1), np.full(len(bounds) - 1, -1)
    filled = np.flatnonzero(np.diff(bounds))
    if len(filled):
        none = np.iinfo(np.int64).max
        n = np.minimum(df[_slots(terms)], (1 << 29) - 1)
        key = ((n < 2).astype(np.int64) << 61) + (n << 32) + terms
        best = np.minimum.reduceat(key, bounds[filled])
        first[filled] = best & 0xFFFFFFFF
        key[key == np.repeat(best, np.diff(bounds)[filled])] = none
        best = np.minimum.reduceat(key, bounds[filled])
        second[filled] = np.where(best == none, -1, best & 0xFFFFFFFF)
    return first, second


def _shards(docs: list[int | None], first: np.ndarray, second: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The shard of each document: its rarest term, and where that is common a part that its next one decides."""
    part = np.array([zlib.crc32(str(d).encode()) for d in docs], np.int64) & 0x3FFFFFFF  # for want of terms
    parts = 1 + df[_slots(np.maximum(first, 0))] * 2 // SHARD_DOCS
    dealt = (np.maximum(second, 0) * 0x9E3779B1 & 0x3FFFFFFF) % parts
    return np.where(first < 0, -1 - part, (first << 30) + dealt)


def _numbered(task: int, index: int, sequence: int) -> int:
    """One number for a sequence of an index of a task."""
    if task >= MOST_TASKS or index >= 1 << INDEX_BITS or sequence >= 1 << SEQUENCE_BITS:
        raise OverflowError(f"sequence {sequence} of index {index} in task {task} has no number")
    return ((task << INDEX_BITS) + index << SEQUENCE_BITS) + sequence


def _ranked(scores: np.ndarray) -> Iterator[int]:
    """Positions of positive scores, the highest first; most windows need few, so only the top is sorted at once."""
    some = np.flatnonzero(scores > 0)
    least = np.partition(scores[some], -FIRST_RANKS)[-FIRST_RANKS] if len(some) > FIRST_RANKS else 0
    top = scores[some] >= least
    for part in (some[top], some[~top]):
        yield from part[np.lexsort((part, -scores[part]))].tolist()


def _cut(tokens: list[int], task: int, index: int = 0) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents laid end to end."""
    total, sequence, base = sum(tokens), 0, 0
    rest = total % WINDOW
    limits = [WINDOW] * (total // WINDOW) + [1 << b for b in reversed(range(WINDOW.bit_length() - 1)) if rest >> b & 1]
    for i, n in enumerate(tokens):
        start = 0
        while start < n:
            size = min(n - start, limits[sequence] - base)
            yield i, start, size, _numbered(task, index, sequence), base
            start, base = start + size, base + size
            if base == limits[sequence]:
                sequence, base = sequence + 1, 0


def pack(docs: DataFrame) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids."""
    spark = bounded(docs).sparkSession
    # At most 2^TERM_BITS rows reach the driver and return as two arrays of that size, however large the corpus.
    counts = docs.select("text").transform(in_arrow, _frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = counts["term"].to_numpy(), counts["n"].to_numpy()
    n_docs, n_words = (int(n[term == k].sum()) for k in (-1, -2))
    df = np.zeros(1 << TERM_BITS, np.int64)
    df[term[term >= 0]] = n[term >= 0]
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    stats = spark.sparkContext.broadcast((idf, df, n_words / max(n_docs, 1)))
    shards = min(MOST_TASKS, max(1, -(-n_docs // SHARD_DOCS)))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, df, _ = stats.value
        for batch in batches:
            for a, b, data, offsets in tk.chunks(batch.column(1)):
                rows = b - a
                words, row = tk.word_hashes(data, offsets)
                terms, tf, bounds = _terms(words, row, rows)
                docs, texts = batch.column(0).slice(a, rows), batch.column(1).slice(a, rows)
                shard = _shards(docs.to_pylist(), *_rarest(terms, bounds, df), df)
                postings = np.stack((terms, tf), axis=1).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        docs,
                        pa.array(_ids(texts), pa.binary()),
                        pa.array(np.bincount(row, minlength=rows).astype(np.int32)),
                        pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((8 * bounds).astype(np.int32)), pa.py_buffer(postings)]),
                        pa.array(shard, pa.int64()),
                    ],
                    ["doc_id", "ids", "n_words", "postings", "shard"],
                )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, index, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for doc, ids, n, postings in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                terms, tf = np.frombuffer(postings, "<u4").reshape(-1, 2).T
                held.append((doc, ids, n, terms, tf))
                size += len(ids) + 8 * len(held[-1][3])
                if len(held) == 2 * SHARD_DOCS or size >= SHARD_BYTES:
                    yield from filled(held, task, index)
                    held, index, size = [], index + 1, 0
        yield from filled(held, task, index)

    def filled(held: list[tuple], task: int, index: int) -> Iterator[pa.RecordBatch]:
        idf, _, mean = stats.value
        # The terms of this index, numbered from 0.
        every, local = np.unique(np.concatenate([h[3] for h in held]) if held else np.zeros(0, np.uint32), return_inverse=True)
        own = np.split(local, np.cumsum([len(h[3]) for h in held])[:-1]) if held else []
        order = _ordered([(len(h[1]) // 2, h[2], terms, h[4].astype(np.int32)) for h, terms in zip(held, own, strict=True)], idf[_slots(every.astype(np.int64))], mean)
        rows = []
        for i, start, size, sequence, offset in _cut([len(held[i][1]) // 2 for i in order], task, index):
            doc, ids = held[order[i]][:2]
            piece = ids[2 * start : 2 * (start + size)]
            rows.append((doc, start, size, zlib.crc32(np.frombuffer(piece, "<u2").astype("<u4").tobytes()), len(ids) // 2, sequence, offset, piece))
            if len(rows) == 4096:
                yield pieces(rows)
                rows = []
        yield pieces(rows)

    def pieces(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.binary() if c == 7 else pa.int64()) for c in range(8)], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    return (
        docs.select(F.col("doc_id").cast("long"), "text")
        .transform(in_arrow, featured, "doc_id long, ids binary, n_words int, postings binary, shard long")
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", "doc_id", "ids")
        .drop("shard")
        .transform(in_arrow, packed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    )
