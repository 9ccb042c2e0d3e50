"""The pipeline stage by stage over the small tables, each against a plain version of its decision."""

import re

import corpus_pipeline
from fablespark.llm import decontaminate, jaccard

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept, texts = {}, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        rows = docs.collect()
        kept[name], texts[name] = {r.doc_id for r in rows}, {r.doc_id: r.text for r in rows}
        docs = spark.createDataFrame(rows, docs.schema)
    first = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert kept["language"] == {r.doc_id for r in first if r.text and re.search(r"[^\W\d_]", r.text)}
    sets = {d: frozenset(zip(*[t.lower().split()[i:] for i in range(5)])) or frozenset([tuple(t.lower().split())]) for d, t in texts["language"].items()}
    ids = sorted(sets)
    linked = {b: a for i, a in enumerate(ids) for b in ids[i + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert kept["near_duplicates"] == set(ids) - set(linked)
    assert kept["decontaminated"] <= kept["near_duplicates"]
    assert not any(re.search(r"[\w.]+@\w+\.\w+", t) for t in texts["personal_data"].values())
    assert kept["personal_data"] == kept["decontaminated"]
    assert all(r.n_chars == len(r.text) for r in rows)
    packed = corpus_pipeline.packed(spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == kept["personal_data"]


def test_operators_are_those_of_the_library():
    assert corpus_pipeline.jaccard is jaccard and corpus_pipeline.decontaminate is decontaminate


def test_stages_on_edge_tables(spark):
    """Nulls, repeats, empty and clashing columns pass through every stage; an empty table gives no rows."""
    from pyspark.sql import functions as F

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    clash = ["node", "d1", "cells", "spans", "candidates", "_text", "_leaked", "_gone", "_pred", "_score", "gone", "item_id", "terms"]
    a, b = "the house and the garden are here now " * 4, "a mail to x@y.org was sent to us all today " * 4
    rows = [(1, a, "en", "s", 5), (1, b, "en", "s", 5), (2, a, None, None, None), (None, a, "en", "s", 5), (3, "", "en", "s", 0), (4, None, "en", "s", 0), (5, b, "en", "s", 5), (6, "äöü 🙂 " + a, "en", "s", 5)]
    full = spark.createDataFrame(rows, schema).select("*", *[F.lit(c).alias(c) for c in clash])
    for table in (full, full.limit(0)):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == full.columns, name
            alone = stage(spark, table, SF).collect()
            assert len(alone) <= table.count() and all(r[c] == c for r in alone for c in clash), name
            rows = out.collect()
            docs = spark.createDataFrame(rows, full.schema)
        pieces = corpus_pipeline.packed(spark, docs, SF).collect()
        assert {p.doc_id for p in pieces} == {r.doc_id for r in rows}
        if table is full:
            assert {r.doc_id for r in rows} == {None, 1} and not any("@" in r.text for r in rows)
