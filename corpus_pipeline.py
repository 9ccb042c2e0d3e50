"""The corpus pipeline: five stages, each a table of documents in, a table out.

Every stage works on all that the one before it kept. Documents whose language is not told go;
of near copies (five-word shingles, Jaccard 0.8) the smallest doc_id stays; documents that leak a
benchmark item go; personal data is replaced by its kind in brackets; what is left is packed.

Edge cases, for every stage: a null or empty text has no language, so the first stage drops it; later
stages alone would keep it, and pack it as its separator. A row with a null doc_id is judged by its
language and freed of personal data, but no id names it as a copy or a leak, so it stays. Of near
copies with one doc_id all rows stay if it is the smallest of its group. Other columns, whatever
their names, are handed on unchanged by all stages but the last. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fablespark.llm import decontaminate, jaccard, langid, packing, pii
from fablespark.llm.common import staged, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: keeps documents of a language told with enough confidence."""
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: keeps one document of each group of near copies."""
    return jaccard.one_of_each(docs, k=5, num=80, den=100)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: drops documents that leak a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: replaces personal data; n_chars follows the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: packs the documents into windows."""
    return packing.pack(docs).drop("ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("personal_data", personal_data),
    ("packed", packed),
]

#: Trained models, sets of shingles and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
