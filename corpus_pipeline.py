"""A training corpus from ``documents``: toxic texts go, one text of each near-duplicate group stays, personal data is
masked, sources are mixed to their weights and the mix is packed into sequences.

Each stage takes (spark, docs, sf_dir) and gets all rows that its predecessor kept; all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatialfactor.llm import mixing, near_dedup, packing, pii, toxicity
from spatialfactor.llm.common import table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't score as toxic; the model learns from the labels outside the held-out third.

    Rows with a null or empty text stay, repeated rows are judged alike, and without labels of both kinds all rows stay.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; sets of five-word shingles, similarity 0.8 or more.

    An id with several rows goes only if none of them is kept; rows without id, and rows with a null or empty text, stay.
    Texts of any length are compared whole; an empty table stays empty.
    """
    found = near_dedup.near_duplicates(docs, width=5, percent=80)
    gone = found.groupBy("doc_id").agg(F.bool_or("kept").alias("stays")).where("NOT stays").select("doc_id")
    return near_dedup.without(docs, written(gone, "near-duplicates"), "doc_id")


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by marks; n_chars follows.

    Rows with a null or empty text, repeated rows and rows without id stay as they are; whole texts of any length are read.
    """
    return pii.redact_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them: a row for each copy, none where it takes none.

    A row number, settled by being written, leads from the mix's narrow rows back to the documents, so rows without id or
    with an id of several rows need no key of their own. Rows with a null or empty text have no words and go; an empty
    table stays empty.
    """
    keyed = written(docs.withColumn("mix_row", F.monotonically_increasing_id()), "mixing-rows")
    taken = mixing.mix_sources(keyed, row_column="mix_row").where("taken > 0")
    copies = taken.select("mix_row", (F.col("taken") / F.col("size")).cast("int").alias("copies"))
    return keyed.join(copies, "mix_row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 2048 tokens; a null or empty text is one piece."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the stages' models; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
