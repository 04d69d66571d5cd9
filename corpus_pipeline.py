"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of docs, whatever others than those of documents these are; an empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from tessella.llm.common import table, written

#: Words of a shingle and least Jaccard similarity of near copies; op7's own settings bind only op7.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold. The model learns from
    all labelled rows of docs that are not held out. Null and empty texts have the
    score of a text without features, below the threshold unless most labels are
    toxic; a null doc_id is never learned from; repeated rows share their fate."""
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs, model, "__toxicity").filter(F.col("__toxicity") < toxicity.THRESHOLD).drop("__toxicity")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the longest, then the smallest doc_id
    (null last). Null, empty and blank texts are equal to each other; of rows that
    repeat the winner's doc_id and length, one stays."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id (null last), of each component of
    similar documents. Rows under one doc_id are documents of their own; texts
    without words, null ones too, are similar to nothing and stay."""
    return jaccard_join.without_near_copies(docs, NEAR_WORDS, NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, in training order: files and
    rows in them stand in it. Null texts and texts without words go; a null source is
    a source of its own; rows that repeat doc_id, text and source each stand for
    their own."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their sequence and place, packed range by
    range of the training order. A null or empty text is the end id alone."""
    return packing.pack_in_order(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages run models, signatures and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
