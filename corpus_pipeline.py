"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before has kept.  The first three
remove whole documents and change no row.  The mix cuts documents into the pieces that its blocks hold: a row of its
result is one piece, with the doc_id, lang and source of its document, so a document occurs as often as the mix takes
it.  The last stage adds size, shard and slot to the pieces.

A null text counts as empty: it scores like a text without words, has fingerprint zero (so one of all documents without
words stays), holds no benchmark window, and has no words for the mix to take.  Rows that repeat id and text are near
copies of each other.  Null ids and sources are kept apart as values of their own.  An empty table passes every stage.
Other columns than those of documents travel unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import table
from eventlens.llm.decontaminate import drop_contaminated
from eventlens.llm.mixing import mix_documents
from eventlens.llm.sharding import shard_documents
from eventlens.llm.simhash import keep_representatives
from eventlens.llm.toxicity import drop_toxic
from eventlens.session import materialise


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the threshold; the model learns from the labels of the documents at hand."""
    return drop_toxic(docs, docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of smallest doc_id."""
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark occurs."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces that the mix takes, in the columns of documents."""
    return mix_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces with their shard and slot."""
    return shard_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: A trained model and connected components of fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
