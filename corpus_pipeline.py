"""A corpus from raw documents to packed training sequences, stage by stage.

Each stage takes all rows that its predecessor returned, as Parquet in the shared folder,
so a lost executor costs a part of one stage. All but the last return the columns of
``documents``; the last returns the pieces of the packed sequences.

In all stages: columns beside doc_id, text and source pass through, whatever their names;
an empty table gives an empty one; texts are taken whole, however long; no stage depends on
the order of rows, so ties change nothing but which of two equal rows is meant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nimbora.llm.minhash import Near, keep_one
from nimbora.llm.mixing import mixed
from nimbora.llm.packing import pack_documents
from nimbora.llm.quality_rules import keep_clean
from nimbora.llm.secret_scan import redact
from nimbora.llm.store import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go; boilerplate lines go from those that stay.

    Null and empty texts have no words and go; a null source is a source; repeated rows stay or go together."""
    return keep_clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, Jaccard 0.8).

    Of rows with one doc_id one stays; null and empty texts and rows without a doc_id all stay."""
    return keep_one(docs, Near(shingle=5))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, also encoded ones, are replaced by a mark; every document stays, also null and empty
    ones; repeated rows give repeated rows."""
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are replicated to their sources' target weights, in a global random order. A null
    source is a source; rows that repeat a doc_id get as many copies each."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy's tokens, in pieces that fill sequences of 2048. A null or empty text is its end id."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("mix_sources", mix_sources),
    ("packing", packing),
]

#: Near-duplicate components, decoding and tokenising are beyond SQL: tests hold a brute-force version against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store.save(name, docs)
            if i:
                store.drop(STAGES[i - 1][0])  # nothing reads it any more
    return docs
