"""The corpus pipeline: quality rules, near copies, benchmark passages, secrets, encoding.

Each stage takes the documents that its predecessor kept, as reread from Parquet, and all but the last return the columns
of documents, further ones included, whatever their names.

Defined results: an empty table gives an empty table in every stage, and texts of any length are read whole. A null text has
no words, so that the first stage rejects it; the others keep a null or empty text as it is, and the last gives null or no
ids. Keys may be null or repeated: rows are judged by their own texts. Equal rows are one group of the second stage, which
keeps the row with the least key, then the least hash of the text; elsewhere repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm._common import materialize
from weftgraph.llm.decontaminate import drop_contaminated
from weftgraph.llm.ngram_join import drop_near_copies
from weftgraph.llm.piece_codec import encode_digest
from weftgraph.llm.quality_rules import filter_quality
from weftgraph.llm.secret_scan import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that fail them."""
    return filter_quality(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least doc_id."""
    return drop_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets redacted."""
    return redact_secrets(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents."""
    return encode_digest(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminated),
    ("secret scans", secrets),
    ("SentencePiece encoding and decoding", encoded),
]

#: SQL can't express the components of the join or the encoding; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
