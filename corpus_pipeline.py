"""The corpus pipeline: documents in, token ids out.

Stages, in order; each gets what the one before kept, and all but the last return the columns of documents:

1. quality     documents go that a language model of trusted text finds unlikely for their language (or that repeat)
2. near_dedup  one document of each group of near copies stays (SimHash links held against the exact Jaccard of five-word
               shingles, 0.8 or more; an exact join adds the links that fingerprints miss)
3. mixing      sources to their target weights: a document is left out, taken once or taken twice
4. encode      SentencePiece ids

A null text counts as empty, a null language as '', null sources as one source. Labels of documents that are gone, empty
tables and extra columns are fine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataflow.llm.common import bounded_batches, materialize, table
from strataflow.llm.mixing import mix_documents
from strataflow.llm.near import drop_near_copies
from strataflow.llm.pieces import encode_documents
from strataflow.llm.quality import keep_good
from strataflow.llm.queries import tokenizer_file
from strataflow.session import ship

#: The language model, the cube method and the encoder have no SQL form; the tests hold stages against brute force.
ORACLE_SQL = None


def _prepared(spark: SparkSession) -> None:
    ship(spark)
    bounded_batches(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier keeps. The trusted text is that of the labelled documents among docs."""
    _prepared(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    Links come from SimHash (op8's fingerprints and links) and from an exact join of what those leave apart.
    """
    _prepared(spark)
    return drop_near_copies(docs, shingle=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    _prepared(spark)
    return mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, n_chunks, n_tokens, ids, round_trip of every row."""
    _prepared(spark)
    return encode_documents(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
