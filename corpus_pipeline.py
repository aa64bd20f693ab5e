"""A corpus from raw documents to tokens, in stages that are each written and read again.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelattice.llm import byte_bpe, decontamination, simhash, toxicity
from carelattice.llm.exact_dedup import exact_duplicates
from carelattice.llm.registry import table
from carelattice.session import bound_batches, cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_bounded_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return bounded


@_in_bounded_batches
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labelled ones of `docs`."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


@_in_bounded_batches
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays, and once where it is repeated.

    Rows of one id with different texts are judged each; rows without an id stay. A null text is an empty one.
    """
    found = cut_lineage(exact_duplicates(docs), "exact-copies")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    gone = found.filter("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("text_sha256").alias("_gone_text")).distinct()
    kept = docs.join(gone, (docs["doc_id"] == gone["_gone_id"]) & (digest == gone["_gone_text"]), "left_anti")
    repeated = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


@_in_bounded_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their SimHash, or alike in 0.8 of their five-word shingles, the one
    with the smallest id stays."""
    found = simhash.similar_documents(docs)
    return docs.join(
        found.filter("doc_id != component_id").select("doc_id"), "doc_id", "left_anti"
    ).select(*docs.columns)


@_in_bounded_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_in_bounded_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids: the tokens of every document left; decoding them gives its text."""
    encoded = byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", decontaminate),
    ("byte_bpe", encode),
]

#: A learned score, a fingerprint and a tokenizer are no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the result is that of the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
