"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svlattice.llm import bpe, encode, packing, spam
from svlattice.session import spread, table


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.token_ids(spread(table(spark, folder, "documents", "doc_id", "text")), "doc_id", "text", bpe.vocabulary_path())


def p6_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_tokens, same: whether the streaming decode of the ids is the text."""
    docs = spread(table(spark, folder, "documents", "doc_id", "text"))
    vocabulary = bpe.vocabulary_path()
    ids = encode.token_ids(docs, "doc_id", "text", vocabulary)
    back = encode.decoded(ids, "doc_id", "ids", vocabulary).withColumnRenamed("text", "back")
    sizes = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"))
    return docs.join(back, "doc_id").join(sizes, "doc_id").select("doc_id", "n_tokens", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = encode.token_counts(spread(table(spark, folder, "documents", "doc_id", "text")), "doc_id", "text", bpe.vocabulary_path())
    return packing.packed(sizes, "doc_id", "n_tokens")


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(p7_containers(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.spam_pages(spread(table(spark, folder, "documents", "doc_id", "text")), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p6_ids, p6_roundtrip, p7_containers, p7_fill, p8_found)}
ORACLES: dict[str, str] = {}
