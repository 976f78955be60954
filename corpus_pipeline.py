"""The corpus pipeline: toxic documents go, near copies go, personal data is masked, sources are mixed, and what stays is encoded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriref.llm import bpe, mixing, pii, simhash, toxicity
from veriref.llm.common import cut_to_table, small_batches, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10, trained on the labelled documents of the folder. Documents that it rejects go; with fewer labels of either kind than `toxicity.Settings.least` none does. Null and empty texts are scored like any other."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9, by its search for a likeness of 0.8 over 5-word shingles. Of each group of near copies the document of the least id stays; texts without words are copies of one another."""
    return simhash.drop_near_copies(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7. Personal data and the terms that reveal it are replaced in the texts; a null text stays null. Every row stays."""
    return pii.sanitise(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2. Documents are drawn by calibrated probabilities; rows of equal id are drawn or not together."""
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4. Token ids with the digests of the ids and of the bytes that they decode to; a null text has no tokens."""
    small_batches(spark)
    out = docs.select("doc_id", "lang", "source", bpe.coded(F.col("text")).alias("tokens"))
    ids = F.col("tokens.ids")
    return out.select("doc_id", "lang", "source", F.size(ids).cast("long").alias("n_tokens"), ids.alias("ids"), F.sha2("tokens.decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [("toxicity", toxic), ("near_copies", near_copies), ("pii", private), ("mixing", mixing_sources), ("tokens", tokens)]
#: No SQL: a trained model decides the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_to_table(stage(spark, docs, sf_dir), name)
    return docs
