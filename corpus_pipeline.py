"""The corpus pipeline: toxic documents go, near-duplicates go, sources are mixed to target weights, the rest is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busloom.llm import bytepair, common, jaccard, mixing, toxicity


NAMED = ("doc_id", "text", "source")


def plainly(docs: DataFrame) -> DataFrame:
    """docs with every column that a stage doesn't read numbered, so that no name, whatever it holds, meets a stage's own."""
    return docs.toDF(*[c if c in NAMED else f"c{i}" for i, c in enumerate(docs.columns)])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the factorization machine, fitted on the labelled ones among them, scores below 1/2.

    Null and empty texts have no terms and stay. Without labels, and of an empty table, all rows stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    plain = plainly(docs)
    return toxicity.scored(plain, toxicity.learnt(plain, labels), out="toxicity").where(F.col("toxicity") < 0.5).drop("toxicity").toDF(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that links of five-word shingles at a Jaccard similarity of 0.8 and more make: the one of least doc_id.

    Null, empty and blank texts have no shingles and stay.
    """
    return jaccard.deduplicated(plainly(docs)).toDF(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents, so that sources have their target shares in expectation, in globally shuffled order.

    Null sources are one source. An empty table stays empty.
    """
    plain = plainly(docs)
    return mixing.mixed(plain).sortWithinPartitions("position").select(plain.columns).toDF(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each copy the byte-level BPE ids, their number and digest, and the digest of what they decode to. Null texts are empty."""
    import public_tokenizers

    return bytepair.digests(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [("toxicity", without_toxic), ("near duplicates", without_near_duplicates), ("mixing", mixed), ("encoding", encoded)]

#: SQL can neither fit the machine of the first stage nor encode.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's result is written in the shared folder and read again."""
    folder = common.workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = common.staged(stage(spark, docs, sf_dir), f"stage-{k}", folder)
    return docs
