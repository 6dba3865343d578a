"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

toxicity -> exact dedup -> MinHash near-dedup -> mixing -> byte-level BPE.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import bpe, exact_dedup, mixing, near_dedup, tables, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled documents, calls toxic go."""
    model = toxicity.train(tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays (five words, similarity 0.8)."""
    return near_dedup.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the sources' Pfair schedule: the files follow each other in that order."""
    return mixing.ordered(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, as digests, the digest of what they decode to, and its position in the mixture.

    Spark reads files in an order of its own. The position depends on the
    rows alone, so it is worked out here from the same rows, by the same
    schedule, as the order in which ``mix`` wrote them.
    """
    crc = F.crc32(F.encode(tables.whole_text(), "UTF-8"))
    digests = bpe.digest(docs.withColumn("_crc32", crc), bpe.default_vocabulary(), carry=("source", "_crc32"))
    columns = ("n_tokens", "ids_sha256", "decoded_sha256")
    return mixing.mixed(tables.persist_cut(digests), carry=columns, crc=F.col("_crc32")).select("doc_id", *columns, "position")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact), ("MinHash near-dedup", drop_near), ("mixing", mix), ("BPE", tokenize)]

#: The classifier, the join and the encoder are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; between stages the rows are written to the warehouse, which all executors share."""
    docs = tables.table(spark, sf_dir, "documents")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_pipeline/{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
