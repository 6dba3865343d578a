"""Sharding by proportional stratified interleaving (native).

Within each source rows are shuffled by a seeded hash and ranked; a row's
fractional rank is (2 * rank - 1) / (2 * size of its source). Sorting all
rows by fractional rank interleaves the sources in proportion, and cutting
that order into equal parts gives shards of which each matches the mixture.
The law is ``rows``: counts of shards are at most one apart.

Fractional ranks are uniform, so the global order is ranked in equal
ranges of them; no task holds more than a range. Only narrow rows are
shuffled; sizes and checksums are computed where the text is read.

Defined cases: a null source is a source of its own, a null text is empty,
and ties (repeated rows, null ids) are broken by the checksum and then by
any order, which changes no count. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.llm.ranking import bucket_count, seeded_hash, with_rank
from claimweave.llm.tables import table, whole_text

SHARDS, SEED = 8, "shards-1"


def assign(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, text_crc32, shard and slot (from 0 in each shard) of every row."""
    text = whole_text(text_col)
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-")).alias("_source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    ).withColumn("_hash", seeded_hash(seed, "_id"))
    total = docs.count()
    buckets = bucket_count(total)
    ranked = with_rank(rows, "_source", ["_hash", "_id", "text_crc32"], buckets, "_hash")
    # The fraction is compared as whole numbers: range g of the order has fractions in [g, g + 1) / buckets.
    ordered = ranked.withColumn("_range", F.expr(f"cast((2 * _rank - 1) * {buckets} div (2 * _size) as int)"))
    counts = ordered.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # At most MOST_BUCKETS rows, whatever the input's size.
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_before"))
    in_range = F.row_number().over(Window.partitionBy("_range").orderBy(F.expr("cast(2 * _rank - 1 as double) / (2 * _size)"), "_source", "_rank"))
    placed = ordered.withColumn("_in", in_range).join(before, "_range").withColumn("_at", F.col("_before") + F.col("_in") - 1)
    n = max(total, 1)
    return placed.select(
        F.col("_id").alias(id_col), "size", "text_crc32",
        F.expr(f"cast(_at * {shards} div {n} as int)").alias("shard"), "_at",
    ).select(
        id_col, "size", "text_crc32", "shard",
        F.expr(f"_at - (cast(shard as bigint) * {n} + {shards - 1}) div {shards}").alias("slot"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
