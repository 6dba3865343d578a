"""Exact ranks within groups of any size, without a group in one task (native).

A row's seeded hash falls uniformly into one of ``buckets`` equal ranges,
so a bucket of a hot group holds as small a share of it as any other. A
window ranks the rows of each (group, bucket), and the counts of the
buckets before it, one narrow row for each, are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.tables import persist_cut

#: Rows that a bucket is meant to hold, and the most buckets of one group.
BUCKET_ROWS, MOST_BUCKETS = 256, 1 << 16


def seeded_hash(seed: str, *columns: str) -> Column:
    """Hexadecimal MD5 of the seed and the columns as text; null is told from the empty text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(seed), *parts).cast("binary"))


def bucket_count(rows: int) -> int:
    return max(1, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)))


def with_rank(rows: DataFrame, group: str, order: list[str], buckets: int, hash_col: str) -> DataFrame:
    """Adds ``_rank`` (from 1, by ``order``, which begins with ``hash_col``) and ``_size``, of each row's group.

    ``hash_col`` is hexadecimal and uniform; the group column has no null.
    """
    keyed = rows.withColumn("_bucket", F.floor(F.conv(F.substring(hash_col, 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int"))
    counts = keyed.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_group = Window.partitionBy(group)
    before = counts.select(
        group, "_bucket",
        (F.sum("_n").over(by_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(by_group).alias("_size"),
    )
    within = keyed.withColumn("_in_bucket", F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)))
    return within.join(before, [group, "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_in_bucket")).drop("_bucket", "_in_bucket", "_before")


def placed_in_order(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``_part`` and ``_row``: where each row stands once all are sorted by the group and ``order``.

    A range sort cuts a group of any size over as many tasks as its rows
    need; ``_row`` ascends within a part, and the parts follow each other.
    The places are written, so that a lost executor can't change them.
    """
    at = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    return persist_cut(at).withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")


def running_before(totals: DataFrame, group: str, value: str) -> Column:
    """The sum of ``value`` over a group's earlier parts; ``totals`` has one row for each group and part."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def part_shifts(placed: DataFrame, group: str) -> DataFrame:
    """(group, _part, _shift, _size): what to add to ``_row`` for a row's place in its group, and the group's rows.

    One narrow row for each group and part is ranked; no task holds a group.
    """
    starts = placed.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return starts.select(group, "_part", (running_before(starts, group, "_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(group)).alias("_size"))


def with_position(placed: DataFrame, group: str) -> DataFrame:
    """Adds ``_pos``, each row's place in its group from 0, and ``_size``, the group's rows, to rows ``placed_in_order``."""
    return placed.join(part_shifts(placed, group), [group, "_part"]).withColumn("_pos", F.col("_row") + F.col("_shift")).drop("_shift")
