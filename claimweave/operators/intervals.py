"""Overlaps of intervals within groups, counted by a sweep or paired through buckets of time.

An interval (``valid_from``, ``valid_to``) is closed; a null start or end is
open. One that ends before it begins is never valid and overlaps nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.session import cut


#: So many keys of groups, eight bytes each, are sent to every task at most.
SENT = 4_000_000


def in_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of groups that have two or more, written once; a row alone in its group overlaps nothing.

    Groups are counted and met by a hash of their keys, so that two of one
    hash pass as well and none is lost.
    """
    hashed = F.xxhash64(*keys)
    several = cut(rows.groupBy(hashed.alias("_group")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_group"))
    few = several.count() <= SENT
    return cut(rows.withColumn("_group", hashed).join(F.broadcast(several) if few else several, "_group", "left_semi").drop("_group"))


def _valid(rows: DataFrame) -> DataFrame:
    return rows.filter(F.coalesce(F.col("valid_to") >= F.col("valid_from"), F.lit(True)))


def overlap_counts_between(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """The same between rows of different ids: what overlaps among the rows of a repeated id is counted too, and taken off."""
    repeated = rows.groupBy(*keys, id_col).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    own = overlap_counts(rows.join(repeated, [*keys, id_col], "left_semi"), [*keys, id_col]).groupBy(*keys).agg(F.sum("overlapping").alias("_own"))
    return overlap_counts(rows, keys).join(own, keys, "left").withColumn("overlapping", F.col("overlapping") - F.coalesce("_own", F.lit(0))).drop("_own")


def overlap_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, overlapping): how many pairs of a group's intervals overlap, without forming a pair.

    Two intervals are apart if one starts after the other ends, so those
    that overlap are all pairs less, for each end, the starts after it. Equal
    starts and ends are summed first; the rest is range-sorted, counted within
    the sort's parts and shifted by the parts before, so that a group may
    span any number of tasks. Rows grow with the intervals, not with pairs.
    """
    points = _valid(rows).select(*keys, F.explode(F.array(F.struct(F.col("valid_from").alias("t"), F.lit(0).alias("end")), F.struct(F.col("valid_to").alias("t"), F.lit(1).alias("end")))).alias("_p"))
    summed = points.select(*keys, "_p.t", "_p.end").filter("end = 0 or t is not null").groupBy(*keys, "t", "end").agg(F.count(F.lit(1)).alias("_n"))
    sort = [*keys, F.asc_nulls_first("t"), "end"]
    placed = cut(summed.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    starts = F.when(F.col("end") == 0, F.col("_n")).otherwise(0)
    within = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = placed.withColumn("_begun", F.sum(starts).over(within))
    parts = placed.groupBy(*keys, "_part").agg(F.sum(starts).alias("_starts"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(*keys, "_part", F.coalesce(F.sum("_starts").over(earlier), F.lit(0)).alias("_before"), F.sum("_starts").over(Window.partitionBy(*keys)).alias("_all"))
    on = F.lit(True)
    for c in (*keys, "_part"):
        on = on & F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}"))
    after = counted.alias("p").join(shifts.alias("s"), on).select(*[F.col(f"p.{c}").alias(c) for c in keys], F.when(F.col("p.end") == 1, F.col("p._n") * (F.col("_all") - F.col("_before") - F.col("_begun"))).otherwise(0).alias("_apart"), "_all")
    return after.groupBy(*keys).agg((F.floor(F.first("_all") * (F.first("_all") - 1) / 2) - F.sum("_apart")).cast("long").alias("overlapping"))


def overlap_pairs(rows: DataFrame, keys: list[str], id_col: str, days: int = 30) -> DataFrame:
    """(keys, id_a, id_b) of overlapping intervals of a group, id_a < id_b.

    Each interval is dealt to the stretches of ``days`` that it touches, and
    meets there those that start in the stretch, so a pair is formed once,
    where its later one starts, and intervals that are far apart never meet.
    Open ends reach the first and last times that occur.
    """
    named = rows.filter(" and ".join(f"{c} is not null" for c in (*keys, id_col)))
    valid = in_groups(_valid(named), keys)
    span = valid.agg(F.least(F.min("valid_from"), F.min("valid_to")).alias("_low"), F.greatest(F.max("valid_from"), F.max("valid_to")).alias("_high"))
    at = lambda t: F.floor(F.datediff(t, F.lit("1970-01-01")) / days)
    open_start, open_end = F.coalesce("valid_from", "_low"), F.coalesce("valid_to", F.greatest("_high", F.col("valid_from")))
    known = F.col("_low").isNotNull()
    bounded = valid.crossJoin(span).select(*keys, id_col, "valid_from", "valid_to", F.when(known, at(open_start)).otherwise(0).alias("_first"), F.when(known, at(open_end)).otherwise(0).alias("_last"))
    a = bounded.withColumn("_stretch", F.explode(F.sequence("_first", F.greatest("_first", "_last")))).alias("a")
    b = bounded.alias("b")
    id_a, id_b = F.col(f"a.{id_col}"), F.col(f"b.{id_col}")
    before = ((F.col("a._first") < F.col("b._first")) & (id_a != id_b)) | ((F.col("a._first") == F.col("b._first")) & (id_a < id_b))
    on = (F.col("a._stretch") == F.col("b._first")) & before
    for c in keys:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    apart = F.coalesce(F.col("a.valid_from") > F.col("b.valid_to"), F.lit(False)) | F.coalesce(F.col("b.valid_from") > F.col("a.valid_to"), F.lit(False))
    return a.join(b, on).filter(~apart).select(*[F.col(f"a.{c}").alias(c) for c in keys], F.least(id_a, id_b).alias("id_a"), F.greatest(id_a, id_b).alias("id_b"))
