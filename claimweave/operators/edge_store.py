"""Edges kept as files by origin and slice, of which a rebuild replaces its own and nothing else.

A slice is a range of the hash of (src, dst, predicate). A rebuild writes all
slices of one origin; a refresh only those that changed claims touch.
Spark's dynamic partition overwrite replaces the folders that are written and
leaves the others as they are, in one commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from claimweave.operators import graph

KEYS = ["src", "dst", "predicate"]
#: Slices of an origin; so many that a slice of the largest origin is a task's work.
SLICES = 64


def slice_of(slices: int) -> Column:
    return F.pmod(F.xxhash64(*KEYS), F.lit(slices)).cast("int")


def _put(edges: DataFrame, path: str, origin: str, slices: int) -> set[int]:
    """Write the slices that have edges, and tell which they are, as seen while they are written: edges are worked out once."""
    seen = Observation()
    placed = edges.withColumns({"origin": F.lit(origin), "slice": slice_of(slices)}).observe(seen, F.collect_set("slice").alias("slices"))
    placed.repartition("slice").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("origin", "slice").parquet(path)
    return set(seen.get["slices"])


def rebuild(claims: DataFrame, same_as: DataFrame, predicate_map: DataFrame, path: str, origin: str = "claim", slices: int = SLICES) -> None:
    """All edges of ``origin`` from all claims. Folders of slices without edges go, so that none of an earlier run stays."""
    full = _put(graph.materialize_edges(claims, same_as, predicate_map), path, origin, slices)
    _empty(claims.sparkSession, set(range(slices)) - full, path, origin)


def refresh(changed: DataFrame, claims: DataFrame, same_as: DataFrame, predicate_map: DataFrame, path: str, origin: str = "claim", slices: int = SLICES) -> None:
    """Bring the edges up to date after ``changed`` claims (as they were or are) among ``claims`` (as they are).

    Claims outside the touched slices are filtered out before anything is
    aggregated; merges must not have changed since the last rebuild.
    """
    ends = lambda rows: graph.canonicalize(graph.with_canon(rows.filter("subject_entity is not null and object_entity is not null"), predicate_map), same_as, {"subject_entity": "src", "object_entity": "dst"}).withColumn("predicate", F.col("predicate_canon"))
    touched = {r["slice"] for r in ends(changed).select(slice_of(slices).alias("slice")).distinct().collect()}  # at most the number of slices
    # Where all slices are touched there is nothing to leave out.
    some = claims if len(touched) == slices else ends(claims).filter(slice_of(slices).isin(sorted(touched))).select(*claims.columns)
    full = _put(graph.materialize_edges(some, same_as, predicate_map), path, origin, slices)
    _empty(claims.sparkSession, touched - full, path, origin)


def _empty(spark: SparkSession, slices: set[int], path: str, origin: str) -> None:
    """Remove the folders of slices that have no edges any more."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(context._jsc.hadoopConfiguration())
    for n in sorted(slices):
        files.delete(hadoop(f"{path}/origin={origin}/slice={n}"), True)


def stored(spark, path: str) -> DataFrame:  # noqa: ANN001
    return spark.read.parquet(path)
