"""Connected components by alternating large and small stars, or by forests of each task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.tables import in_workers, persist_cut

#: Rows of a batch that a task returns.
BATCH = 10_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of itself and its neighbours."""
    both = edges.unionByName(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
    least = both.groupBy("_a").agg(F.least(F.min("_b"), F.col("_a")).alias("_m"))
    return both.filter("_b > _a").join(least, "_a").select(F.col("_m").alias("_a"), "_b").filter("_a != _b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of those; in ``edges`` _a < _b."""
    least = edges.groupBy("_b").agg(F.min("_a").alias("_m"))
    moved = edges.join(least, "_b").select(F.col("_m"), F.col("_a")).filter("_a != _m").select(F.col("_m").alias("_a"), F.col("_a").alias("_b"))
    own = least.select(F.col("_m").alias("_a"), "_b")
    return moved.unionByName(own).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(_member, _component) of every end of a link (_a, _b); a component is named by its least member.

    Rounds go on until a round changes no link; their number grows with the
    logarithm of the number of links.
    """
    edges = persist_cut(links.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).filter("_a != _b").distinct())
    print_of = F.coalesce(F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)")), F.lit(0)).alias("s")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), print_of).first()
        if before is not None and tuple(now) == before or now["n"] == 0:
            break
        before = tuple(now)
        edges = persist_cut(_small_star(_large_star(edges)))
    members = edges.select(F.col("_b").alias("_member"), F.col("_a").alias("_component"))
    return members.unionByName(edges.select(F.col("_a").alias("_member"), F.col("_a").alias("_component"))).distinct()


def _stars_of_tasks(edges: DataFrame) -> DataFrame:
    """(_a, _b, _own): each end but the least of those that a task's links connect, beside that least end; whether it was the larger end of a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: dict = {}
        larger: set = set()

        def find(v):
            while head[v] != v:
                head[v] = head[head[v]]
                v = head[v]
            return v

        kind = None
        for batch in batches:
            kind = batch.schema.types[0]
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head.setdefault(a, a)
                head.setdefault(b, b)
                larger.add(b)
                low, high = sorted((find(a), find(b)))
                head[high] = low
        ends = [v for v in head if head[v] != v]
        for at in range(0, len(ends), BATCH):
            some = ends[at : at + BATCH]
            yield pa.RecordBatch.from_arrays([pa.array(map(find, some), kind), pa.array(some, kind), pa.array([v in larger for v in some], pa.bool_())], ["_a", "_b", "_own"])

    kind = dict(edges.dtypes)["_a"]
    return in_workers(edges.select("_a", "_b"), run, f"_a {kind}, _b {kind}, _own boolean")


def merged(joined: DataFrame | None, links: DataFrame) -> DataFrame:
    """As ``connected``, of the links that ``joined`` (a former result, or None) stands for and of more ``links``.

    A round has three shuffles. Every task turns its links into stars, before
    and after they are dealt by their larger end, so a task sends an end once
    and a hub's links do not meet in one task; a star whose centre is an end
    of another star then moves to that one's centre. A task holds the ends of
    its own links. Rounds end when every end was dealt to the task that names
    its centre, so that it has one, and no centre is an end.
    """
    edges = links.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).filter("_a != _b")
    if joined is not None:
        edges = edges.unionByName(joined.filter("_member != _component").select(F.col("_component").alias("_a"), F.col("_member").alias("_b")))
    while True:
        stars = persist_cut(_stars_of_tasks(_stars_of_tasks(edges).select("_a", "_b").repartition("_b")))
        centres = stars.select("_a").distinct().join(stars.select(F.col("_b").alias("_of"), F.col("_a").alias("_up")), F.col("_a") == F.col("_of")).select("_of", "_up")
        if stars.filter("not _own").isEmpty() and centres.isEmpty():
            break
        edges = stars.join(centres, stars["_a"] == centres["_of"], "left").select(F.coalesce("_up", "_a").alias("_a"), "_b")
    members = stars.select(F.col("_b").alias("_member"), F.col("_a").alias("_component"))
    return members.unionByName(stars.select(F.col("_a").alias("_member"), F.col("_a").alias("_component")).distinct())
