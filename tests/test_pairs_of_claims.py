"""Pairs of claims are decided where they are formed: no step moves a pair."""

import re

from claimweave.operators import graph, merges
from claimweave.plans import registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_pairs_are_not_joined_again(spark):
    for name in ("contradictions_resolve", "unmerge_heal", "merge_heal"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.split("\n") if "Join" in line and re.search(r"claim_[ab]#\d+ = claim_[ab]#\d+", line)], name
        assert not [line for line in plan.split("\n") if "Join" in line and re.search(r"claim_id#\d+ = claim_[ab]#\d+|claim_[ab]#\d+ = claim_id#\d+", line)], name


def test_claims_resolve_as_their_pairs_do(spark):
    from claimweave.plans import graph_queries as q
    from claimweave.sources.claimgraph import ClaimGraph

    g = ClaimGraph(spark, SF)
    claims = q.varied(g.claim)
    watched = spark.createDataFrame([("S1",), ("S3",)], "entity_id string")
    raw = graph.raw_subjects(g.claim, g.mention).withColumn("raw", F.when(F.col("claim_id").endswith("3"), "other").otherwise(F.col("raw")))
    by_pairs = graph.resolve_contradictions(graph.contradictions(claims, g.predicate_map), raw, watched)
    by_claims = graph.resolve_claims(claims.join(raw, "claim_id"), g.predicate_map, watched)
    rows = sorted(map(tuple, by_pairs.collect()), key=repr)
    assert rows == sorted(map(tuple, by_claims.select(*by_pairs.columns).collect()), key=repr)
    assert {r[5] for r in rows} == {"open", "auto_resolved"} and {r[7] for r in rows} == {True, False}


def test_carried_ends_heal_as_joined_ones(spark):
    claims = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "Q"), ("4", "Q"), ("5", "X"), ("6", "Y")], "claim_id string, raw string")
    marked = merges.with_undone(claims, spark.createDataFrame([("A",), ("Q",)], "entity string"))
    ends = [marked.select(*[F.col(c).alias(n) for c, n in (("claim_id", f"claim_{s}"), ("raw", f"raw_{s}"), ("undone", f"undone_{s}"))]) for s in "ab"]
    pairs = ends[0].join(ends[1], F.col("claim_b") == F.col("claim_a") + 1).filter("claim_a in ('1', '3', '5')").withColumn("claim_b", F.col("claim_b").cast("string")).withColumn("kept", F.col("claim_a"))
    assert [tuple(r) for r in merges.heal_carried(pairs).collect()] == [("1", "2", "2")]
