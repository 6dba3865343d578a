"""The first pairs with a shared dependency, formed for the first companies alone."""

import random

from claimweave.operators import discovery
from claimweave.plans import graph_queries
from claimweave.sources.claimgraph import ClaimGraph
from pyspark.sql import functions as F


def test_first_pairs_against_all_pairs(spark):
    rng = random.Random(3)
    names = [f"C{i:03}" for i in range(60)]
    rows = list({(rng.choice(names), f"V{rng.randrange(25)}") for _ in range(200)})
    dependency = spark.createDataFrame(rows, "subject_entity string, object_entity string")
    # The first companies have edges with all others, so that more of them must be asked for.
    edge = spark.createDataFrame([(y, x) if i % 2 else (x, y) for x in names[:12] for i, y in enumerate(names)], "src string, dst string")
    every = discovery.without_edge(discovery.shared_pairs(dependency), edge)
    wanted = sorted(map(tuple, every.select("a", "b", "via").collect()))
    for most in (1, 5, 60, 5000):
        got = [tuple(r) for r in discovery.first_pairs(dependency, edge, most).select("a", "b", "via").collect()]
        assert sorted(got) == wanted[:most]
    none = discovery.first_pairs(dependency.filter("false"), edge, 5)
    assert none.agg(F.count(F.lit(1))).first()[0] == 0


def test_hypotheses_are_worked_out_once_for_a_query(spark):
    g = ClaimGraph(spark, "/root/testdata/sf0.001")
    assert graph_queries.hypotheses(g) is graph_queries.hypotheses(g)
    assert "Join" not in graph_queries.hypotheses(g)._jdf.queryExecution().optimizedPlan().toString()


def test_all_pairs_are_dealt_over_tasks(spark, monkeypatch):
    rows = [(f"S{i}", "hot") for i in range(60)] + [(f"S{i}", f"P{i % 9}") for i in range(40)] + [("S1", "hot"), ("S7", "lone")]
    dependency = spark.createDataFrame(rows, "subject_entity string, object_entity string")
    sides = set(rows)
    want = sorted((a, b, v) for a, v in sides for b, w in sides if v == w and a < b)
    monkeypatch.setattr(discovery, "RUN", 7)
    monkeypatch.setattr(discovery, "TASK_PAIRS", 150)
    pairs = discovery.shared_pairs(dependency)
    assert sorted(map(tuple, pairs.collect())) == want
    assert pairs.rdd.getNumPartitions() == 1 + len(want) // 150
    assert discovery.shared_pairs(dependency.limit(0)).count() == 0
