"""Pairs of companies that share most, against a plain count of all pairs."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest

from claimweave.operators import discovery
from claimweave.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("small", [False, True])
def test_best_of_all_pairs(spark, monkeypatch, small):
    if small:  # long lists are cut into runs, and a task sums what it has gathered in between
        monkeypatch.setattr(discovery, "RUN", 5)
        monkeypatch.setattr(discovery, "TASK_PAIRS", 40)
    rng = random.Random(3)
    rows = [(f"S{rng.randrange(60)}", f"P{rng.randrange(25)}") for _ in range(500)] + [("S7", "alone")]
    pointing = {}
    for s, via in rows:
        pointing.setdefault(via, set()).add(s)
    want = Counter()
    for some in pointing.values():
        for pair in combinations(sorted(some), 2):
            want[pair] += 1 / math.log1p(len(some))
    ordered = sorted((-round(v, 6), *pair) for pair, v in want.items())[:40]
    found = discovery.best_linked(spark.createDataFrame(rows, "subject_entity string, object_entity string"), 40)
    assert sorted((-r.score, r.a, r.b) for r in found.collect()) == ordered
    assert discovery.best_linked(spark.createDataFrame([], "subject_entity string, object_entity string"), 40).isEmpty()


def test_no_step_shuffles_pairs_of_companies(spark):
    """Only lists of numbers are dealt: the plan up to the best pairs has no join or exchange by both ends."""
    plan = registry.queries()["link_prediction"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" not in plan and "hashpartitioning(via" not in plan
