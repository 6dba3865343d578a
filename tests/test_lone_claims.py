"""Claims that meet no other are left out before anything is joined to them."""

from claimweave.operators import graph
from test_graph import CLAIM, claim


def test_only_claims_that_meet_another_are_kept(spark):
    rows = [
        claim("o1", "A", "ceo", obj="X"), claim("o2", "A", "ceo", obj="Y"), claim("o3", "A", "ceo", surface="Zed"), claim("o4", "B", "ceo", obj="X"),
        claim("l1", "A", "sales", value=1.0, currency="USD"), claim("l2", "A", "sales", value=2.0, currency="USD"), claim("l3", "A", "sales", value=2.0, currency="EUR"), claim("l4", "A", "sales", value=9.0),
        claim("b1", "C", "parent", obj="X", value=1.0), claim("b2", "C", "parent", obj="Y", value=1.0), claim("n1", "A", "likes", obj="X"), claim("n2", "A", "likes", obj="Y"),
    ]
    pmap = spark.createDataFrame([], "version int, predicate_raw string, predicate_canon string")
    met = graph._not_alone(graph._facts(spark.createDataFrame(rows, CLAIM), pmap, ()))
    assert sorted((r._by, r.claim_id) for r in met.collect()) == [("literal", "b1"), ("literal", "b2"), ("literal", "l1"), ("literal", "l2"), ("object", "b1"), ("object", "b2"), ("object", "o1"), ("object", "o2")]


def test_raw_subjects_of_mentions_are_found_for_them(spark):
    rows = [claim("1", "A", "ceo", obj="X", day=1), claim("2", "A", "ceo", obj="Y", day=2), claim("3", "A", "ceo", obj="Z", day=3)]
    claims = spark.createDataFrame(rows, CLAIM)
    pmap = spark.createDataFrame([], "version int, predicate_raw string, predicate_canon string")
    mentions = spark.createDataFrame([("E3", "surface A", "merged")], "event_id string, surface string, resolved_entity string")
    watched = spark.createDataFrame([("A",)], "entity_id string")
    out = {(r.claim_a, r.claim_b): (r.state, r.kept, r.alert) for r in graph.resolve_claims(claims, pmap, watched, mentions).collect()}
    # 1 and 2 are of one subject and lineage; 3 was another one before a merge.
    assert out == {("1", "2"): ("auto_resolved", "2", False), ("2", "3"): ("open", None, True)}
    again = graph.resolve_claims(graph.with_raw(claims, mentions), pmap, watched)
    assert {(r.claim_a, r.claim_b): (r.state, r.kept, r.alert) for r in again.collect()} == out
