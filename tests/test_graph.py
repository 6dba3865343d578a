import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from claimweave.operators import discovery, graph

CLAIM = "claim_id string, subject_entity string, subject_surface string, predicate_raw string, object_entity string, object_surface string, literal_value double, literal_currency string, literal_as_of string, literal_unit string, event_id string, lineage_id string, source_id string, observed_at timestamp_ntz, valid_from timestamp_ntz, valid_to timestamp_ntz, confidence double, status string"
DAY = datetime(2024, 1, 1)


def claim(i, subject, predicate, obj=None, surface=None, value=None, currency=None, as_of=None, unit=None, lineage="L1", day=1, status="asserted", source="s", vf=None, vt=None):
    return (i, subject, f"surface {subject}", predicate, obj, surface, value, currency, as_of, unit, f"E{i}", lineage, source, datetime(2024, 1, day), vf, vt, 0.9, status)


@pytest.fixture
def make(spark):
    return lambda rows: spark.createDataFrame(rows, CLAIM)


@pytest.fixture(scope="module")
def pmap(spark):
    return spark.createDataFrame([(1, "supplies", "old"), (2, "provides", "supplies")], "version int, predicate_raw string, predicate_canon string")


def merges(spark, rows):
    return spark.createDataFrame(rows, "a string, b string")


def test_materialize_follows_merges_and_open_ends(spark, make, pmap):
    claims = make([claim("1", "A", "Provides", "C", vf=DAY, vt=DAY), claim("2", "A", "supplies", "C", day=5), claim("3", "A", "supplies", "C", status="superseded"), claim("4", None, "supplies", "C")])
    edge = graph.materialize_edges(claims, merges(spark, []), pmap).collect()
    assert [(e.src, e.dst, e.predicate, e.claim_ids, e.valid_to, e.half_life_days) for e in edge] == [("A", "C", "supplies", ["1", "2"], None, 540)]
    merged = graph.materialize_edges(claims, merges(spark, [("A", "B")]), pmap).collect()
    assert [(e.src, e.dst) for e in merged] == [("B", "C")]


def test_contradictions(make, pmap):
    rows = [
        claim("a1", "A", "appointed_ceo", obj="X", lineage="L1"), claim("a2", "A", "appointed_ceo", obj="Y", lineage="L2"),
        claim("b1", "B", "revenue", value=100.0, currency="USD", as_of="2024"), claim("b2", "B", "revenue", value=110.0, currency="USD", as_of="2024", lineage="L2"), claim("b3", "B", "revenue", value=103.0, currency="EUR", as_of="2024"),
        claim("c1", "C", "profit", value=100.0), claim("c2", "C", "profit", value=103.0),
        claim("f1", "F", "holding", value=5e6, unit="shares"), claim("f2", "F", "holding", value=9e6, unit="tons"), claim("f3", "F", "holding", value=9e6, unit="shares", lineage="L2"), claim("f4", "F", "holding", value=5e6),
        claim("d1", "D", "appointed_cfo", surface="Alice Ang", lineage="L9"), claim("d2", "D", "appointed_cfo", surface="Bob Beam", lineage="L9", day=3), claim("d3", "D", "appointed_cfo", surface="alice ang", lineage="L8"), claim("d4", "D", "appointed_cfo", obj="P"),
        claim("e1", "E", "appointed_ceo", obj="X", vt=datetime(2020, 1, 1)), claim("e2", "E", "appointed_ceo", obj="Y", vf=datetime(2021, 1, 1)),
    ]
    pairs = graph.contradictions(make(rows), pmap)
    found = {(r.claim_a, r.claim_b, r.kind) for r in pairs.collect()}
    assert found == {("a1", "a2", "object_conflict"), ("b1", "b2", "literal_conflict"), ("f1", "f3", "literal_conflict"), ("d1", "d2", "object_conflict"), ("d2", "d3", "object_conflict")}
    done = {(r.claim_a, r.claim_b): (r.state, r.kept) for r in graph.resolve_contradictions(pairs).collect()}
    # d1 is older than d2 and of its lineage, so it is superseded; d2 against d3 stays open.
    assert done == {("a1", "a2"): ("open", None), ("b1", "b2"): ("open", None), ("f1", "f3"): ("open", None), ("d1", "d2"): ("auto_resolved", "d2"), ("d2", "d3"): ("open", None)}


def test_superseded_claims_enter_no_later_pair(make, pmap):
    rows = [claim("1", "A", "ceo", obj="X", day=1), claim("2", "A", "ceo", obj="Y", day=2), claim("3", "A", "ceo", obj="Z", day=3)]
    done = {(r.claim_a, r.claim_b): r.kept for r in graph.resolve_contradictions(graph.contradictions(make(rows), pmap)).collect()}
    assert done == {("1", "2"): "2", ("2", "3"): "3"}


def plain_resolution(pairs, raw, recorded):
    gone, out = set(), {}
    for p in sorted(pairs, key=lambda p: (p.subject_entity, p.predicate_canon, p.claim_a, p.claim_b)):
        a, b = p.claim_a, p.claim_b
        if (a, b) in recorded or a in gone or b in gone:
            continue
        if p.same_lineage and raw[a] == raw[b]:
            older, newer = sorted([(p.observed_a, a), (p.observed_b, b)])
            gone.add(older[1])
            out[a, b] = ("auto_resolved", newer[1], False)
        else:
            out[a, b] = ("open", None, p.subject_entity == "A")
    return out


def test_resolution_against_a_plain_loop(spark, make, pmap):
    rng = random.Random(5)
    rows = []
    for i in range(160):
        who = rng.choice("AAB")
        if i % 2:
            rows.append(claim(f"{i:03}", who, rng.choice(["owner_of", "ticker_is", "incorporation"]), obj=rng.choice("XYZ"), lineage=rng.choice(["L1", "L2"]), day=rng.randrange(1, 20), value=rng.choice([None, 1.0, 2.0])))
        else:
            rows.append(claim(f"{i:03}", who, "revenue", value=float(rng.randrange(90, 130)), currency=rng.choice([None, "USD"]), as_of=rng.choice(["2023", "2024"]), lineage=rng.choice(["L1", "L2"]), day=rng.randrange(1, 20)))
    raw = {r[0]: rng.choice(["A", "A", "A", "C"]) for r in rows}
    pairs = graph.contradictions(make(rows), pmap).cache()
    listed = pairs.collect()
    recorded = {(p.claim_a, p.claim_b) for p in listed if rng.random() < 0.1}
    out = graph.resolve_contradictions(
        pairs, spark.createDataFrame(list(raw.items()), "claim_id string, raw string"), spark.createDataFrame([("A",)], "entity_id string"), spark.createDataFrame(list(recorded), "claim_a string, claim_b string")
    )
    done = {(r.claim_a, r.claim_b): (r.state, r.kept, r.alert) for r in out.collect()}
    assert done == plain_resolution(listed, raw, recorded)
    assert {s for s, _, _ in done.values()} == {"open", "auto_resolved"} and len(done) < len(listed) - len(recorded)


def test_each_single_valued_keyword_conflicts(make, pmap):
    said = ["appointed_ceo", "named_cfo", "chairs_board", "headquartered_in", "incorporation", "incorporated_in", "ticker_is", "parent_of", "owner_of", "located_in"]
    rows = [claim(f"{p}{i}", "A", p, obj=x) for p in said for i, x in enumerate("XY")]
    assert {r.predicate_canon for r in graph.contradictions(make(rows), pmap).collect()} == set(said) - {"located_in"}


def test_raw_subjects(spark, make):
    mentions = spark.createDataFrame([("E1", "surface A", "Q"), ("E2", "surface A", None)], "event_id string, surface string, resolved_entity string")
    assert {r.claim_id: r.raw for r in graph.raw_subjects(make([claim("1", "A", "owns"), claim("2", "A", "owns")]), mentions).collect()} == {"1": "Q", "2": "A"}


def test_reliability(make, pmap):
    rows = [claim(f"s{i}", "A", "supplies", obj=f"X{i}", source="one") for i in range(4)] + [claim(f"t{i}", "A", "supplies", obj=f"X{i}", lineage="L2", source="two") for i in range(4)]
    rows += [claim(f"u{i}", "A", "owns", obj="Q", status="superseded", source="one") for i in range(2)]
    out = {r.source_id: r.score for r in graph.reliability(make(rows), pmap).collect()}
    assert out == {"one": pytest.approx(0.5 + 0.3 * 4 / 6 - 0.4 * 2 / 6)}


def test_link_claims_through_merges(spark, make):
    mentions = spark.createDataFrame([("E1", "surface A", "A"), ("E2", "surface Q", None)], "event_id string, surface string, resolved_entity string")
    out = graph.link_claims(make([claim("1", "A", "owns"), claim("2", "Q", "owns")]), mentions, merges(spark, [("A", "B")])).collect()
    assert [(r.claim_id, r.linked_subject) for r in out] == [("1", "B")]


def test_merge_log_stays_one_hop(spark):
    log = merges(spark, [("C", "A"), ("D", "B")])
    assert sorted(map(tuple, graph.merge_log(log, "A", "D").collect())) == [("A", "B"), ("C", "B"), ("D", "B")]


def test_attribute_join_and_edges_between(spark, make):
    entity = spark.createDataFrame([(x, "company" if x in "ABC" else "product") for x in "ABCV"], "entity_id string, kind string").withColumn("name", F.col("entity_id")).withColumn("ticker", F.lit(None).cast("string"))
    claims = make([claim("1", "A", "sources_from", obj="V"), claim("2", "B", "DEPENDS_on", obj="V", day=2), claim("3", "C", "owns", obj="V"), claim("4", "B", "depends_on", obj="V", day=1)])
    none = spark.createDataFrame([], "src string, dst string")
    out = discovery.attribute_join(claims, entity, none).collect()
    assert [(r.a, r.b, r.via, r.evidence) for r in out] == [("A", "B", "V", ["1", "2", "4"])]
    assert discovery.attribute_join(claims, entity, spark.createDataFrame([("B", "A")], "src string, dst string")).count() == 0


def test_independence_and_gate(spark):
    rows = [("h1", "L1", 0.9), ("h1", "L2", None), ("h1", "L3", 0.1), ("h2", "L1", 0.45), ("h2", "L2", 0.45), ("h3", "L1", 0.9), ("h3", "L1", 0.9)]
    independent = discovery.independence(spark.createDataFrame(rows, "hypothesis_id string, lineage_id string, reliability double"))
    verdicts = spark.createDataFrame([("h1", "promote", "2"), ("h2", "promote", "x"), ("h3", "promote", None), ("h4", "refute", "0.2"), ("h5", "odd", "0.2")], "hypothesis_id string, verdict string, confidence string")
    out = {r.hypothesis_id: (r.independent, r.state, r.confidence) for r in discovery.verify_gate(verdicts, independent).collect()}
    assert out == {"h1": (2, "promoted", 1.0), "h2": (2, "parked", 0.5), "h3": (1, "parked", 0.5), "h4": (0, "refuted", 0.2), "h5": (0, "parked", 0.2)}


def test_wake(spark, make):
    parked = spark.createDataFrame([("h1", datetime(2024, 1, 3), ["A", "Z"]), ("h2", datetime(2024, 1, 9), ["A"])], "hypothesis_id string, parked_at timestamp_ntz, entities array<string>")
    assert [r.hypothesis_id for r in discovery.wake(parked, make([claim("1", "Q", "owns", obj="A", day=5)])).collect()] == ["h1"]
