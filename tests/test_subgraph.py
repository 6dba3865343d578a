"""What a hypothesis's subgraph shows."""

import json
from datetime import datetime, timedelta

from claimweave.operators import discovery

CLAIM = "claim_id string, subject_entity string, object_entity string, subject_surface string, object_surface string, predicate_raw string, literal_value double, literal_currency string, literal_as_of string, literal_unit string, source_id string, observed_at timestamp_ntz, confidence double, lineage_id string"


def claim(i, subject, obj=None, surface=None, value=None, day=0):
    return (i, subject, obj, f"surface {subject}", surface, "buys", value, "USD" if value else None, None, None, "s", datetime(2024, 1, 1) + timedelta(days=day), 0.5, "L")


def test_evidence_then_claims_of_each_subject_and_what_is_not_recorded(spark):
    evidence = [claim(f"e{i:02}", "A", "V", day=i) for i in range(32)] + [claim("t1", "A", "V", day=31)]
    of_a = [claim(f"a{i:02}", "A", surface="thing", day=40 + i) for i in range(20)]
    of_b = [claim("b1", "B", value=7.5, day=3), claim("b2", "X", "B", day=4), claim("b3", "A", "B", day=70)]
    hypotheses = spark.createDataFrame([("A|B", "A", "B", [c[0] for c in evidence]), ("C|Z", "C", "Z", ["c1"])], "hypothesis_id string, a string, b string, evidence array<string>")
    claims = spark.createDataFrame(evidence + of_a + of_b + [claim("c1", "C", "V")], CLAIM)
    names = spark.createDataFrame([("A", "Alpha"), ("B", "Beta"), ("V", "Vau")], "entity_id string, name string")
    out = {r.hypothesis_id: r for r in discovery.subgraph(hypotheses, claims, names).collect()}
    shown = out["A|B"].shown.split(",")
    # Of 33 claims of evidence the latest thirty; claims of one day by id.
    assert shown[:30] == [f"e{i:02}" for i in range(3, 32)] + ["t1"]
    # Then fifteen of A, latest first, and those of B on either end that A did not show.
    assert shown[30:] == ["b3"] + [f"a{i:02}" for i in range(19, 5, -1)] + ["b2", "b1"]
    lines, none = out["A|B"].subgraph.split("\n\n")
    lines = [json.loads(x) for x in lines.split("\n")]
    assert [x["id"] for x in lines] == shown and none == "No recorded relationship between Alpha and Beta."
    assert lines[0] == {"id": "e03", "subject": "Alpha", "predicate": "buys", "object": "Vau", "quote": None, "source": "s", "observed_at": "2024-01-04T00:00:00", "confidence": 0.5, "lineage": "L"}
    assert lines[31]["object"] == "thing" and lines[-1]["object"] == {"value": 7.5, "currency": "USD", "as_of": None, "unit": None} and lines[-2]["subject"] == "surface X"
    assert out["C|Z"].shown == "c1" and out["C|Z"].subgraph.endswith("No recorded relationship between C and Z.")
