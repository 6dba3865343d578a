import datetime
import json
from pathlib import Path

from pyspark.sql import functions as F

from claimweave.functions import open_json
from claimweave.operators import edge_store, graph

CLAIM = "claim_id string, subject_entity string, object_entity string, predicate_raw string, status string, valid_from timestamp_ntz, valid_to timestamp_ntz, confidence double, observed_at timestamp_ntz"
T = datetime.datetime(2024, 1, 1)


def claim(i, a, b, predicate="owns", status="asserted", confidence=0.5):
    return (f"c{i:03}", a, b, predicate, status, T, None, confidence, T + datetime.timedelta(days=i))


def same(a, b):
    drop = ("origin", "slice")
    key = lambda f: sorted(map(repr, f.drop(*drop).collect()))
    assert key(a.select(*sorted(a.drop(*drop).columns))) == key(b.select(*sorted(b.columns)))


def files(root, origin):
    return {str(p): p.stat().st_mtime_ns for p in Path(root).glob(f"origin={origin}/**/*.parquet")}


def test_rebuild_and_refresh_replace_their_own_files_alone(spark, tmp_path):
    path = str(tmp_path / "edges")
    frame = lambda rows: spark.createDataFrame(rows, CLAIM)
    merges = spark.createDataFrame([("M", "A1")], "a string, b string")
    predicates = spark.createDataFrame([(1, "owns", "holds")], "version int, predicate_raw string, predicate_canon string")
    rows = [claim(i, f"A{i % 20}", f"B{i % 7}", ["owns", "supplies"][i % 2]) for i in range(120)] + [claim(200, "M", "B1"), claim(201, "A1", None)]
    edge_store.rebuild(frame(rows), merges, predicates, path, "claim", 8)
    edge_store.rebuild(frame([claim(1, "X", "Y")]), merges, predicates, path, "inferred", 8)
    own, other = files(path, "claim"), files(path, "inferred")
    stored = lambda origin: edge_store.stored(spark, path).filter(F.col("origin") == origin)
    same(stored("claim"), graph.materialize_edges(frame(rows), merges, predicates))
    # One claim changes and one goes: only their slices are written again.
    changed = [claim(3, "A3", "B3", "supplies", "asserted", 0.9), claim(200, "M", "B1", "owns", "superseded")]
    now = [r for r in rows if r[0] not in ("c003", "c200")] + changed
    edge_store.refresh(frame(changed), frame(now), merges, predicates, path, "claim", 8)
    same(stored("claim"), graph.materialize_edges(frame(now), merges, predicates))
    kept = files(path, "claim")
    assert set(kept) & set(own) and set(own) - set(kept) and all(own[p] == kept[p] for p in set(kept) & set(own))
    assert files(path, "inferred") == other
    # A rebuild from fewer claims leaves nothing of the earlier run.
    edge_store.rebuild(frame(rows[:2]), merges, predicates, path, "claim", 8)
    same(stored("claim"), graph.materialize_edges(frame(rows[:2]), merges, predicates))
    assert files(path, "inferred") == other


def test_open_maps(spark):
    texts = ['{"stance":"reported","refined":null}', '{"stance":null}', '{"a":{"stance":"x"}}', "[]", "7", "no json", None, '{"history":[{"from":"a"},{"refined":1},3]}', '{"history":{"refined":1}}', '{"history":[]}']
    v = open_json.parsed(F.col("t"))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", "t", open_json.has_key(v, "refined").alias("key"), open_json.equals(v, "$.stance", F.lit("reported")).alias("same"), open_json.field(v, "$.a.stance").alias("deep"), open_json.any_has(v, "refined", "$.history").alias("some")
    )
    for r in rows.collect():
        try:
            data = json.loads(r.t or "")
        except ValueError:
            data = None
        obj = data if isinstance(data, dict) else {}
        assert r.key == ("refined" in obj) and r.same == (obj.get("stance") == "reported")
        assert r.deep == (obj.get("a") or {}).get("stance")
        history = obj.get("history")
        assert r.some == (isinstance(history, list) and any(isinstance(x, dict) and "refined" in x for x in history))


def test_edges_are_worked_out_once_for_a_rebuild(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(value: str) -> str:
        seen.add(1)
        return value

    rows = [claim(i, f"A{i}", "B") for i in range(5)]
    whole = graph.materialize_edges
    monkeypatch.setattr(graph, "materialize_edges", lambda *a: whole(*a).withColumn("src", F.udf(counted)("src")))
    merges, predicates = spark.createDataFrame([], "a string, b string"), spark.createDataFrame([], "version int, predicate_raw string, predicate_canon string")
    edge_store.rebuild(spark.createDataFrame(rows, CLAIM), merges, predicates, str(tmp_path / "edges"), "claim", 8)
    # The slice and the column may each ask for the name.
    assert 5 <= seen.value <= 10
    assert edge_store.stored(spark, str(tmp_path / "edges")).count() == 5
