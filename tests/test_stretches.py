"""Near copies of a stream whose sketches are all alike."""

from claimweave.operators import ingest
from claimweave.streaming import stateful

ARRIVAL = "event_id string, position long, simhash long"


def test_no_task_gets_all_arrivals_of_one_band(spark, tmp_path, monkeypatch):
    """Sketches that share three bands would all meet in one ring; a group holds a stretch and what counts before it."""
    rows = [(f"e{i:04}", i, 1 + i * 7 % 60) for i in range(900)]
    whole = spark.createDataFrame(rows, ARRIVAL)
    near = {r.event_id: r.near_id for r in ingest.near_duplicates(whole, recent=30).collect()}
    whole.repartition(3).write.parquet(str(tmp_path / "in"))
    groups = {}

    def each(frame, root, put, mode="append"):
        plan = frame._jdf.queryExecution().analyzed().toString()
        groups["keys"] = plan.count("stretch#") > 0
        return start(frame, root, put, mode)

    start = stateful.start
    monkeypatch.setattr(stateful, "start", each)
    out = stateful.near_copies(spark.readStream.schema(ARRIVAL).parquet(str(tmp_path / "in")), str(tmp_path / "run"), recent=30)
    assert {r.event_id: r.near_id for r in out.collect()} == {e: near.get(e) for e, _, _ in rows}
    assert groups["keys"]
