import random

import pytest

from claimweave.operators import discovery, ingest
from claimweave.streaming import stateful


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / name)


def write(spark, rows, schema, path, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{n:03}")


def read(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


ARRIVAL = "event_id string, position long, simhash long"


def sketches(n, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(63) for _ in range(25)]
    rows = []
    for i in range(n):
        value = rng.choice(centres)
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            value ^= 1 << rng.randrange(63)
        rows.append((f"e{i:04}", i, value))
    return rows


def test_near_copies_in_batches_and_after_a_restart_as_at_once(spark, folder):
    rows, source, root = sketches(600, 1), folder("in"), folder("run")
    whole = spark.createDataFrame(rows, ARRIVAL)
    near = ingest.near_duplicates(whole, recent=100)
    want = {r.event_id: (r.near_id, r.lineage_id) for r in ingest.lineages(whole.select("event_id").join(near, "event_id", "left")).join(near, "event_id", "left").collect()}
    for n in range(3):
        write(spark, rows[100 * n : 100 * n + 100], ARRIVAL, source, n)
    assert stateful.near_copies(read(spark, source, ARRIVAL), root, recent=100).count() == 300
    for n in range(3, 6):  # the query starts again from its checkpoint
        write(spark, rows[100 * n : 100 * n + 100], ARRIVAL, source, n)
    out = stateful.near_copies(read(spark, source, ARRIVAL), root, recent=100)
    assert {r.event_id: (r.near_id, r.lineage_id) for r in out.collect()} == want
    assert len({v for _, v in want.values()}) < len(rows) and any(a and a != b for a, b in want.values())


def test_rings_of_past_arrivals_go(spark, folder):
    source, root, held = folder("in"), folder("run"), []
    for n in range(6):
        write(spark, [(f"e{n}{i}", 50 * n + i, (n * 50 + i) * 0x9E3779B97F4A7C15 % 2**63) for i in range(50)], ARRIVAL, source, n)
    old = stateful.start
    try:
        stateful.start = lambda *a, **k: held.append(old(*a, **k))
        stateful.near_copies(read(spark, source, ARRIVAL), root, recent=20)
    finally:
        stateful.start = old
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in held[0].recentProgress if p["stateOperators"]]
    assert len(rows) >= 6 and max(rows[3:]) <= max(rows[:3]) and rows[-1] < 300 * 4


ACTION = "job_id string, at timestamp_ntz, kind string, worker string"


def test_leases_expire_and_end(spark, folder):
    source, root = folder("in"), folder("run")
    day = "2024-01-01 "
    batches = [
        [("a", "00:00:00", "enqueue", None), ("a", "00:01:00", "enqueue", None), ("a", "00:02:00", "lease", "w1"), ("b", "00:00:00", "enqueue", None), ("b", "00:03:00", "lease", "w1"), ("b", "00:04:00", "fail", "w2"), ("b", "00:05:00", "fail", "w1"), ("c", "00:00:00", "enqueue", None)],
        [("b", "00:06:00", "lease", "w3"), ("b", "00:25:00", "lease", "w3"), ("d", "00:40:00", "enqueue", None)],  # too soon, then in time; the lease of a runs out
        [("a", "00:41:00", "lease", "w4"), ("d", "01:30:00", "lease", "w5"), ("ghost", "01:00:00", "lease", "w5")],
        [("a", "01:31:00", "lease", "w6"), ("b", "01:32:00", "complete", "w3"), ("d", "01:33:00", "complete", "w5"), ("d", "01:34:00", "complete", "w5")],
        [("x", "03:00:00", "enqueue", None)],
        [("x", "04:00:00", "lease", "w1")],
    ]
    import datetime

    for n, rows in enumerate(batches):
        write(spark, [(j, datetime.datetime.fromisoformat(day + t), k, w) for j, t, k, w in rows], ACTION, source, n)
    write(spark, [("y", datetime.datetime(2024, 1, 20), "enqueue", None)], ACTION, source, 7)
    write(spark, [("y", datetime.datetime(2024, 1, 21), "enqueue", None)], ACTION, source, 8)
    out = stateful.leases(read(spark, source, ACTION), root)
    seen = {}
    for r in sorted(out.collect(), key=lambda r: r.at_ms):
        seen.setdefault(r.job_id, []).append((r.status, r.attempts))
    assert seen["a"] == [("pending", 0), ("leased", 1), ("pending", 1), ("leased", 2), ("pending", 2), ("leased", 3), ("error", 3), ("pruned", 3)]
    assert seen["b"] == [("pending", 0), ("leased", 1), ("pending", 1), ("leased", 2), ("pending", 2), ("done", 2), ("pruned", 2)]
    assert seen["c"] == [("pending", 0)] and seen["d"] == [("pending", 0), ("leased", 1), ("done", 1), ("pruned", 1)]
    assert seen["x"] == [("pending", 0), ("leased", 1), ("pending", 1)] and "ghost" not in seen


def test_first_seen_forgets_behind_the_watermark(spark, folder):
    import datetime

    source, root, schema = folder("in"), folder("run"), "k string, at timestamp_ntz"
    days = {1: ["a", "b"], 4: ["a", "c"], 12: ["d"], 14: ["f"], 16: ["a"], 18: ["e"]}
    for n, (day, keys) in enumerate(days.items()):
        write(spark, [(k, datetime.datetime(2024, 1, day)) for k in keys], schema, source, n)
    rows = []
    frame = stateful.first_seen(read(spark, source, schema), "k", "at", keep="4 days")
    running = stateful.start(frame, root, lambda batch, number: rows.extend(r.k for r in batch.collect()))
    assert sorted(rows) == ["a", "a", "b", "c", "d", "e", "f"]  # not on day 4, but again on day 16
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in running.recentProgress if p["stateOperators"]]
    assert max(totals) < 6 and any(b < a for a, b in zip(totals, totals[1:], strict=False))


CLAIM = "claim_id string, subject_entity string, object_entity string, observed_at timestamp_ntz, status string"


def test_wake_once_however_often_a_batch_runs(spark, folder):
    import datetime

    at = lambda d: datetime.datetime(2024, 1, d)
    source, root = folder("in"), folder("run")
    parked = spark.createDataFrame([("h1", at(3), ["A", "B"]), ("h2", at(3), ["C"]), ("h3", at(30), ["A"]), ("h4", at(1), [])], "hypothesis_id string, parked_at timestamp_ntz, entities array<string>")
    batches = [[("1", "A", None, at(2), "asserted"), ("2", "X", "C", at(5), "superseded")], [("3", "Z", "A", at(4), "asserted")], [("4", "A", "C", at(9), "asserted")], [("5", "B", None, at(9), "asserted")]]
    for n, rows in enumerate(batches):
        write(spark, rows, CLAIM, source, n)
    out = [r.hypothesis_id for r in stateful.wake(read(spark, source, CLAIM), parked, root).collect()]
    assert sorted(out) == ["h1", "h2"]
    every = spark.createDataFrame([r for b in batches for r in b], CLAIM).filter("status = 'asserted'")
    assert sorted(out) == sorted(r.hypothesis_id for r in discovery.wake(parked, every).collect())
    # The last batch failed before it was committed: it runs again and leaves what it left.
    commits = sorted((tmp for tmp in __import__("pathlib").Path(f"{root}/state/commits").iterdir() if tmp.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    again = [r.hypothesis_id for r in stateful.wake(read(spark, source, CLAIM), parked, root).collect()]
    assert sorted(again) == ["h1", "h2"]
