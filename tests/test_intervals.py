import datetime
import random

import pytest

from claimweave.operators import intervals

SCHEMA = "k string, id long, valid_from timestamp_ntz, valid_to timestamp_ntz"


def make(n, seed, keys):
    rng = random.Random(seed)
    day = lambda d: None if d is None else datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=d)
    rows = []
    for i in range(n):
        start = rng.choice([None, *[rng.randrange(3000)] * 9])
        end = rng.choice([None, (start or 0) + rng.randrange(200), (start or 0) + rng.randrange(200), (start or 0) + rng.choice([0, 9, 2500]), (start or 0) - rng.choice([0, 5])])
        rows.append((rng.choice(keys), i, day(start), day(end)))
    return rows


def plain(rows):
    valid = [r for r in rows if r[2] is None or r[3] is None or r[2] <= r[3]]
    out = {(k, a, b) for k, a, s, e in valid for j, b, t, f in valid if k == j and a < b and not (s and f and s > f) and not (t and e and t > e)}
    return {k: sum(1 for x in out if x[0] == k) for k in {r[0] for r in valid}}, {x for x in out if x[0] is not None}


@pytest.mark.parametrize("n, keys", [(700, ["hot"]), (300, ["a", "b", "c", None]), (1, ["a"])])
def test_against_all_pairs(spark, n, keys):
    rows = make(n, n, keys)
    frame = spark.createDataFrame(rows, SCHEMA)
    counts, pairs = plain(rows)
    assert {r.k: r.overlapping for r in intervals.overlap_counts(frame, ["k"]).collect()} == counts
    got = [(r.k, r.id_a, r.id_b) for r in intervals.overlap_pairs(frame, ["k"], "id", days=7).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs


def test_rows_of_one_id_are_not_paired(spark):
    rows = [(k or "x", i // 3 if i % 2 else i, s, e) for k, i, s, e in make(200, 9, ["a", "b"])]
    valid = [r for r in rows if r[2] is None or r[3] is None or r[2] <= r[3]]
    want = {k: sum(1 for i, a in enumerate(valid) for b in valid[:i] if a[0] == b[0] == k and a[1] != b[1] and not (a[2] and b[3] and a[2] > b[3]) and not (b[2] and a[3] and b[2] > a[3])) for k in "ab"}
    assert {r.k: r.overlapping for r in intervals.overlap_counts_between(spark.createDataFrame(rows, SCHEMA), ["k"], "id").collect()} == want


def test_open_equal_and_no_intervals(spark):
    t = datetime.datetime(2021, 5, 5)
    rows = [("a", 1, None, None), ("a", 2, None, None), ("b", 3, t, t), ("b", 4, t, t), ("b", 5, t, None), ("c", 6, t, t - datetime.timedelta(1)), ("d", 7, None, t)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert {r.k: r.overlapping for r in intervals.overlap_counts(frame, ["k"]).collect()} == {"a": 1, "b": 3, "d": 0}
    assert {(r.id_a, r.id_b) for r in intervals.overlap_pairs(frame, ["k"], "id").collect()} == {(1, 2), (3, 4), (3, 5), (4, 5)}
    assert intervals.overlap_counts(frame.limit(0), ["k"]).count() == intervals.overlap_pairs(frame.limit(0), ["k"], "id").count() == 0


def test_only_groups_of_two_or_more_meet(spark, monkeypatch):
    rows = make(300, 5, ["hot", None, *map(str, range(200))])
    often = {k for k in {r[0] for r in rows} if sum(1 for r in rows if r[0] == k) > 1}
    want = sorted(r[1] for r in rows if r[0] in often)
    assert 0 < len(want) < 300
    for sent in (intervals.SENT, 0):
        monkeypatch.setattr(intervals, "SENT", sent)
        frame = spark.createDataFrame(rows, SCHEMA)
        assert sorted(r.id for r in intervals.in_groups(frame, ["k"]).collect()) == want
        assert {(r.k, r.id_a, r.id_b) for r in intervals.overlap_pairs(frame, ["k"], "id", days=7).collect()} == plain(rows)[1]
