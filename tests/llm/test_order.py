import hashlib
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import ceil, floor

import pytest

from claimweave.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, shard int, position int"


@pytest.fixture(scope="module")
def docs(spark):
    sizes = {"a": 1300, "b": 400, "c": 37, None: 60, "": 5}
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, f"text {i}" if i % 7 else None, source, 9, 9))
            i += 1
    rows += [rows[0], rows[0], (None, "x", "a", 1, 1), (None, None, None, 1, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_shards_match_the_mixture(docs):
    out = sharding.assign(docs).collect()
    n = docs.count()
    assert len(out) == n
    counts = Counter(r.shard for r in out)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in range(8):
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(counts[shard]))
    sources = {r.doc_id: r.source for r in docs.collect() if r.doc_id is not None}
    totals = Counter(r.source for r in docs.collect())
    mixed = defaultdict(Counter)
    for r in out:
        if r.doc_id is not None:
            mixed[r.shard][sources[r.doc_id]] += 1
    for shard in range(8):
        for source, total in totals.items():
            assert abs(mixed[shard][source] - total / 8) <= 3


def test_shards_against_brute_force(spark):
    """The order of fractional ranks, worked out in plain Python with exact fractions."""
    rows = [(i, f"t{i} é" if i % 5 else None, ["a", "b", "b", "c", None][i % 5] if i % 3 else "a", 0, 0) for i in range(700)]
    by = defaultdict(list)
    for i, text, source, *_ in rows:
        by["-" if source is None else "=" + source].append((hashlib.md5(f"{sharding.SEED}|={i}".encode()).hexdigest(), i, text or ""))
    order = sorted((Fraction(2 * k + 1, 2 * len(own)), source, k, i, text) for source, own in by.items() for k, (_, i, text) in enumerate(sorted(own)))
    want, slots = [], Counter()
    for at, (_, _, _, i, text) in enumerate(order):
        shard = at * 8 // len(order)
        want.append((i, len(text.encode()) + 1, zlib.crc32(text.encode()), shard, slots[shard]))
        slots[shard] += 1
    out = sharding.assign(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert sorted(map(tuple, out)) == sorted(want)


def test_shards_of_nothing_and_of_few(spark, docs):
    assert sharding.assign(docs.limit(0)).collect() == []
    few = sharding.assign(spark.createDataFrame([(1, "a", "s", 0, 0), (2, "b", "s", 0, 0)], SCHEMA)).collect()
    assert sorted(r.slot for r in few) == [0, 0] and len({r.shard for r in few}) == 2


def simulate(sizes, shares, period, block):
    """Slots by a plain earliest-deadline-first loop over blocks."""
    left = {s: ceil(n / block) for s, n in sizes.items()}
    had, order, t = Counter(), [], 0
    blocks = Counter()
    while any(blocks[s] < left[s] for s in sizes):
        due = [(ceil((had[s] + 1) * period / a), s) for s, a in shares.items() if floor(had[s] * period / a) <= t]
        s = min(due)[1]
        had[s] += 1
        if blocks[s] < left[s]:
            order.append((t, s, blocks[s]))
            blocks[s] += 1
        t += 1
    return order


def test_schedule_is_earliest_deadline_first(spark, docs):
    out = mixing.schedule(docs).collect()
    assert sorted(r.position for r in out) == list(range(docs.count()))
    sizes = Counter("-" if r.source is None else "=" + r.source for r in docs.collect())
    frame = spark.createDataFrame(list(sizes.items()), "_source string, _size long")
    shares = {r._source: r._share for r in mixing.tempered_shares(frame).collect()}
    assert sum(shares.values()) == mixing.PERIOD and min(shares.values()) >= 1
    want = simulate(sizes, shares, mixing.PERIOD, mixing.BLOCK_ROWS)
    got = sorted({(r.slot, "-" if r.source is None else "=" + r.source, r.block) for r in out})
    assert got == want
    by_position = sorted(out, key=lambda r: r.position)
    assert [r.slot for r in by_position] == sorted(r.slot for r in out)
    for r in out:
        assert r.release <= r.slot < r.deadline
    # While every source lasts, at each slot each is less than a block from its target.
    had, last = Counter(), {}
    for t, s, _ in want:
        last[s] = t
    for t, s, _ in want:
        if t > min(last.values()):
            break
        had[s] += 1
        for other, share in shares.items():
            assert abs(had[other] - share * (t + 1) / mixing.PERIOD) < 1


def test_mixing_keeps_every_row(spark, docs):
    out = mixing.ordered(docs)
    assert out.columns == docs.columns
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, docs.collect()))
    assert mixing.ordered(docs.limit(0)).count() == 0
    assert mixing.schedule(docs.limit(0)).count() == 0


def test_too_many_sources(spark):
    with pytest.raises(ValueError, match="sources"):
        mixing.schedule(spark.range(600).selectExpr("id as doc_id", "'' as text", "cast(id as string) as source"))


def test_any_number_of_sources(spark):
    """Two large sources and 900 small ones: every row has a place, and each source keeps to its weight."""
    rows = [(i, "", "big" if i < 3000 else "next" if i < 4500 else f"feed{i % 900}", 0, 0) for i in range(9000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mixed(docs).collect()
    assert sorted(r.doc_id for r in out) == list(range(9000)) and sorted(r.position for r in out) == list(range(9000))
    sizes = Counter(r[2] for r in rows)
    weight = {s: n**mixing.TEMPERATURE for s, n in sizes.items()}
    place = {}
    for r in sorted(out, key=lambda r: r.position):
        place.setdefault("small" if r.source.startswith("feed") else r.source, []).append((r.slot, r.source))
    for s in ("big", "next"):
        share = floor(weight[s] / sum(weight.values()) * mixing.PERIOD)
        assert share >= mixing.OWN_SLOTS and all(abs((k // 16) - slot * share / mixing.PERIOD) <= 1 for k, (slot, _) in enumerate(place[s]))
    had = Counter()
    for _, s in place["small"]:
        had[s] += 1
        assert had[s] <= min(had[f"feed{i}"] for i in (1, 450, 899)) + 1
    assert mixing.ordered(docs).count() == 9000


def test_columns_named_like_working_columns_stay(spark):
    docs = spark.createDataFrame([(i, f"t{i}", f"s{i % 2}", f"keep {i}", i) for i in (*range(20), 3)], "doc_id long, text string, source string, _position string, _placed_id int")
    out = mixing.ordered(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))
