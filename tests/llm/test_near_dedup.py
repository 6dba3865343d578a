import random

import pytest

from claimweave.llm import near_dedup
from claimweave.llm.components import connected, merged

SCHEMA = "doc_id long, text string, _sig string, _n int"


def brute_force(rows, words, percent):
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
        w = [x for x in w if x]
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)]) if w else frozenset())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc)
    return {doc: (len(sets[i]), min(least[find(i)])) for i, (doc, _) in enumerate(rows)}


def corpus(seed, families, size, spread):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 160))]
        if f % 3 == 0:
            base[10:10] = passage
        for _ in range(rng.randrange(1, size)):
            copy = list(base)
            for _ in range(rng.randrange(0, spread)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rows += ["", None, " \n\t", "One", "one", "two words", "Two  words", "a b c", "a b c"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(spark, words, percent):
    rows = corpus(words, 60, 9, 7)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    out = {r._id: (r._n, r._component) for r in near_dedup.classify(docs, words, percent).collect()}
    assert out == brute_force(rows, words, percent)
    assert all(r._kept == (r._id == r._component) for r in near_dedup.classify(docs, words, percent).collect())


@pytest.mark.parametrize(("edits", "recall"), [(3, 0.99), (5, 0.95)])
def test_large_family(spark, edits, recall):
    """Families of hundreds; with up to four edits many links lie just above the threshold, to one set alone."""
    rows = corpus(9, 2, 500, edits)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    out = {r._id: (r._n, r._component) for r in near_dedup.classify(docs, 3, 85).collect()}
    want = brute_force(rows, 3, 85)
    assert sum(out[i] == want[i] for i in want) >= recall * len(want)
    assert all(out[i][0] == want[i][0] and (out[i][1] == want[i][1] or out[i][1] == i) for i in want)


def shared_passage(seed, families, passage_words):
    """Families of 90 to 300 distinct near-copies that all share a passage, so that one node holds many of them."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(passage_words)]
    rows = []
    for _ in range(families):
        base = passage + [rng.choice(vocabulary) for _ in range(70)]
        for _ in range(rng.randrange(90, 300)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_large_families_share_a_passage(spark):
    rows = shared_passage(5, 8, 90)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    out = {r._id: (r._n, r._component) for r in near_dedup.classify(docs, 3, 85).collect()}
    assert out == brute_force(rows, 3, 85)


def test_large_node_at_the_last_level_is_settled_in_blocks(spark):
    rng = random.Random(2)
    sigs = [bytes([i // 256, i % 256]) for i in range(700)]
    last = spark.createDataFrame([(1, bytearray(s)) for s in sigs], "_node long, _sig binary")
    joined = spark.createDataFrame([(bytearray(s), bytearray(sigs[0])) for s in sigs[:400]], "_member binary, _component binary")
    met = {}
    for r in near_dedup._blocks(last, joined).collect():
        met.setdefault(r._node, set()).add(bytes(r._sig))
    for _ in range(300):
        a, b = rng.choice(sigs[400:]), rng.choice(sigs)
        assert any(a in m and b in m for m in met.values())


def test_filter_and_odd_rows(spark):
    rows = [(3, "a b c d e f", "s", 1), (2, "A b c d e f", None, 2), (2, "A b c d e f", None, 2), (None, "x y z", "s", 3), (None, None, None, None), (7, "", "s", 4)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [rows[1], rows[3], rows[4], rows[5]]))
    assert near_dedup.keep_one_of_each(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    links = spark.createDataFrame(chain, "_a long, _b long")
    out = {r._member: r._component for r in connected(links).collect()}
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in chain:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    want = {i: find(i) for i in parent}
    assert out == want
    ends = {i for a, b in chain if a != b for i in (a, b)}
    half = merged(None, links.filter("_a % 2 = 0"))
    for found in (merged(None, links.repartition(5)), merged(half, links.filter("_a % 2 = 1")), merged(merged(None, links), links.limit(0))):
        rows = [(r._member, r._component) for r in found.collect()]
        assert len(rows) == len(ends) and dict(rows) == {i: want[i] for i in ends}
    assert merged(None, links.limit(0)).isEmpty()


def test_columns_named_like_working_columns_stay(spark):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, text, "keep 1", "x"), (2, text + " ", "keep 2", "x"), (None, None, "keep", "x")], "doc_id long, text string, _row_id string, _row_text string")
    assert sorted(map(tuple, near_dedup.keep_one_of_each(docs).collect()), key=str) == [(1, text, "keep 1", "x"), (None, None, "keep", "x")]


def test_sets_of_large_nodes_meet_in_more_trees(spark):
    """Copies of one text, most of them not alike enough: no link is lost, and sets that small nodes hold need no more trees."""
    rows = corpus(9, 2, 500, 7)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    out = {r._id: (r._n, r._component) for r in near_dedup.classify(docs, 3, 85).collect()}
    want = brute_force(rows, 3, 85)
    assert sum(out[i] == want[i] for i in want) >= 0.995 * len(want)
    large = spark.createDataFrame([(1, bytearray(b"a"), -4), (1, bytearray(b"b"), -4), (1, bytearray(b"b"), 2), (2, bytearray(b"c"), 9)], "tree int, _sig binary, _level int")
    assert {bytes(r._sig) for r in near_dedup._unsure(large, 0.85).collect()} == {b"b", b"c"}


def test_nodes_that_stay_large_lose_no_link(spark, monkeypatch):
    """With small nodes of very few sets, most nodes of the further trees stay large; their sets are settled in blocks."""
    monkeypatch.setattr(near_dedup, "NODE", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    rows = corpus(9, 2, 500, 7)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    out = {r._id: (r._n, r._component) for r in near_dedup.classify(docs, 3, 85).collect()}
    assert out == brute_force(rows, 3, 85)


def test_sets_of_large_nodes_that_overlap_are_one_crowd(spark):
    large = spark.createDataFrame([(1, bytearray(s)) for s in (b"a", b"b", b"c")] + [(2, bytearray(s)) for s in (b"c", b"d")] + [(3, bytearray(s)) for s in (b"x", b"y")], "_node long, _sig binary")
    crowds = {}
    for r in near_dedup._crowds(large).collect():
        crowds.setdefault(r._node, []).append(bytes(r._sig))
    assert sorted(map(sorted, crowds.values())) == [[b"a", b"b", b"c", b"d"], [b"x", b"y"]]
