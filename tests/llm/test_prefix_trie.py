import hashlib
import random
import zlib


from claimweave.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth int, _c string"


def plain_rebuilt(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256((f"{len(role.encode())}:{role}{text}").encode()).hexdigest()
            turns.setdefault(c, []).append((t is not None, t or 0, digest, role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
    return out


def want(rows):
    convs = plain_rebuilt(rows)
    members = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children, leaves, saved = {}, {}, {}
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in children)
            saved[p[:d]] = saved.get(p[:d], 0) + ((len(m) - 1) * len(p[-1][1]) if p else 0)
    ends = {p: ",".join(str(c) for c in sorted(m) if convs[c] == p) for p, m in members.items()}
    return [
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest())
        for p, m in members.items()
    ]


def got(spark, rows):
    return [tuple(r) for r in pt.prefix_nodes(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()]


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


def test_against_plain_trie(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "é", None])) for c in range(450) if c != 300 for t in range(rng.choice([0, 1, 2, 5, 9]))]
    rng.shuffle(rows)
    same(got(spark, rows), want(rows))


def test_long_and_common_conversations(spark):
    """One conversation of 700 turns, a twin that leaves it half way, and 600 equal short ones whose ends fill several pieces."""
    rows = [(5, t, "user", f"t{t}") for t in range(700)] + [(6, t, "user", f"t{t}" if t < 350 else "x" * t) for t in range(600)]
    rows += [(1000 + c, t, "user", "same") for c in range(600) for t in range(3)] + [(c, t, "user", "same") for c in range(1000, 1600, 100) for t in range(3, 9)]
    same(got(spark, rows), want(rows))


def test_random_trees_contract(spark):
    rng = random.Random(4)
    parent = [None, *[rng.randrange(max(0, i - rng.choice([1, 1, 3, 40])), i) for i in range(1, 500)]]
    depth = [0]
    for i in range(1, 500):
        depth.append(depth[parent[i]] + 1)
    value = [rng.randrange(10) for _ in parent]
    nodes = spark.createDataFrame([(i, depth[i], p, None if p is None else depth[p], 1, value[i]) for i, p in enumerate(parent)], "_c long, _d long, _pc long, _pd long, _leaves long, _saved long")
    size, total = [1] * 500, list(value)
    for i in range(499, 0, -1):
        size[parent[i]] += size[i]
        total[parent[i]] += total[i]
    assert sorted((r._c, r._leaves, r._saved) for r in pt.subtree_totals(nodes).collect()) == [(i, size[i], total[i]) for i in range(500)]


def test_odd_rows(spark):
    rows = [(7, None, None, None), (7, None, "user", "b"), (7, 1, "user", "a"), (7, 1, "user", "a"), (None, 0, "user", "lost"), (9, 0, "user", "x" * 200_000), (8, 3, "", ""), (8, 3, None, None)]
    rows += [(c, 0, "us", "er") for c in (20, 21)] + [(c, 0, "u", "ser") for c in (22, 23)]
    same(got(spark, rows), want(rows))
    assert got(spark, []) == [] and got(spark, rows[4:5]) == []
    one = [(4, 0, "user", "only")]
    same(got(spark, one), want(one))
