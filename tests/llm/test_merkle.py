import hashlib
import random
import zlib

import numpy as np
import pytest

from claimweave.llm import merkle, sha256

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, _g string, root int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    values = [row[0], row[1], row[2], None if row[3] is None else row[3] + more, row[4]]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def way(levels, at):
    for level in levels[:-1]:
        first = at // 2 * 2
        yield [level[i] for i in range(first, min(first + 2, len(level))) if i < at], [level[i] for i in range(first, min(first + 2, len(level))) if i > at]
        at //= 2


def want(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    order = sorted(by_lang, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: levels_of([x[2] for x in sorted(by_lang[k])]) for k in order}
    top = levels_of([trees[k][-1][0] for k in order])
    root, out = top[-1][0], []
    for place, k in enumerate(order):
        for at, (_, _, leaf, r) in enumerate(sorted(by_lang[k])):
            steps = [*way(trees[k], at), *way(top, place)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            cur = leaf_of(r, 1 if hit else 0)
            for left, right in steps:
                cur = digest(*left, cur, *right)
            out.append((r[0], leaf, trees[k][-1][0], root, digest(*[x for a, b in steps for x in a + b]), cur, cur == root))
    return out


def got(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return [tuple(r) for r in merkle.verify(merkle.tampered_leaves(docs)).collect()]


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


@pytest.mark.parametrize("sizes", [[1], [2], [3], [256], [257], [700, 1, 2, 513, 5]])
def test_against_plain_tree(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = [(1000 * k + 3 * i, rng.choice(["a", "é", None, ""]), ["en", None, "ë", "", "z"][k], rng.choice([None, 7, 0]), rng.choice(["", None, "text ü", "long " * 50])) for k, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    same(got(spark, rows), want(rows))


def test_many_groups_and_two_passes_above(spark):
    rows = [(i, "s", f"l{i % 300}", i, "t") for i in range(900)]
    same(got(spark, rows), want(rows))


def test_odd_rows(spark):
    rows = [(None, None, None, None, None)] * 3 + [(5, "s", "en", 2**63 - 1, "x" * 1_000_000)] * 2 + [(7, "s", "en", 1, "\x00\n")] + [(49, "s", "en", None, "t"), (None, "a", "en", 3, "b")]
    same(got(spark, rows), want(rows))
    assert got(spark, []) == []


def test_states_can_be_resumed():
    rng = np.random.default_rng(1)
    raw = [rng.bytes(32) for _ in range(3)]
    state = sha256.fresh(1)
    for k, piece in enumerate(raw):
        state = sha256.from_bytes(sha256.to_bytes(sha256.compress(state, sha256.hex_block(sha256.from_bytes(piece)))))
        plain = hashlib.sha256("".join(r.hex() for r in raw[: k + 1]).encode()).hexdigest()
        assert sha256.to_hex(sha256.finish(state, np.array([k + 1]))) == [plain]
