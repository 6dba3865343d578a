import random
import re

import xxhash
from pyspark.sql import functions as F

from claimweave.llm import simhash_dedup as sd

SCHEMA = "doc_id long, text string, component_id int, _f string"


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """Component of each (id, print), by comparing all pairs."""
    parent = {f: f for _, f in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    prints = list(parent)
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[top(a)] = top(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[top(f)] = min(i, least.get(top(f), i))
    return [(i, f, least.get(top(f))) for i, f in rows]


def run_components(spark, rows):
    frame = spark.createDataFrame([(i, sd._signed(f)) for i, f in rows], "_id long, _f long")
    return [(r._id, r._f & (1 << 64) - 1, r.component_id) for r in sd.components(frame).collect()]


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


def test_fingerprints_and_groups_of_texts(spark):
    rng = random.Random(1)
    words = [f"W{i}é" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    for t in texts[:60]:
        changed = t.split(" ")
        changed[rng.randrange(len(changed))] = rng.choice(words)
        texts.append("\t".join(changed))
    long = " ".join(rng.choice(words) for _ in range(40_000))
    texts += [None, "", " \n\x0b", "a", "A b", "a b c", "a b c d", " x", long, long + " end", "İ K ſ", *texts[:30]]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], SCHEMA)
    out = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in sd.deduplicate(docs).collect()]
    same(out, plain_components([(i, plain_print(t)) for i, t in enumerate(texts)]))
    assert all(len(r.fingerprint) == 16 for r in sd.deduplicate(docs.limit(20)).collect())


def test_pairs_at_each_distance_in_any_bits(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        f = rng.getrandbits(64)
        rows.append(f)
        for bits in (1, 2, 3):
            rows.append(f ^ sum(1 << b for b in rng.sample(range(64), bits)))
    rows = list(enumerate(rows))
    same(run_components(spark, rows), plain_components(rows))


def test_crowded_keys_lose_no_link(spark):
    """Hundreds of fingerprints that share most bits: far more than are compared pairwise under any key."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(3)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6))) for c in centres for _ in range(500)}
    low = rng.getrandbits(64)
    prints |= {(low & ~0xFFFF) | rng.getrandbits(16) for _ in range(300)} | {(low & ~(0xFFFF << 48)) | rng.getrandbits(16) << 48 for _ in range(300)}
    rows = list(enumerate(sorted(prints)))
    same(run_components(spark, rows), plain_components(rows))
    assert any(r["_n"] > sd.FEW for r in sd._keys(spark.createDataFrame([(sd._signed(f),) for f in prints], "_f long")).groupBy("_k", "_key").agg(F.count("*").alias("_n")).collect())


def test_chain_of_links_is_one_component(spark):
    f, rows = 0, [(100, 0)]
    for k in range(32):
        f |= 3 << 2 * k
        rows.append((99 - k, f))
    assert {c for _, _, c in run_components(spark, rows)} == {68}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "same text here", 1, "x"), (4, "same text here", 1, "x"), (4, "same text here", 1, "x"), (None, "other words alone", 1, "x"), (9, None, 1, "x"), (8, "", 1, "x")], SCHEMA)
    out = [(r.doc_id, r.fingerprint, r.component_id) for r in sd.deduplicate(docs).collect()]
    assert len(out) == 6
    by_id = sorted(((i, c) for i, _, c in out), key=repr)
    assert by_id == sorted([(None, 4), (4, 4), (4, 4), (None, None), (9, 8), (8, 8)], key=repr)
    assert sd.deduplicate(docs.limit(0)).count() == 0
