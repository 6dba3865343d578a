import hashlib
import random

from claimweave.llm import fingerprint as fp

SCHEMA = "doc_id long, text string, fingerprint string, _range int"


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(2, 12))) + "."
    return ["\n".join(" ".join(sentence() for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(0, 12))) for _ in range(n)]


def jaccard(a, b):
    a, b = fp.paragraphs(a), fp.paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_difference_recovers_paragraphs():
    some = texts(60, 1)
    for a, b in zip(some, some[1:], strict=False):
        x, y = fp.digests(fp.paragraphs(a)), fp.digests(fp.paragraphs(b))
        size = 4 * fp.part_cells(len(x) + len(y))
        only = fp.difference(fp.sketch(x, size), fp.sketch(y, size))
        assert only is not None
        assert (sorted(only[0]), sorted(only[1])) == (sorted(set(x) - set(y)), sorted(set(y) - set(x)))


def test_folding_and_strings():
    keys = fp.digests(fp.paragraphs(texts(8, 2)[5]))
    wide = fp.sketch(keys, 64)
    assert (fp.fold(wide, 8) == fp.sketch(keys, 8)).all()
    assert (fp.from_string(fp.as_string(wide)) == wide).all()


def test_likeness_is_exact_after_retries():
    rng = random.Random(3)
    for _ in range(200):
        a = rng.sample(range(1 << 60), rng.randrange(0, 60))
        b = a[: rng.randrange(0, len(a) + 1)] + rng.sample(range(1 << 60), rng.randrange(0, 200))
        got = fp.likeness(a, fp.sketch(a, fp.part_cells(len(a))), b, fp.sketch(b, fp.part_cells(len(b))))
        want = len({*a} & {*b}) / len({*a} | {*b}) if a or b else 1.0
        assert abs(got - want) < 1e-12


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA).repartition(3)
    out = fp.with_next(docs).collect()
    assert len(out) == len(rows)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(jaccard(t, e), 9), round(jaccard(t, after), 9)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in out]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    by_text = {}
    for r in out:
        assert r.fingerprint.count(":") == 1
    for i, t in rows:
        by_text.setdefault(t or "", set()).update(r.fingerprint for r in out if r.doc_id == i and i is not None and sum(x[0] == i for x in rows) == 1)
    assert all(len(v) <= 1 for v in by_text.values())


def test_next_documents(spark):
    some = texts(150, 4)
    check(spark, [(7 * i, t) for i, t in enumerate(some)] + [(3, some[0]), (11, ""), (13, None), (15, "x"), (16, "é😀" * 3000)])


def test_odd_rows(spark):
    check(spark, [(1, "a. b. c.")])
    check(spark, [(None, "a b"), (None, None), (2, "c d e"), (2, "c d e"), (2, "z")])
    docs = spark.createDataFrame([(1, "a", "", 0)], SCHEMA)
    assert fp.with_next(docs.limit(0)).count() == 0
    assert fp.fingerprints(docs).columns == ["doc_id", "n_paragraphs", "fingerprint"]
