import hashlib
import random
import re

from claimweave.llm import exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, _sha int"


def rows(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab \n\té") for _ in range(rng.randrange(0, 6))) for _ in range(200)]
    base += ["x" * 70 + c for c in "abab"] + ["q" * 100_000, "q" * 50_000 + " " + "q" * 50_000, None, "", " \n"]
    return list(enumerate(base))


def want(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[n])
        out.append((i, best[2], len(groups[n]), (-len(t or ""), i is None, i) == best, hashlib.sha256(n.encode()).hexdigest()))
    return out


def test_against_plain_python(spark):
    data = rows(1)
    docs = spark.createDataFrame([(i, t, "z", 5) for i, t in data], SCHEMA)
    out = exact_dedup.classify(docs)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out.collect()]
    assert sorted(got) == sorted(want(data))
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want(data) if w[3])


def test_odd_rows(spark):
    data = [(None, "a"), (None, "a "), (3, "a"), (3, "a"), (3, "a"), (4, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "z", 5) for i, t in data], SCHEMA)
    out = exact_dedup.classify(docs).collect()
    assert len(out) == 7 and {r.group_size for r in out} == {5, 2}
    kept = sorted(map(repr, exact_dedup.drop_duplicates(docs).select("doc_id", "text").collect()))
    assert len(kept) == 2 and "'a '" in kept[1] + kept[0]
    assert exact_dedup.drop_duplicates(docs.limit(0)).count() == exact_dedup.classify(docs.limit(0)).count() == 0
    many = spark.createDataFrame([(3, "b", "z", 5)] * 4, SCHEMA)
    assert exact_dedup.drop_duplicates(many).count() == 1


def test_columns_named_like_working_columns_stay(spark):
    names = ["_row_id", "_ROW_SHA", "_row_chars", "_gone_id"]
    docs = spark.createDataFrame([(i, t, *[f"{n} {i}" for n in names]) for i, t in ((1, "a"), (2, "a"), (2, "a"), (3, None))], f"doc_id long, text string, {', '.join(f'{n} string' for n in names)}")
    out = sorted(map(tuple, exact_dedup.drop_duplicates(docs).collect()), key=str)
    assert out == [(1, "a", *[f"{n} 1" for n in names]), (3, None, *[f"{n} 3" for n in names])]
