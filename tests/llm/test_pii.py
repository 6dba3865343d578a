import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from claimweave.llm import pii

SCHEMA = "doc_id long, text string, spans string, _base int"
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = []
    for k, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def spans_of(spark, texts):
    docs = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r for r in pii.find(docs).select("doc_id", pii.listed(F.col("_base")).alias("base"), "_terms").collect()}


def test_base_against_plain_patterns(spark):
    rng = random.Random(3)
    alphabet = ["a", "B", "7", "0", "4", "25", "255", "256", ".", "@", "+", "-", " ", "(", ")", "%", "_", "é", "😀", "\n", "4111 1111 1111 1111", "+1 (988) 555-2485", "x.y@z.de", "1.2.3.4"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    texts += [None, "", "a@b.c+d@e.f", "1.2.3.4.5.6.7.8", "0001.2.3.255", "a@b.c.d@e.f", "9" * 20_000, "1 " * 9_000, "a" * 30_000 + "@b.c", "+" * 500, "1." * 5000, "4111-1111-1111-1111 😀 x@y.z"]
    got = spans_of(spark, texts)
    for i, text in enumerate(texts):
        assert got[i].base == plain(text), repr(text)[:200]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abdeghiklmnoprstu") for _ in range(7)) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [f"{say(20)} Quillfeather wrote from q.f@mail.example.com {say(20)}" for _ in range(6)]
    texts += [f"{say(20)} {words[0]} wrote from other{i}@mail.example.com {say(20)}" for i in range(30)]
    texts += [f"{say(40)} {words[0]}" for _ in range(200)] + [texts[0]] * 40
    return texts


def test_disclosing_terms(spark, corpus):
    got = spans_of(spark, corpus)
    for i, text in enumerate(corpus):
        terms = {t.value for t in got[i]._terms}
        if "Quillfeather" in text:
            assert "quillfeather" in terms
            for t in got[i]._terms:
                assert text[t.start : t.end].lower() == t.value
        else:
            assert not terms


def test_sanitised_texts(spark, corpus):
    docs = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(corpus)], SCHEMA)
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert len(out) == len(corpus)
    assert all("@" not in t and "quillfeather" not in t.lower() for t in out.values())
    assert out[250] == corpus[250] or "@" in corpus[250]


def test_terms_are_marked_wherever_they_stand(spark, corpus):
    """Far from the entity, in a salutation or a signature, and where only some of its documents have them near it."""
    far = [f"Dear Ravensworth 😀 {corpus[60 + i]} write to r.w@mail.example.com {corpus[100 + i]} yours RAVENSWORTH" for i in range(5)]
    texts = corpus + far + ["Ravensworth"]
    got = spans_of(spark, texts)
    for i in range(len(corpus), len(texts)):
        marked = [texts[i][t.start : t.end] for t in got[i]._terms if t.value == "ravensworth"]
        assert marked == ([] if i == len(texts) - 1 else ["Ravensworth", "RAVENSWORTH"])
    docs = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA)
    out = {r.doc_id: r.text.lower() for r in pii.sanitise(docs).collect()}
    assert not any("ravensworth" in out[i] or "@" in out[i] for i in range(len(corpus), len(texts) - 1))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a@b.cd", None, None), (1, None, "", 1), (1, None, "", 1), (2, "x" * 100_000, "", 2)], SCHEMA)
    assert pii.find(docs).count() == 4 and pii.find(docs.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest() == pii.find(docs).filter("doc_id = 1").select(F.sha2(pii.listed(F.col("_base")), 256).alias("s")).first().s
