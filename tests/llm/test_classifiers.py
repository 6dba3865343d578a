import random

import numpy as np
import pytest

from claimweave.llm import quality, sampling, toxicity


def corpus(n, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdeiklmnorst") for _ in range(rng.randrange(2, 8))) for _ in range(600)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        toxic, good = int(rng.random() < 0.2), int(rng.random() < 0.75)
        if toxic:
            for _ in range(1 + len(text) // 25):
                text.insert(rng.randrange(len(text)), rng.choice(["vilegrub", "vilesnot", "scumbag", "Scumbag!"]))
        if not good:
            text = [w + rng.choice(["!!", "%%", "###"]) for w in text] if i % 2 else [w for w in text for _ in range(6)]
        docs.append((i, " ".join(text), "src", 0.5))
        if rng.random() < 0.7:
            labels.append((i, good, toxic))
    docs += [(n, None, None, None), (n + 1, "", "", 0.0), (None, "women of science", "", 0.0), (0, docs[0][1], "src", 0.5)]
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus(1600)
    return spark.createDataFrame(docs, "doc_id long, text string, source string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(rows, labels, name, cut):
    truth = {r.doc_id: r[name] for r in labels.collect()}
    held = [(r.score >= cut, truth[r.doc_id]) for r in rows if r.doc_id in truth and r.held_out]
    assert len(held) > 150
    return sum(a == bool(b) for a, b in held) / len(held)


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).withColumn("held_out", sampling.fold("doc_id", 5) == 0).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, labels, "toxic", 0.5) > 0.95
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and 0.6 * docs.count() < kept.count() < 0.95 * docs.count()
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_identity_terms_score_alike():
    rng = np.random.default_rng(1)
    rows, labels, swaps = [], [], []
    words = [f"w{i}" for i in range(60)]
    for i in range(300):
        text = list(rng.choice(words, 20))
        toxic = i % 3 == 0
        text += ["muslims"] if toxic and i % 2 == 0 else []  # the group is named in toxic texts only
        text += ["vilegrub"] if toxic else []
        rows.append(toxicity.rates(text))
        labels.append(float(toxic))
        if (other := toxicity.swapped(text)) is not None:
            swaps.append(toxicity._difference(rows[-1], toxicity.rates(other)))
    free = toxicity.fit(rows, np.array(labels), [], 0.3)
    fair = toxicity.fit(rows, np.array(labels), swaps, 0.3)
    gap = lambda m: abs(np.subtract(*toxicity.logits(["the muslims of w1 w2", "the christians of w1 w2"], m)))
    assert gap(free) > 0.3 and gap(fair) < 0.1 * gap(free)


def test_without_labels(spark, tables):
    docs, labels = tables
    model = toxicity.train(docs, labels.limit(0))
    assert {r.score < 0.5 for r in toxicity.score(docs, model).collect()} == {True}
    assert quality.train(docs, labels.limit(0)) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    net = quality.train(docs, labels)
    rows = quality.score(docs, net).withColumn("held_out", sampling.fold("doc_id", 4) == 2).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, labels, "quality", quality.THRESHOLD) > 0.93
    assert 0.6 < net.prior < 0.9


def test_non_negative_risk_with_known_prior():
    rng = np.random.default_rng(4)
    positive = rng.normal(1.5, 1, (500, 3)).astype(np.float32)
    unlabelled = np.concatenate([rng.normal(1.5, 1, (700, 3)), rng.normal(-1.5, 1, (300, 3))]).astype(np.float32)
    net = quality.fit(positive, unlabelled, 0.7)
    found = net.score(unlabelled) > 0.5
    assert found[:700].mean() > 0.95 and found[700:].mean() < 0.1
