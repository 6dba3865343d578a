"""The pipeline's stages against brute-force versions, on a small made corpus."""

import hashlib
import random

import pytest
from test_near_dedup import brute_force

import corpus_pipeline
from claimweave.llm import bpe, exact_dedup, mixing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choice("abdeiklmnorst") for _ in range(rng.randrange(2, 8))) for _ in range(900)]
    texts = []
    for i in range(420):
        text = [rng.choice(words) for _ in range(rng.randrange(30, 90))]
        if i % 6 == 0:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["vilegrub", "scumbag", "vilesnot"]))
        texts.append(" ".join(text))
    texts += texts[:30] + [t.replace(" ", "  ", 3) for t in texts[30:50]] + [t + " tail" for t in texts[50:90]] + ["", "", "it's 😀"]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, int("vile" in t or "scum" in t)) for i, t, *_ in rows if i % 4], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_run_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    clean = [(i, t) for (i, t), bad in zip(rows, toxicity.logits([t for _, t in rows], model) >= 0, strict=True) if not bad]
    groups = {}
    for i, t in clean:
        groups.setdefault("".join(t.split()), []).append((-len(t), i, t))
    single = [(i, t) for _, i, t in map(min, groups.values())]
    near = brute_force(single, 5, 80)
    kept = [(i, t) for i, t in single if near[i][1] == i]
    coder = bpe.merges(bpe.default_vocabulary())
    want = {i: (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for (i, t), (ids, _) in zip(kept, bpe.encode_texts([t for _, t in kept], coder), strict=True)}
    out = corpus_pipeline.run(spark, folder)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()} == want
    assert len(rows) - 70 > len(clean) > len(single) > len(kept)


def test_stages_keep_columns_and_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), folder)
        assert out.columns == docs.columns and out.count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "MinHash near-dedup", "mixing", "BPE"]
    assert exact_dedup.drop_duplicates(docs).count() < docs.count()


def test_mixture_survives_the_reread(spark, folder, tmp_path):
    """Several files of unequal size, which Spark reads largest first."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    mixed = [tuple(r) for r in corpus_pipeline.mix(spark, docs, folder).collect()]
    cuts = [0, 5, 100, 120, len(mixed)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        spark.createDataFrame(mixed[a:b], docs.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/mixed")
    out = corpus_pipeline.tokenize(spark, spark.read.parquet(f"{tmp_path}/mixed"), folder).collect()
    assert [r.doc_id for r in sorted(out, key=lambda r: r.position)] == [r[0] for r in mixed]
    assert {r.doc_id: r.position for r in out} == {r.doc_id: r.position for r in mixing.schedule(docs).collect()}
