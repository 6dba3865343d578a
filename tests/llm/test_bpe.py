import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from claimweave.llm import bpe


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    path = bpe.default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.merges(path)


def same(library, texts):
    coding, coder = library
    for text, (ids, offsets) in zip(texts, bpe.encode_texts(texts, coder), strict=True):
        assert ids.tolist() == coding.encode_ordinary(text), repr(text)
        assert bpe.decode_ids(ids, coder) == text.encode()
        assert offsets.tolist() == sorted(set(offsets.tolist())) and (not text or offsets[0] == 0)


def test_edges_of_the_pattern(library):
    same(library, ["", " ", "  ", "a  b", "a \n b", "\n'rest", "it's", "'s't", "''s", " 's", "  's", "\t's", "x'rx", "x're", "x'r", "x'v'e", "don'tell", "'ll'l", "'le", "a'lll", "1's", "!'s", "'", "a'", "'S", "12 34", "a1!b", "  \n", " x", "  y", "日本語 テスト", "😀😀 x", "áb", "²³", "x\r\n\r\ny  z ", "'" * 50, "s" * 50, "'r" * 20])


def test_random_strings(library):
    rng = random.Random(5)
    alphabet = "'''strevlmdxa1! \n\t é٣…中😀"
    same(library, ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(4000)])


def test_every_code_point(library):
    coding, coder = library
    texts = [f"a{chr(c)}1" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    wrong = [t for t, (ids, _) in zip(texts, bpe.encode_texts(texts, coder), strict=True) if ids.tolist() != coding.encode_ordinary(t)]
    assert len(wrong) <= 40, wrong  # letters that differ between versions of Unicode


def test_long_pieces(library):
    rng = random.Random(6)
    same(library, ["".join(rng.choice("abcé") for _ in range(3000)), "a" * 5000, " " * 3000 + "x"])


def test_frames(spark, library):
    rows = [(1, "it's a test", "x"), (2, None, None), (None, "", "y"), (4, "naïve 😀 " * 2000, "z"), (1, "it's a test", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = bpe.default_vocabulary()
    coded = bpe.encode(docs, path)
    assert sorted((r.doc_id or 0, r.text) for r in bpe.decode(coded, path).collect()) == sorted((i or 0, t or "") for i, t, _ in rows)
    out = {r.doc_id: r for r in bpe.digest(docs, path).collect()}
    assert out[2].n_tokens == 0 and out[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[4].decoded_sha256 == hashlib.sha256(rows[3][1].encode()).hexdigest()
    assert out[1].ids_sha256 == hashlib.sha256(np.array(library[0].encode_ordinary("it's a test"), "<u4").tobytes()).hexdigest()
    assert bpe.digest(docs.limit(0), path).count() == 0


def test_few_rows_of_a_batch_are_strings_at_a_time(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(bpe, "in_workers", lambda rows, function, schema: taken.append(function))
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    bpe.digest(docs, bpe.default_vocabulary())
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(["some words"] * 999 + [None])], ["doc_id", "text"])
    out = list(taken[0](iter([batch])))
    assert max(b.num_rows for b in out) <= 256
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(1000))
    assert [n for b in out for n in b.column(1).to_pylist()] == [out[0].column(1)[0].as_py()] * 999 + [0]
