import codecs
import hashlib
import random
from pathlib import Path

from claimweave.sources import artifacts

CONTENT = "slug string, content binary, ext string"


def plain(content, cap):
    decoder = codecs.getincrementaldecoder("utf-8")(errors="replace")
    return decoder.decode(content[:cap]), len(content.decode("utf-8", "replace").rstrip("\n")), len(content) > cap


def test_round_trip_and_bounded_heads(spark, tmp_path):
    rng = random.Random(2)
    root = str(tmp_path / "store")
    contents = [b"", b"\n\n", "é€😀".encode() * 5, b"plain\n\n", b"bad \xff\xfe end", b"cut \xe2\x82", "ü\n".encode()] + ["".join(rng.choice("aé€😀\n") for _ in range(rng.randrange(40))).encode() for _ in range(40)]
    rows = [(f"s{i % 3}", c, [".txt", None][i % 2]) for i, c in enumerate(contents)]
    frame = spark.createDataFrame(rows + rows[:9] + [("s0", None, ".txt")], CONTENT)
    artifacts.put(frame, root)
    before = {p: p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}
    artifacts.put(frame, root)
    assert {p: p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet") if p in before} == before
    want = {f"{s}/{hashlib.sha256(c).hexdigest()[:2]}/{hashlib.sha256(c).hexdigest()}{e or '.bin'}": c for s, c, e in rows}
    assert artifacts.stored(spark, root).count() == len(want)
    uris = spark.createDataFrame([(u,) for u in want] * 2, "uri string")
    assert {r.uri: bytes(r.content) for r in artifacts.get(uris, root).collect()} == want
    for cap in range(1, 8):
        got = {r.uri: (r.text, r.chars, r.partial) for r in artifacts.read_bounded(uris, root, cap).collect()}
        assert got == {u: plain(c, cap) for u, c in want.items()}


def test_nothing_outside_the_store_is_read(spark, tmp_path):
    root = str(tmp_path / "store")
    (tmp_path / "secret.txt").write_text("secret")
    odd = spark.createDataFrame([(u,) for u in ("../secret.txt", str(tmp_path / "secret.txt"), "s/ab/../../../secret.txt", "s/00/" + "0" * 64 + ".txt", "", None)], "uri string")
    assert artifacts.read_bounded(odd, root, 9).count() == 0
    artifacts.put(artifacts.files(spark, str(tmp_path), "secret*").selectExpr("'web' as slug", "content", "'.txt' as ext"), root)
    assert artifacts.stored(spark, root).count() == 1 and artifacts.read_bounded(odd, root, 9).count() == 0
    assert all(r.content is None for r in artifacts.get(odd, root).collect())
