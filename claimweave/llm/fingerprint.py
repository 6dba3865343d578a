"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text's distinct paragraphs are hashed; each digest goes to one cell in
each of three parts of a sketch, whose cells hold a count, the XOR of
digests and the XOR of check values. Subtracting the sketches of two
versions leaves the digests in which they differ, and peeling cells that
hold one digest recovers them. Parts are powers of two, so a sketch folds
to half its size by adding its halves: sketches of different sizes are
compared at the smaller size, and when peeling fails the comparison is
retried at twice the size, rebuilt from the paragraphs.

A paragraph ends at a line break, and within a line at the ends of
sentences or word runs that a hash of the last word picks, so that the
same passage gives the same paragraphs wherever it stands.

``query`` compares each text with an edited one and with the next
document's. Texts are shuffled once, into ranges of the id; each range
gets a copy of the row that follows it.

Defined cases: null and empty texts have no paragraphs and the likeness of
two such texts is 1. Rows with equal ids follow each other by text; null
ids come last. A single row follows itself.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import compress, count
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.tables import in_workers, table, whole_text

#: Parts of a sketch, and cells of a part for each paragraph.
PARTS, CELLS_EACH = 3, 0.75
_CELL = np.dtype([("count", "<i4"), ("digest", "<u8"), ("check", "<u4")])


class _Ends(dict):
    """Whether a word may end a paragraph: one in two that end sentences, one in 32 of the others; bounded."""

    def __missing__(self, word: str) -> bool:
        out = crc32(word.encode("utf-8", "replace")) % (2 if word[-1] in ".!?" else 32) == 0
        if len(self) >= 200_000:
            self.clear()
        if len(word) < 64:
            self[word] = out
        return out


_ends = _Ends()


def paragraphs(text: str) -> set[str]:
    """The distinct paragraphs of a text, with white space squeezed."""
    out: set[str] = set()
    for line in text.split("\n"):
        words = line.split()
        start = 0
        for last in compress(count(1), map(_ends.__getitem__, words)):
            out.add(" ".join(words[start:last]))
            start = last
        if start < len(words):
            out.add(" ".join(words[start:]))
    return out


def digests(found: set[str]) -> list[int]:
    return sorted({xxhash.xxh3_64_intdigest(p.encode("utf-8", "replace")) for p in found})


def part_cells(n: int) -> int:
    """Cells of a part for ``n`` paragraphs: a power of two, 4 at least."""
    return 1 << max(2, int(np.ceil(n * CELLS_EACH) - 1).bit_length()) if n else 4


# Odd multipliers that spread digests over checks and over the cells of each part.
_CHECK = np.uint64(0x9E3779B97F4A7C15)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


def _check(digest: int) -> int:
    return (digest * int(_CHECK) >> 32) & 0xFFFFFFFF


def _at(digest: int, part: int) -> int:
    """Where a digest goes in a part, before it is cut to the part's size."""
    return ((digest ^ (digest >> 29)) * _MIX[part] & 0xFFFFFFFFFFFFFFFF) >> 24


def sketch(keys: list[int], size: int) -> np.ndarray:
    """Cells (PARTS, size) that hold the digests."""
    cells = np.zeros((PARTS, size), dtype=_CELL)
    if keys:
        digest = np.array(keys, dtype=np.uint64)
        check = (digest * _CHECK >> np.uint64(32)).astype(np.uint32)
        mixed = digest ^ (digest >> np.uint64(29))
        for part in range(PARTS):
            at = ((mixed * np.uint64(_MIX[part]) >> np.uint64(24)) & np.uint64(size - 1)).astype(np.int64)
            np.add.at(cells["count"][part], at, 1)
            np.bitwise_xor.at(cells["digest"][part], at, digest)
            np.bitwise_xor.at(cells["check"][part], at, check)
    return cells


def fold(cells: np.ndarray, size: int) -> np.ndarray:
    """The same digests in parts of ``size`` cells."""
    while cells.shape[1] > size:
        half = cells.shape[1] // 2
        out = np.zeros((PARTS, half), dtype=_CELL)
        out["count"] = cells["count"][:, :half] + cells["count"][:, half:]
        for field in ("digest", "check"):
            out[field] = cells[field][:, :half] ^ cells[field][:, half:]
        cells = out
    return cells


def difference(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]] | None:
    """Digests only in a's and only in b's sketch, by subtracting and peeling; None if peeling stops early."""
    size = min(a.shape[1], b.shape[1])
    a, b = fold(a, size), fold(b, size)
    counts = (a["count"] - b["count"]).tolist()
    digest = (a["digest"] ^ b["digest"]).tolist()
    check = (a["check"] ^ b["check"]).tolist()
    only: tuple[list[int], list[int]] = ([], [])
    pure = [(p, i) for p in range(PARTS) for i in range(size) if counts[p][i] in (1, -1)]
    while pure:
        p, i = pure.pop()
        sign, key = counts[p][i], digest[p][i]
        if sign not in (1, -1) or check[p][i] != _check(key):
            continue
        only[sign < 0].append(key)
        for q in range(PARTS):
            j = _at(key, q) & (size - 1)
            counts[q][j] -= sign
            digest[q][j] ^= key
            check[q][j] ^= _check(key)
            if counts[q][j] in (1, -1):
                pure.append((q, j))
    empty = not any(map(any, counts)) and not any(map(any, digest))
    return only if empty else None


def likeness(keys_a: list[int], cells_a: np.ndarray, keys_b: list[int], cells_b: np.ndarray) -> float:
    """Jaccard similarity of two texts' paragraphs, from the difference of their sketches; retried larger on failure."""
    if not keys_a and not keys_b:
        return 1.0
    found, size = difference(cells_a, cells_b), min(cells_a.shape[1], cells_b.shape[1])
    while found is None:
        size *= 2
        found = difference(sketch(keys_a, size), sketch(keys_b, size))
    both = (len(keys_a) + len(keys_b) - len(found[0]) - len(found[1])) / 2
    return both / (len(keys_a) + len(keys_b) - both)


def as_string(cells: np.ndarray) -> str:
    """Cells of a part, and all cells packed, as text."""
    return f"{cells.shape[1]}:{base64.b64encode(cells.tobytes()).decode()}"


def from_string(text: str) -> np.ndarray:
    size, packed = text.split(":", 1)
    return np.frombuffer(base64.b64decode(packed), dtype=_CELL).reshape(PARTS, int(size))


class _Version:
    def __init__(self, text: str):
        self.text = text
        self.keys = digests(paragraphs(text))
        self.cells = sketch(self.keys, part_cells(len(self.keys)))


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_paragraphs and fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 128) for b in batches for at in range(0, b.num_rows, 128)):
            all_of = [_Version(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v.keys) for v in all_of], pa.int64()), pa.array([as_string(v.cells) for v in all_of], pa.string())], [id_col, "n_paragraphs", "fingerprint"])

    return in_workers(docs.select(id_col, text_col), run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_paragraphs long, fingerprint string")


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text and against the next document, by ascending id."""
    kind = dict(docs.dtypes)[id_col]
    session = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_whole"))
    # Ranges of ids: quantiles, some for each partition, so that a list of them stays small whatever the input's size.
    ranges = 4 * int(session.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).alias("_id")).filter(F.col(id_col).isNotNull())
    cuts = ids.select(F.percentile_approx("_id", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    cut_array = F.array(*[F.lit(c) for c in cuts]).cast(f"array<{kind}>")
    place = F.when(F.col("_id").isNull(), len(cuts) + 1).otherwise(F.size(F.filter(cut_array, lambda c: c < F.col("_id"))))
    # The first id of each range that has rows: the row that follows the range before it.
    placed = rows.withColumn("_range", place)
    heads = sorted((r["_range"], r["_id"]) for r in placed.groupBy("_range").agg(F.min("_id").alias("_id")).collect())
    if not heads:
        return session.createDataFrame([], f"`{id_col}` {kind}, {_RESULT}")
    before = {r: heads[i - 1][0] for i, (r, _) in enumerate(heads)}  # the first range follows the last
    follows = F.create_map(*[F.lit(x) for r, b in before.items() for x in (r, b)])
    first = F.create_map(*[F.lit(x) for r, i in heads if i is not None for x in (r, i)]).cast(f"map<int,{kind}>") if any(i is not None for _, i in heads) else None
    is_head = F.col("_id").isNull() if first is None else F.col("_id").eqNullSafe(first[F.col("_range")])
    # Of rows with a head's id only one, that of the least text, is the head; heads are few, so they are looked up by range.
    head_rows = placed.filter(is_head).groupBy("_range").agg(F.min("_whole").alias("_whole"), F.first("_id").alias("_id"))
    copies = head_rows.select("_id", "_whole", follows[F.col("_range")].alias("_range"), F.lit(1).alias("_last"))
    all_rows = placed.select("_id", "_whole", "_range", F.lit(0).alias("_last")).unionByName(copies)
    dealt = all_rows.repartition(ranges, "_range").sortWithinPartitions("_range", "_last", F.col("_id").asc_nulls_last(), "_whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, object, _Version] | None = None
        for batch in (b.slice(at, 128) for b in batches for at in range(0, b.num_rows, 128)):
            out: list[tuple] = []
            for doc, text, where, last in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                now = _Version(text)
                if held is not None and held[0] == where:
                    _, of, v = held
                    changed = edited(v.text, now.text)
                    e = v if changed == v.text else _Version(changed)
                    out.append((of, len(v.text), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), as_string(v.cells), as_string(e.cells), likeness(v.keys, v.cells, e.keys, e.cells), likeness(v.keys, v.cells, now.keys, now.cells)))
                held = None if last else (where, doc, now)
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)], [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return in_workers(dealt, run, f"`{id_col}` {kind}, {_RESULT}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents"))
