"""SimHash near-dedup: fingerprints that differ in few bits, found by pigeonhole blocks.

A fingerprint is cut into ``BLOCKS`` blocks of bits. Two that differ in at
most ``BITS`` bits agree on ``BLOCKS - BITS`` whole blocks, so each
fingerprint is dealt once for every such choice of blocks, keyed by their
bits; those of one key are joined and their Hamming distance is verified.

Equal fingerprints are one class, so copies never meet. Keys that more than
``FEW`` classes share are not paired: each of their fingerprints is written
beside those that differ from it in one bit outside the shared blocks. Two
fingerprints at two bits or fewer have such a neighbour in common, and all
that have one in common are links, so each joins the least of them. At most
65 fingerprints can have a neighbour in common, so no group grows, and no
link is lost.

Defined cases: a null or empty text, or one of white space alone, has
fingerprint 0 and is linked like any other. A text of fewer than three
words is one shingle. Texts of any length are hashed in pieces. Null ids
never name a component unless it has no other id. Repeated rows and ids
each give a row. Other columns are not read, whatever their names. No rows
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.components import connected
from claimweave.llm.tables import in_workers, persist_cut, table

#: Words of a shingle, seed of its hash, bits in which linked fingerprints may differ.
WORDS, SEED, BITS = 3, 42, 2
#: Blocks of a fingerprint, and classes of a key that are compared pairwise.
BLOCKS, FEW = 4, 64
#: Shingles whose bits are counted at a time.
PIECE = 1 << 14


def fingerprint(text: str | None) -> int:
    """The SimHash of the text's shingles, repeats included; unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    last = max(len(words) - WORDS + 1, 1)
    ones = np.zeros(64, np.int64)
    for piece in range(0, last, PIECE):
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[starts[i] : ends[min(i + WORDS, len(words)) - 1]], SEED) for i in range(piece, min(piece + PIECE, last))), ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > last).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column("_text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(prints.view(np.int64))], names=["_id", "_f"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _f) of each row; ``_f`` holds the fingerprint's 64 bits as a signed long."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return in_workers(rows, _fingerprints, f"_id {rows.schema['_id'].dataType.simpleString()}, _f long")


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def block_masks() -> list[int]:
    """The bits of each choice of blocks on which close fingerprints may agree."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, BLOCKS - BITS)]


def _keys(classes: DataFrame) -> DataFrame:
    """(_k, _key, _f): each fingerprint once for each choice of blocks, with the bits of those blocks."""
    masks = [F.struct(F.lit(k).alias("_k"), F.col("_f").bitwiseAND(F.lit(_signed(m))).alias("_key")) for k, m in enumerate(block_masks())]
    return classes.select("_f", F.explode(F.array(*masks)).alias("_m")).select("_m._k", "_m._key", "_f")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(classes: DataFrame) -> DataFrame:
    """Links (_a, _b) between fingerprints ``_f``, all different, that join every two within ``BITS`` bits, directly or by others so linked."""
    keys = _keys(classes)
    sizes = persist_cut(keys.groupBy("_k", "_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    few = keys.join(sizes.filter(F.col("_n") <= FEW).select("_k", "_key"), ["_k", "_key"], "left_semi")
    left, right = few.withColumnRenamed("_f", "_a"), few.withColumnRenamed("_f", "_b")
    close = left.join(right, (left["_k"] == right["_k"]) & (left["_key"] == right["_key"]) & (left["_a"] < right["_b"]) & (distance(left["_a"], right["_b"]) <= BITS)).select("_a", "_b")
    shared = keys.join(sizes.filter(F.col("_n") > FEW).select("_k", "_key"), ["_k", "_key"], "left_semi")
    free = F.array(*[F.lit(_signed(~m & ((1 << 64) - 1))) for m in block_masks()])
    crowded = shared.groupBy("_f").agg(F.bit_or(F.element_at(free, F.col("_k") + 1)).alias("_free"))
    flips = F.filter(F.array(*[F.lit(_signed(1 << b)) for b in range(64)]), lambda bit: F.col("_free").bitwiseAND(bit) != 0)
    beside = crowded.select("_f", F.explode(F.concat(F.array(F.lit(0).cast("long")), flips)).alias("_bit")).select("_f", F.col("_f").bitwiseXOR(F.col("_bit")).alias("_near"))
    meeting = beside.groupBy("_near").agg(F.collect_list("_f").alias("_fs")).filter(F.size("_fs") > 1)
    stars = meeting.select(F.array_min("_fs").alias("_a"), F.explode("_fs").alias("_b")).filter("_a != _b")
    return close.unionByName(stars).distinct()


def components(prints: DataFrame) -> DataFrame:
    """(_id, _f, component_id) of each row (_id, _f)."""
    classes = persist_cut(prints.groupBy("_f").agg(F.min("_id").alias("_least")))
    parts = connected(links(classes.select("_f")))
    linked = classes.join(parts, F.col("_f") == F.col("_member"), "left").select("_f", "_least", F.coalesce("_component", "_f").alias("_component"))
    named = linked.groupBy("_component").agg(F.min("_least").alias("component_id"))
    return prints.join(linked.join(named, "_component").select("_f", "component_id"), "_f")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id (least id reachable over links) of each row of ``docs``."""
    rows = components(persist_cut(fingerprints(docs, id_col, text_col)))
    return rows.select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_f")), 16, "0").alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))
