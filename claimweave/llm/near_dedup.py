"""Near-duplicates by chosen-path set similarity join.

A text's set holds its distinct word shingles, hashed to 64 bits. Equal
sets are joined first, so that a group of copies counts once. Each
distinct set has a sketch of minwise tokens. Every tree sends a set down a
path chosen by the sketch: level by level a node's sets branch by their
next minwise token, and a node of at most ``NODE`` sets is compared
exhaustively. Independent trees repeat this; a pair at the threshold t
stays together for d levels of one tree with probability t**d.

No node emits all its pairs. First each set is compared with its node's
hubs, which agree most with the node's consensus sketch. Large nodes whose
sets are not all connected by then branch on, in every tree. Sets whose small
nodes lie so deep that these would miss a partner at the threshold with a
probability over ``MISSED`` are put in more trees, as many as it takes. Small
nodes then emit the pairs whose ends are not yet connected. What shares a node
that is still large there, or at the last level of the first trees, is one
crowd: its sets outside the crowd's largest component meet all of its sets,
block by block, so no node is left out for its size. (The README has measured
recall.) Size and sketch rule out pairs far from
the threshold (a true pair fails the sketch test with a probability below
1e-4); every link is confirmed on the full sets.

Defined cases: a null or empty text, or one of white space only, has an
empty set, is linked with nothing and is its own component. Null ids come
after all others: a component of only null ids has a null id. Repeated
rows are linked as copies. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.components import merged
from claimweave.llm.tables import has_repeated_ids, in_workers, persist_cut, table, unused, whole_text

#: Independent trees, minwise tokens, levels at which nodes have hubs, levels at most, and sets that a node may hold to be compared exhaustively.
TREES, TOKENS, HUB_LEVELS, LEVELS, NODE = 10, 40, 4, 14, 64
#: Trees whose large nodes have hubs before any set is linked, and hubs of a node: sets of equal sketches tie.
WIDE_TREES, HUBS = 3, 5
#: Sets of a block of a crowd.
BLOCK = 256
#: Standard deviations by which a sketch may fall short of the threshold, for a pair to be looked at.
SLACK = 4.5
#: Most probability with which small nodes may miss a partner at the threshold, for a set not to be put in more trees; tokens of a node there; bytes of a sketch there.
MISSED, DEPTH, WIDE = 1e-4, 8, 256
#: Rows of a batch whose texts or sets are held at a time.
ROWS = 512
#: Words that a worker remembers the hash of.
WORDS_KEPT = 150_000

_U = np.uint64
_rng = np.random.default_rng(20240)
_PLACE = _rng.integers(1 << 62, size=64, dtype=np.uint64) * _U(2) + _U(1)
_MULTIPLY = _rng.integers(1 << 62, size=TOKENS, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _rng.integers(1 << 63, size=TOKENS, dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = out
        return out


_hashes = _WordHashes()


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; A-Z are lower-cased and words end at ASCII white space."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    if len(codes) < words:
        mixed = np.array([(codes * _PLACE[: len(codes)]).sum(dtype=np.uint64) + _U(len(codes))])
    else:
        n = len(codes) - words + 1
        mixed = codes[:n] * _PLACE[0]
        for i in range(1, words):
            mixed = mixed + codes[i : i + n] * _PLACE[i]
    mixed = (mixed ^ (mixed >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    return np.unique(mixed ^ (mixed >> _U(32)))


def sketch(codes: np.ndarray) -> np.ndarray:
    """The minwise token of each function."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(codes), 4096):
        mixed = codes[at : at + 4096, None] * _MULTIPLY + _ADD
        least = np.minimum(least, mixed.min(0))
    return (least >> _U(32)).astype(np.uint32).view(np.int32)


def least_equal(share: float, tokens: int = TOKENS) -> int:
    """Equal tokens that a pair of this similarity has but for a probability below 1e-4."""
    return int(tokens * share - SLACK * (tokens * share * (1 - share)) ** 0.5)


def _signature(codes: np.ndarray) -> bytes:
    return hashlib.blake2b(codes.tobytes(), digest_size=16).digest() if len(codes) else b""


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def describe(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, _n, _sig, _tokens) of every row, and an MD5 of the text as ``_text``; no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n, sig, tokens, key = [], [], [], []
            for text in batch.column(1).to_pylist():
                codes = shingles(text, words)
                n.append(len(codes))
                sig.append(_signature(codes))
                tokens.append(sketch(codes).tobytes() if len(codes) else None)
                key.append(hashlib.md5((text or "").encode("utf-8", "replace")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(tokens, pa.binary()), pa.array(key, pa.string())], ["_id", "_n", "_sig", "_tokens", "_text"])

    kind = dict(docs.dtypes)[id_col]
    return in_workers(docs.select(F.col(id_col).alias("_id"), text_col), run, f"_id {kind}, _n long, _sig binary, _tokens binary, _text string")


def _token(level: str) -> str:
    return f"substring(_tokens, ((tree * {TOKENS // TREES} + {level}) % {TOKENS}) * 4 + 1, 4)"


def _first_levels(sets: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None, DataFrame]:
    """(_node, _sig) of small nodes, (_node, _size, _sig) of the larger ones that have hubs first, (_node, tree, _level, _sig) of all larger ones, and (_node, tree, _sig) of those that are left at the last level."""
    rows, small, first, large = sets.select("_sig", "_tokens", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")), [], None, []
    rows = rows.withColumn("_path0", F.expr(f"xxhash64(tree, {_token('0')})"))
    for level in range(1, HUB_LEVELS):
        rows = rows.withColumn(f"_path{level}", F.expr(f"xxhash64(_path{level - 1}, {_token(str(level))})"))
    rows = rows.drop("_tokens")
    for level in range(HUB_LEVELS):
        node = f"_path{level}"
        counts = rows.groupBy(node).agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
        rows = persist_cut(rows.join(counts, node))
        small.append(rows.filter(f"_size <= {NODE}").select(F.col(node).alias("_node"), "_sig"))
        rows = rows.filter(f"_size > {NODE}")
        if rows.isEmpty():
            break
        if level == 0:
            first = rows.filter(f"tree < {WIDE_TREES}").select(F.col(node).alias("_node"), "_size", "_sig")
        large.append(rows.select(F.col(node).alias("_node"), "tree", F.lit(level - HUB_LEVELS).alias("_level"), "_sig"))
        rows = rows.drop("_size")
    return _union(small), first, _union(large) if large else None, rows.select(F.col(node).alias("_node"), "tree", "_sig")


def _placed(members: DataFrame, joined: DataFrame) -> DataFrame:
    """``members`` with the component of each set as ``_part``."""
    return members.join(joined, members["_sig"] == joined["_member"], "left").select(*[members[c] for c in members.columns], F.coalesce("_component", "_sig").alias("_part"))


def _further_levels(rows: DataFrame, sets: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(_node, _sig) of the small nodes below large ones, (_node, tree, _level, _sig) of the large nodes, and (_node, _sig) of those at the last level, where their sets are not all in one component.

    A set's path is known in full, so all levels are counted at once, over
    narrow rows; of each tree a set keeps the first small node on its path.
    """
    placed = _placed(rows, joined)
    mixed = placed.groupBy("_node").agg(F.min("_part").alias("_lo"), F.max("_part").alias("_hi")).filter("_lo != _hi").select("_node")
    deep = placed.join(mixed, "_node").join(sets.select("_sig", "_tokens"), "_sig").withColumn("_path0", F.col("_node"))
    levels = LEVELS - HUB_LEVELS
    for i in range(1, levels + 1):
        deep = deep.withColumn(f"_path{i}", F.expr(f"xxhash64(_path{i - 1}, {_token(str(HUB_LEVELS + i - 1))})"))
    steps = deep.select("tree", "_sig", "_part", F.posexplode(F.array(*[f"_path{i}" for i in range(1, levels + 1)])).alias("_level", "_node"))
    steps = persist_cut(steps)
    parts = steps.groupBy("_node").agg(F.min("_part").alias("_lo"), F.max("_part").alias("_hi"), F.count(F.lit(1)).alias("_size")).filter("_lo != _hi").select("_node", "_size")
    steps = persist_cut(steps.drop("_part").join(parts, "_node"))
    small = steps.filter(f"_size <= {NODE}").groupBy("tree", "_sig").agg(F.min(F.struct("_level", "_node"))["_node"].alias("_node")).select("_node", "_sig")
    large = steps.filter(f"_size > {NODE}")
    return small, large.select("_node", "tree", "_level", "_sig"), large.filter(f"_level = {levels - 1}").select("_node", "_sig")


def _unsure(large: DataFrame, share: float) -> DataFrame:
    """(_sig) of the sets whose small nodes may miss a partner at the threshold with a probability over ``MISSED``.

    A small node of d tokens holds every partner with the same tokens, with
    probability share**d, and is compared exhaustively. What a set shares with
    a partner may be just what many others have too, so all its trees count as
    if small nodes came as late as in its deepest one.
    """
    enough = next((d for d in range(LEVELS, 0, -1) if TREES * math.log1p(-(share**d)) <= math.log(MISSED)), 0)
    return large.filter(F.col("_level") + HUB_LEVELS + 2 > enough).select("_sig").distinct()


def _least_tokens(codes: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The minwise token of each of many functions, over a few codes at a time."""
    least = np.full(len(multiply), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(codes), 256):
        least = np.minimum(least, (codes[at : at + 256, None] * multiply + add).min(0))
    return least


def _in_more_trees(full_sets: DataFrame, depth: int, trees: int) -> DataFrame:
    """(_sig, _n, _tokens, _nodes): a wide sketch of bytes, and the nodes ``depth`` tokens deep in further trees, of tokens of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(depth)
        multiply = random.integers(1 << 62, size=WIDE + trees * depth, dtype=np.uint64) * _U(2) + _U(1)
        add = random.integers(1 << 63, size=len(multiply), dtype=np.uint64)
        for batch in batches:
            n, tokens, nodes = [], [], []
            for data in batch.column(1):
                codes = np.frombuffer(data.as_buffer(), np.uint64)
                least = _least_tokens(codes, multiply, add) >> _U(32)
                n.append(len(codes))
                tokens.append(least[:WIDE].astype(np.uint8).tobytes())
                paths = least[WIDE:].astype(np.uint32).reshape(trees, depth)
                nodes.append([xxhash.xxh64_intdigest(path.tobytes(), (depth << 32) + i) - (1 << 63) for i, path in enumerate(paths)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(tokens, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))], ["_sig", "_n", "_tokens", "_nodes"])

    return in_workers(full_sets.select("_sig", "_set"), run, "_sig binary, _n long, _tokens binary, _nodes array<long>")


def _settled(nodes: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_node, _sig) of the small and of the large nodes of more trees, where their sets are not all in one component."""
    placed = _placed(nodes.select("_sig", F.explode("_nodes").alias("_node")), joined)
    kinds = placed.groupBy("_node").agg(F.min("_part").alias("_lo"), F.max("_part").alias("_hi"), F.count(F.lit(1)).alias("_size")).filter("_lo != _hi").select("_node", "_size")
    rows = persist_cut(placed.drop("_part").join(kinds, "_node"))
    return rows.filter(f"_size <= {NODE}").select("_node", "_sig"), rows.filter(f"_size > {NODE}").select("_node", "_sig")


def _crowds(large: DataFrame) -> DataFrame:
    """(_node, _sig): the sets of large nodes (_node, _sig), each once, under the crowd of all that large nodes connect it with.

    Two sets that share any large node share their crowd, so these need not meet once in each node.
    """
    least = large.groupBy("_node").agg(F.min("_sig").alias("_a"))
    crowds = merged(None, large.join(least, "_node").select("_a", F.col("_sig").alias("_b")).distinct())
    return crowds.select(F.xxhash64("_component").alias("_node"), F.col("_member").alias("_sig"))


def _trees_of(share: float, depth: int) -> int:
    """Trees whose small nodes together miss a partner with a probability below ``MISSED``."""
    return math.ceil(math.log(MISSED) / math.log1p(-(share**depth)))


def _blocks(last: DataFrame, joined: DataFrame) -> DataFrame:
    """(_node, _sig, _own, _other): nodes of two blocks each, in which every set outside its node's largest component meets every set of the node.

    A set of the first block is the node's own, one of the second an other; a set may be both.
    """
    placed = _placed(last, joined)
    parts = placed.groupBy("_node", "_part").agg(F.count(F.lit(1)).alias("_n"))
    nodes = parts.groupBy("_node").agg(F.sum("_n").alias("_size"), F.max(F.struct("_n", "_part")).alias("_most")).filter("_most._n < _size")
    nodes = nodes.select("_node", F.expr("_most._part").alias("_main"), F.expr(f"cast(ceil(_size / {BLOCK}) as int)").alias("_all"), F.expr(f"cast(ceil((_size - _most._n) / {BLOCK}) as int)").alias("_out"))
    rows = persist_cut(placed.join(nodes, "_node"))
    own = rows.filter("_part != _main").select("_node", "_sig", F.expr("pmod(xxhash64(_sig), _out)").alias("_i"), F.explode(F.expr("sequence(0, _all - 1)")).alias("_j"))
    others = rows.select("_node", "_sig", F.explode(F.expr("sequence(0, _out - 1)")).alias("_i"), F.expr("pmod(xxhash64(_sig), _all)").alias("_j"))
    pair = F.xxhash64("_node", F.col("_i").cast("int"), F.col("_j").cast("int"), F.lit("blocks")).alias("_node")
    both = own.select(pair, "_sig", F.lit(True).alias("_own")).unionByName(others.select(pair, "_sig", F.lit(False).alias("_own")))
    return both.groupBy("_node", "_sig").agg(F.bool_or("_own").alias("_own"), F.bool_or(~F.col("_own")).alias("_other"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def _consensus(tokens: np.ndarray) -> np.ndarray:
    """The most frequent token of each function."""
    out = np.zeros(TOKENS, np.int32)
    for i in range(TOKENS):
        values, times = np.unique(tokens[:, i], return_counts=True)
        out[i] = values[times.argmax()]
    return out


_PAIR = "_a binary, _b binary"


def _pair_batch(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    ordered = {(min(p), max(p)) for p in pairs}
    a, b = zip(*ordered, strict=True) if ordered else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["_a", "_b"])


def _plausible(n: np.ndarray, tokens: np.ndarray, at: int, share: float) -> np.ndarray:
    """Which of a node's sets may be linked with the one at ``at``: by size (exact) and sketch."""
    near = (tokens == tokens[at]).sum(1) >= least_equal(share, tokens.shape[1])
    return near & (np.minimum(n, n[at]) >= share * np.maximum(n, n[at]) - 1e-9)


def _small_nodes(members: DataFrame, sets: DataFrame) -> DataFrame:
    """A row for each small node with its sets, sizes and sketches; at most NODE of them."""
    full = members.join(sets.select("_sig", "_n", "_tokens"), "_sig")
    return full.groupBy("_node").agg(F.collect_list(F.struct("_sig", "_n", "_tokens")).alias("_sets"))


def _hub_pairs_small(nodes: DataFrame, share: float) -> DataFrame:
    """Each set of a small node with the node's hub, and each with itself that a later round may pair with another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs: list[tuple[bytes, bytes]] = []
            for members in batch.column(0).to_pylist():
                sig, n = [m["_sig"] for m in members], np.array([m["_n"] for m in members])
                tokens = np.frombuffer(b"".join(m["_tokens"] for m in members), np.int32).reshape(-1, TOKENS)
                hub = int(((tokens == _consensus(tokens)).sum(1) if len(sig) > 2 else n).argmax())
                near = _plausible(n, tokens, hub, share)
                pairs += [(sig[hub], sig[i]) for i in np.flatnonzero(near) if i != hub]
                if len(sig) > 2:
                    pairs += [(sig[i], sig[i]) for i in range(len(sig)) if i != hub and _plausible(n, tokens, i, share).sum() > 1 + near[i]]
            yield _pair_batch(pairs)

    return nodes.select("_sets").mapInArrow(run, _PAIR)


def _same_as(other: str) -> str:
    """Equal tokens of a set's sketch and another, compared four bytes at a time."""
    return f"aggregate(sequence(0, {TOKENS - 1}), 0, (acc, i) -> acc + if(substring(_tokens, 4 * i + 1, 4) = substring({other}, 4 * i + 1, 4), 1, 0))"


def _hub_pairs_large(members: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """Each set of a large node with the node's hub. The consensus comes from about NODE members of each node."""
    full = persist_cut(members.join(sets.select("_sig", "_n", "_tokens"), "_sig"))
    chance = F.lit(float(NODE)) / F.col("_size")
    some = full.filter((F.xxhash64("_node", "_sig").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))) < chance)
    sampled = some.groupBy("_node").agg(F.collect_list("_tokens").alias("_list"))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_consensus(np.frombuffer(b"".join(some), np.int32).reshape(-1, TOKENS)).tobytes() for some in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["_node", "_consensus"])

    consensus = sampled.mapInArrow(agree, "_node long, _consensus binary")
    scored = full.join(consensus, "_node").select("_node", "_sig", F.expr(_same_as("_consensus")).alias("_same"), "_n", "_tokens")
    hubs = scored.groupBy("_node", F.expr(f"pmod(xxhash64(_sig), {HUBS})").alias("_class")).agg(F.max(F.struct("_same", "_sig", "_n", "_tokens")).alias("_hub")).drop("_class")
    wanted = (full["_sig"] != F.col("_hub._sig")) & F.expr(f"least(_n, _hub._n) >= {share} * greatest(_n, _hub._n) - 1e-9") & F.expr(f"{_same_as('_hub._tokens')} >= {least_equal(share)}")
    pairs = full.join(hubs, (full["_node"] == hubs["_node"]) & wanted)
    return pairs.select(F.least("_sig", "_hub._sig").alias("_a"), F.greatest("_sig", "_hub._sig").alias("_b"))


def _open_pairs(members: DataFrame, sets: DataFrame, joined: DataFrame, share: float, kind: type = np.int32) -> DataFrame:
    """The plausible pairs of each small node whose ends lie in different components; the tokens of the sketches in ``sets`` are of ``kind``.

    Two sets that have a wide sketch (_wide) too must agree by that as well.
    """
    wide = (F.col("_wide") if "_wide" in sets.columns else F.lit(None).cast("binary")).alias("_wide")
    placed = members.join(joined, members["_sig"] == joined["_member"], "left").select("_node", "_sig", F.coalesce("_component", "_sig").alias("_component"))
    mixed = placed.groupBy("_node").agg(F.min("_component").alias("_lo"), F.max("_component").alias("_hi")).filter("_lo != _hi").select("_node")
    full = placed.join(mixed, "_node").join(sets.select("_sig", "_n", "_tokens", wide), "_sig")
    nodes = full.groupBy("_node").agg(F.collect_list(F.struct("_sig", "_n", "_tokens", "_wide", "_component")).alias("_sets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, bytes, bytes]] = []
            for node, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sig, n = [m["_sig"] for m in found], np.array([m["_n"] for m in found])
                part = np.unique([m["_component"] for m in found], return_inverse=True)[1]
                tokens = np.frombuffer(b"".join(m["_tokens"] for m in found), kind).reshape(len(found), -1)
                known = np.array([m["_wide"] is not None for m in found])
                wider = np.frombuffer(b"".join(m["_wide"] or bytes(WIDE) for m in found), np.uint8).reshape(-1, WIDE) if known.any() else None
                for i in range(len(sig)):
                    near = _plausible(n, tokens, i, share) & (part != part[i])
                    if known[i] and near.any():
                        near &= ~known | ((wider == wider[i]).sum(1) >= least_equal(share, WIDE))
                    later = np.flatnonzero(near)
                    rows += [(node, *sorted((sig[i], sig[j]))) for j in later if j > i]
            node, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["_node", "_a", "_b"])

    found = nodes.select("_node", "_sets").mapInArrow(run, f"_node long, {_PAIR}")
    # A pair is confirmed in one of its nodes.
    return found.groupBy("_a", "_b").agg(F.min("_node").alias("_node"))


def _confirmed_in_nodes(pairs: DataFrame, full_sets: DataFrame, percent: int) -> DataFrame:
    """As ``_confirmed``, for pairs of small nodes: a node's sets come together once, not once for each pair.

    Pairs whose ends other pairs of the node connect are left out.
    """
    asked = pairs.groupBy("_node").agg(F.collect_list(F.struct("_a", "_b")).alias("_pairs"))
    members = pairs.select("_node", F.explode(F.array("_a", "_b")).alias("_sig")).distinct().join(full_sets, "_sig")
    given = members.groupBy("_node").agg(F.collect_list(F.struct("_sig", "_set")).alias("_sets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[bytes, bytes]] = []
            for i in range(batch.num_rows):
                sets = {m["_sig"]: np.frombuffer(m["_set"], np.uint64) for m in batch.column(1)[i].as_py()}
                head = {sig: sig for sig in sets}
                for p in batch.column(0)[i].as_py():
                    if p["_a"] not in sets or p["_b"] not in sets:
                        continue
                    a, b = p["_a"], p["_b"]
                    while head[a] != a:
                        a = head[a]
                    while head[b] != b:
                        b = head[b]
                    x, y = sets[p["_a"]], sets[p["_b"]]
                    if a != b:
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if 100 * both >= percent * (len(x) + len(y) - both):
                            head[a] = b
                            links.append((p["_a"], p["_b"]))
            yield _pair_batch(links)

    return asked.join(given, "_node").select("_pairs", "_sets").mapInArrow(run, _PAIR)


def _links_in_blocks(blocks: DataFrame, nodes: DataFrame, joined: DataFrame, full_sets: DataFrame, share: float, percent: int) -> DataFrame:
    """The links between sets of different components that own and other sets of a block have: all of these are compared, by sketch, then in full.

    Sets stream by in order of their blocks, and a task holds those of one.
    Pairs stay where they are formed; those whose ends other links of the
    block connect are left out.
    """
    rows = blocks.join(nodes.select("_sig", "_n", "_tokens"), "_sig").join(full_sets, "_sig")
    rows = _placed(rows, joined).repartition("_node").sortWithinPartitions("_node").select("_node", "_sig", "_own", "_other", "_n", "_tokens", "_part", "_set")

    def settle(block: list[dict]) -> list[tuple[bytes, bytes]]:
        sig, links = [r["_sig"] for r in block], []
        n, own, other = (np.array([r[c] for r in block]) for c in ("_n", "_own", "_other"))
        head, part = np.unique([r["_part"].hex() for r in block], return_inverse=True)
        head = np.arange(len(head))  # a component's head; links put one head for all of both
        tokens = np.frombuffer(b"".join(r["_tokens"] for r in block), np.uint8).reshape(len(block), -1)
        for i in np.flatnonzero(own):
            near = _plausible(n, tokens, i, share) & other & (head[part] != head[part[i]])
            near[:i] &= ~(own & other)[:i] | ~other[i]
            for j in np.flatnonzero(near):
                if head[part[i]] != head[part[j]]:
                    x, y = (np.frombuffer(block[k]["_set"], np.uint64) for k in (i, j))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        head[head == head[part[j]]] = head[part[i]]
                        links.append((sig[i], sig[j]))
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[dict] = []
        for batch in _slices(batches):
            for row in batch.to_pylist():
                if block and row["_node"] != block[0]["_node"]:
                    yield _pair_batch(settle(block))
                    block = []
                block.append(row)
        if block:
            yield _pair_batch(settle(block))

    return in_workers(rows, run, _PAIR)


def _confirmed(pairs: DataFrame, full_sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    a = full_sets.select(F.col("_sig").alias("_a"), F.col("_set").alias("_set_a"))
    b = full_sets.select(F.col("_sig").alias("_b"), F.col("_set").alias("_set_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["_a", "_b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "_a").join(b, "_b").select("_a", "_b", "_set_a", "_set_b").mapInArrow(run, _PAIR)


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(_sig, _set) of the sets in ``wanted`` (_sig, _id of one document that has it); the texts are shuffled by id, once."""
    texts = docs.select(F.col(id_col).alias("_doc"), whole_text(text_col).alias("_whole"))
    some = texts.join(wanted, texts["_doc"].eqNullSafe(wanted["_id"])).select("_sig", "_whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # repeated rows give a set once a task; links are made distinct later
        for batch in _slices(batches):
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            same = []
            for s, sig in zip(sets, batch.column(0).to_pylist(), strict=True):
                same.append(sig not in seen and _signature(s) == sig)
                if same[-1]:
                    seen.add(sig)
            same = pa.array(same, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["_sig", "_set"]).filter(same)

    return some.mapInArrow(run, "_sig binary, _set binary")


def classify(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _text, _n, _component, _kept) of every row: sets are linked when 100 * intersection >= percent * union."""
    share = percent / 100
    rows = persist_cut(describe(docs, words, id_col, text_col))
    sets = persist_cut(rows.filter("_n > 0").groupBy("_sig").agg(F.min("_id").alias("_id"), F.first("_n").alias("_n"), F.first("_tokens").alias("_tokens")))
    small, first, large, rest = _first_levels(sets)
    pairs = _hub_pairs_small(_small_nodes(small, sets), share)
    if first is not None:
        pairs = pairs.unionByName(_hub_pairs_large(first, sets, share))
    pairs = persist_cut(pairs.distinct())
    wanted = pairs.select(F.explode(F.array("_a", "_b")).alias("_sig")).distinct()
    pairs = pairs.filter("_a != _b")
    full_sets = persist_cut(_full_sets(docs, sets.join(wanted, "_sig", "left_semi").select("_sig", "_id"), words, id_col, text_col))

    def with_sets(of: DataFrame) -> DataFrame:
        """``full_sets`` and those in ``of`` (_sig) that had no plausible partner before."""
        late = persist_cut(sets.join(of.join(full_sets, "_sig", "left_anti"), "_sig", "left_semi").select("_sig", "_id"))
        return full_sets if late.isEmpty() else full_sets.unionByName(persist_cut(_full_sets(docs, late, words, id_col, text_col)))

    links = persist_cut(_confirmed(pairs, full_sets, percent))
    joined, found, known, crowded = merged(None, links), [], sets, None
    if large is not None:
        below, deep, last = _further_levels(rest, sets, joined)
        small = small.unionByName(below)
        unsure = persist_cut(_unsure(large.unionByName(deep), share))
        if not unsure.isEmpty():
            full_sets = with_sets(unsure)
            nodes = persist_cut(_in_more_trees(full_sets.join(unsure, "_sig", "left_semi"), DEPTH, _trees_of(share, DEPTH)))
            known = sets.join(nodes.select("_sig", F.col("_tokens").alias("_wide")), "_sig", "left")
            members, crowded = _settled(nodes, joined)
            found.append(_open_pairs(members, nodes, joined, share, np.uint8))
            crowded = crowded.unionByName(last)  # sets of the last level are all unsure
    more = persist_cut(_union([_open_pairs(small, known, joined, share), *found]).groupBy("_a", "_b").agg(F.min("_node").alias("_node")).join(pairs, ["_a", "_b"], "left_anti"))
    full_sets = with_sets(more.select(F.explode(F.array("_a", "_b")).alias("_sig")).distinct())
    joined = merged(joined, _confirmed_in_nodes(more, full_sets, percent))
    if crowded is not None and not crowded.isEmpty():
        # Last, when most of a crowd is one component.
        joined = merged(joined, persist_cut(_links_in_blocks(_blocks(_crowds(crowded), joined), nodes, joined, full_sets, share, percent)))
    least = sets.select("_sig", "_id").join(joined, sets["_sig"] == joined["_member"], "left").select("_sig", F.coalesce("_component", "_sig").alias("_part"), "_id")
    named = least.groupBy("_part").agg(F.min("_id").alias("_component"))
    of_sig = least.select("_sig", "_part").join(named, "_part").select("_sig", "_component")
    return rows.join(of_sig, "_sig", "left").select("_id", "_text", "_n", F.when(F.col("_n") == 0, F.col("_id")).otherwise(F.col("_component")).alias("_component")).withColumn("_kept", F.col("_id").eqNullSafe(F.col("_component")))


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that stay: one of each component, the one of smallest id.

    Rows that repeat id and text are kept once.
    """
    gone = classify(docs, words, percent, id_col, text_col).filter(~F.col("_kept")).select(F.col("_id").alias("_gone_id"), F.col("_text").alias("_gone_text"))
    row_id, row_text = unused(docs, "_row_id", "_row_text")
    keyed = docs.withColumns({row_id: F.col(id_col), row_text: F.md5(F.encode(whole_text(text_col), "UTF-8"))})
    kept = keyed.join(gone, keyed[row_id].eqNullSafe(gone["_gone_id"]) & (keyed[row_text] == gone["_gone_text"]), "left_anti")
    if has_repeated_ids(docs, id_col):
        kept = kept.dropDuplicates([row_id, row_text])
    return kept.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents"), words=3, percent=85)
    return out.select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"), F.col("_kept").alias("kept"))
