"""Merkle manifest of a dataset, kept as a tree of SHA-256 midstates.

Every row is a leaf; the leaves of a group (``lang``), ascending by id, are
hashed upwards in runs of ``ARITY`` until one node, the subroot, remains,
and the subroots give the root in the same way. A parent keeps a copy of its
hash state before each child slot. To replace a child, folding resumes the
state before its slot with the replacement and the siblings to its right
alone; nothing to its left is read again.

The tree is cut into chunks of ``WIDTH`` consecutive nodes. A pass hashes
all chunks, one row each, up to ``WIDTH`` times fewer nodes, so five passes
cover 10^12 leaves, and each but the first is small. The way up from each
chunk is then handed down pass by pass, and each chunk folds its own leaves.
Positions come from a range sort, so a group may hold all rows.

Defined cases: null columns are hashed as ``-``. Null ids come first, and
repeated ids are ordered by their leaf. A null id or a null ``n_chars`` is
never tampered with. A group of one leaf has that leaf as its subroot, and a
single group's subroot is the root. Texts of any length are hashed by the
JVM where they are read. Other columns are not read, whatever their names.
No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import sha256
from claimweave.llm.ranking import placed_in_order, with_position
from claimweave.llm.tables import crc32_sql, in_workers, persist_cut, table

#: Children of a node, levels hashed in one pass, nodes of a chunk.
ARITY, LEVELS = 2, 8
WIDTH = ARITY**LEVELS
#: Chunks that a worker hashes together.
TOGETHER = 64
STEPS = "array<struct<state:binary,left:binary,right:binary>>"


def field(value: Column) -> Column:
    """A value as its length in UTF-8 bytes, a colon and itself; null as a dash."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(n_chars: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))]), 256)


def tampered_leaves(docs: DataFrame) -> DataFrame:
    """(_g, _id, _digest, _new) of each row; ``_new`` replaces the leaf where 7 divides the checksum of the id, else it is null."""
    longer = F.col("n_chars").cast("decimal(38,0)") + 1
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    return docs.select(
        F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("lang"))).alias("_g"),
        F.col("doc_id").alias("_id"), F.unhex(leaf(F.col("n_chars"))).alias("_digest"), F.when(hit, F.unhex(leaf(longer))).alias("_new"),
    )


# --- One chunk row and its levels, in workers -------------------------------------------------


def _heights(sizes: list[int]) -> np.ndarray:
    """Levels that a pass hashes in groups of so many nodes."""
    out = []
    for n in sizes:
        level = 0
        while n > 1 and level < LEVELS:
            n, level = -(-n // ARITY), level + 1
        out.append(level)
    return np.array(out, np.int64)


def _grids(counts: np.ndarray, heights: np.ndarray) -> list[np.ndarray]:
    """Nodes of each chunk at each level."""
    out = [counts]
    for _ in range(int(heights.max(initial=0))):
        out.append(-(-out[-1] // ARITY))
    return out


def _hash_levels(base: np.ndarray, counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Digests (8, chunks, nodes) of each level over ``base``, and the states (8, chunks, parents, slots from 1) that parents keep."""
    digests, states = [base], []
    for level in range(len(counts) - 1):
        chunks, parents = base.shape[1], digests[-1].shape[2] // ARITY
        children = digests[-1].reshape(8, chunks, parents, ARITY)
        have = np.clip(counts[level][:, None] - ARITY * np.arange(parents)[None, :], 0, ARITY).reshape(-1)
        state, kept = sha256.fresh(chunks * parents), []
        for slot in range(ARITY):
            if slot:
                kept.append(state.reshape(8, chunks, parents))
            after = sha256.compress(state, sha256.hex_block(children[..., slot].reshape(8, -1)))
            state = np.where(have > slot, after, state)
        digests.append(sha256.finish(state, have).reshape(8, chunks, parents))
        states.append(np.stack(kept, axis=3))
    return digests, states


def _resume(node: np.ndarray, state: np.ndarray, rights: np.ndarray, more: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The parents of ``node`` (8, n): ``state`` goes on with it and its ``more`` right siblings (8, n, .) in a run of ``run`` children."""
    state = sha256.compress(state, sha256.hex_block(node))
    for j in range(ARITY - 1):
        on = more > j
        if on.any():
            state[:, on] = sha256.compress(state[:, on], sha256.hex_block(rights[:, on, j]))
    return sha256.finish(state, run)


def _items(batch: pa.RecordBatch) -> tuple[pa.StructArray, np.ndarray]:
    lists = batch.column("_items")
    return lists.flatten(), np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(at, TOGETHER)


def _spread(raw: list[bytes], shape: tuple[int, ...]) -> np.ndarray:
    """Each chunk's digests, written from the start of its part of an array (8, chunks, *shape)."""
    out = np.zeros((8, len(raw), int(np.prod(shape))), np.uint32)
    for c, piece in enumerate(raw):
        out[:, c, : len(piece) // 32] = sha256.from_bytes(piece)
    return out.reshape(8, len(raw), *shape)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each chunk row its nodes of all levels, the states its parents keep, and its top node."""
    for batch in _slices(batches):
        flat, counts = _items(batch)
        heights = _heights(batch.column("_size").to_pylist())
        levels = _grids(counts, heights)
        digests, starts = flat.field("_digest").to_pylist(), np.concatenate([[0], np.cumsum(counts)])
        base = _spread([b"".join(digests[a:b]) for a, b in zip(starts, starts[1:], strict=False)], (WIDTH,))
        nodes, states = _hash_levels(base, levels)
        all_nodes, all_states, tops = [], [], []
        for c, height in enumerate(heights):
            all_nodes.append(b"".join(sha256.to_bytes(nodes[k][:, c, : levels[k][c]]) for k in range(height + 1)))
            all_states.append(b"".join(sha256.to_bytes(states[k][:, c, : levels[k + 1][c]].reshape(8, -1)) for k in range(height)))
            tops.append(sha256.to_bytes(nodes[height][:, c, :1]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(all_nodes, pa.binary()), pa.array(all_states, pa.binary()), pa.array(tops, pa.binary())], names=[*batch.schema.names, "_nodes", "_states", "_top"])


def _kept(raw: bytes, counts: list[int], each: int = 1) -> list[bytes]:
    """The bytes of each level out of a chunk's; ``each`` digests for each of its nodes."""
    out, at = [], 0
    for n in counts:
        out.append(raw[at : at + 32 * each * n])
        at += 32 * each * n
    return out


def _levels_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[list[bytes]], list[list[bytes]]]:
    """(nodes at the lowest level, height, bytes of nodes by level, bytes of states by level) of each chunk row."""
    counts = np.asarray(batch.column("_items").value_lengths().to_numpy(zero_copy_only=False), np.int64)
    heights = _heights(batch.column("_size").to_pylist())
    levels = _grids(counts, heights)
    nodes, states = [], []
    for c, (raw, kept) in enumerate(zip(batch.column("_nodes").to_pylist(), batch.column("_states").to_pylist(), strict=True)):
        nodes.append(_kept(raw, [int(levels[k][c]) for k in range(heights[c] + 1)]))
        states.append(_kept(kept, [int(levels[k + 1][c]) for k in range(heights[c])], ARITY - 1))
    return counts, heights, nodes, states


def _way(pos: int, nodes: list[bytes], states: list[bytes]) -> Iterator[tuple[bytes, bytes, bytes]]:
    """(state before its slot, left siblings, right siblings) at each level above the node at ``pos`` of a chunk."""
    first = sha256.to_bytes(sha256.START[:, None])
    for level, kept in enumerate(states):
        parent, slot = divmod(pos, ARITY)
        run = nodes[level][32 * ARITY * parent : 32 * ARITY * (parent + 1)]
        at = 32 * ((ARITY - 1) * parent + slot - 1)
        yield kept[at : at + 32] if slot else first, run[: 32 * slot], run[32 * (slot + 1) :]
        pos = parent


def _hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The way up from each node of each chunk: its own levels, then those above the chunk."""
    for batch in _slices(batches):
        counts, _, nodes, states = _levels_of(batch)
        above, subroots, roots = batch.column("_above").to_pylist(), batch.column("_subroot").to_pylist(), batch.column("_root").to_pylist()
        groups, chunks = batch.column("_g").to_pylist(), batch.column("_chunk").to_pylist()
        rows: dict[str, list] = {"_g": [], "_pos": [], "_above": [], "_subroot": [], "_root": []}
        for c, n in enumerate(counts):
            for p in range(n):
                steps = [{"state": s, "left": x, "right": y} for s, x, y in _way(p, nodes[c], states[c])]
                for name, value in zip(rows, (groups[c], chunks[c] * WIDTH + p, steps + above[c], subroots[c], roots[c]), strict=True):
                    rows[name].append(value)
        step = pa.struct([("state", pa.binary()), ("left", pa.binary()), ("right", pa.binary())])
        yield pa.RecordBatch.from_arrays([pa.array(rows["_g"], pa.string()), pa.array(rows["_pos"], pa.int64()), pa.array(rows["_above"], pa.list_(step)), pa.array(rows["_subroot"], pa.binary()), pa.array(rows["_root"], pa.binary())], names=list(rows))


def _fold_own(cur: np.ndarray, chunk: np.ndarray, pos: np.ndarray, counts: np.ndarray, heights: np.ndarray, nodes: list[list[bytes]], states: list[list[bytes]]) -> np.ndarray:
    """The chunk's top node for each lane, whose leaf at ``pos`` is replaced by ``cur``."""
    levels = _grids(counts, heights)
    for level in range(len(levels) - 1):
        on = np.flatnonzero(heights[chunk] > level)
        width = WIDTH // ARITY**level
        grid = _spread([n[level] if level < len(n) else b"" for n in nodes], (width,))
        kept = _spread([s[level] if level < len(s) else b"" for s in states], (width // ARITY, ARITY - 1))
        c, (parent, slot) = chunk[on], np.divmod(pos[on], ARITY)
        run = np.minimum(levels[level][c] - parent * ARITY, ARITY)
        state = np.where(slot > 0, kept[:, c, parent, np.maximum(slot - 1, 0)], sha256.START[:, None])
        ahead = np.minimum(pos[on][:, None] + 1 + np.arange(ARITY - 1)[None, :], width - 1)
        cur[:, on] = _resume(cur[:, on], state, grid[:, c[:, None], ahead], run - slot - 1, run)
        pos = pos // ARITY
    return cur


def _fold_above(cur: np.ndarray, chunk: np.ndarray, above: list[list[dict]]) -> np.ndarray:
    """The root for each lane whose chunk's top node is ``cur``; equal nodes of a chunk are folded once."""
    lanes, back = np.unique(np.vstack([chunk[None, :].astype(np.uint32), cur]).T, axis=0, return_inverse=True)
    chunk, cur = lanes[:, 0].astype(np.int64), np.ascontiguousarray(lanes[:, 1:].T)
    lengths = np.array([len(a) for a in above], np.int64)
    for k in range(int(lengths.max(initial=0))):
        steps = [a[k] if k < len(a) else None for a in above]
        state = _spread([s["state"] if s else b"" for s in steps], (1,))[:, :, 0]
        rights = _spread([s["right"] if s else b"" for s in steps], (max(ARITY - 1, 1),))
        more = np.array([len(s["right"]) // 32 if s else 0 for s in steps], np.int64)
        run = np.array([1 + (len(s["left"]) + len(s["right"])) // 32 if s else 0 for s in steps], np.int64)
        on = np.flatnonzero(lengths[chunk] > k)
        c = chunk[on]
        cur[:, on] = _resume(cur[:, on], state[:, c], rights[:, c], more[c], run[c])
    return cur[:, np.asarray(back).reshape(-1)]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each leaf: its proof's digest, and the root that its replacement, or else itself, folds to."""
    for batch in _slices(batches):
        flat, _ = _items(batch)
        counts, heights, nodes, states = _levels_of(batch)
        leaves, news = flat.field("_digest").to_pylist(), flat.field("_new").to_pylist()
        chunk, pos = np.repeat(np.arange(len(counts)), counts), np.concatenate([np.arange(n) for n in counts]) if len(counts) else np.zeros(0, np.int64)
        above = batch.column("_above").to_pylist()
        cur = sha256.from_bytes(b"".join(leaf if new is None else new for leaf, new in zip(leaves, news, strict=True)))
        folded = sha256.to_hex(_fold_above(_fold_own(cur, chunk, pos, counts, heights, nodes, states), chunk, above))
        upper = ["".join((s["left"] + s["right"]).hex() for s in steps) for steps in above]
        proofs = [
            hashlib.sha256(("".join((x + y).hex() for _, x, y in _way(p, nodes[c], states[c])) + upper[c]).encode()).hexdigest()
            for c, p in zip(chunk.tolist(), pos.tolist(), strict=True)
        ]
        roots, subroots = [r.hex() for r in batch.column("_root").to_pylist()], [r.hex() for r in batch.column("_subroot").to_pylist()]
        root = [roots[c] for c in chunk]
        columns = [[x.hex() for x in leaves], [subroots[c] for c in chunk], root, proofs, folded]
        yield pa.RecordBatch.from_arrays(
            [flat.field("_id"), *[pa.array(c, pa.string()) for c in columns], pa.array([a == b for a, b in zip(folded, root, strict=True)], pa.bool_())],
            names=["_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
        )


# --- Passes over the tree ---------------------------------------------------------------------


def _chunks(rows: DataFrame, carry: list[str]) -> DataFrame:
    """Chunk rows, hashed, of nodes (_g, _pos, _size, _digest); an item keeps ``carry`` too."""
    gathered = rows.groupBy("_g", F.floor(F.col("_pos") / WIDTH).cast("long").alias("_chunk")).agg(F.max("_size").alias("_size"), F.sort_array(F.collect_list(F.struct("_pos", "_digest", *carry))).alias("_items"))
    items = gathered.schema["_items"].dataType.simpleString()
    return persist_cut(in_workers(gathered, _build, f"_g string, _chunk long, _size long, _items {items}, _nodes binary, _states binary, _top binary"))


def _passes(leaves: DataFrame, carry: list[str]) -> list[DataFrame]:
    """Chunk rows of every pass, lowest first; in the last, each group is one chunk."""
    passes = [_chunks(leaves, carry)]
    while (passes[-1].agg(F.max("_size")).first()[0] or 0) > WIDTH:
        up = passes[-1].select("_g", F.col("_chunk").alias("_pos"), F.ceil(F.col("_size") / WIDTH).cast("long").alias("_size"), F.col("_top").alias("_digest"))
        passes.append(_chunks(up, []))
    return passes


def _descend(passes: list[DataFrame], ways: DataFrame) -> DataFrame:
    """The ways up (_g, _pos, _above, _subroot, _root) from the chunks of the lowest pass, given those from each group's top."""
    for chunks in reversed(passes[1:]):
        ways = in_workers(_with_ways(chunks, ways), _hand_down, f"_g string, _pos long, _above {STEPS}, _subroot binary, _root binary")
    return ways


def _with_ways(chunks: DataFrame, ways: DataFrame) -> DataFrame:
    return chunks.join(ways.withColumnRenamed("_pos", "_chunk"), ["_g", "_chunk"])


def manifest(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The chunk rows of every pass over ``leaves`` (_g, _id, _digest, _new), and the ways up from the chunks of the lowest."""
    passes = _passes(with_position(placed_in_order(leaves, "_g", ["_id", "_digest"]), "_g"), ["_id", "_new"])
    groups = placed_in_order(passes[-1].select(F.lit("").alias("_g"), F.col("_g").alias("_key"), F.col("_top").alias("_digest")), "_g", ["_key"])
    groups = persist_cut(with_position(groups, "_g"))
    top = _passes(groups, [])
    peak = top[-1].select("_g", F.lit(0).cast("long").alias("_pos"), F.expr(f"cast(array() as {STEPS})").alias("_above"), F.col("_top").alias("_subroot"), F.col("_top").alias("_root"))
    down = in_workers(_with_ways(top[0], _descend(top, peak)), _hand_down, f"_g string, _pos long, _above {STEPS}, _subroot binary, _root binary")
    ways = groups.select("_pos", "_key", "_digest").join(down, "_pos").select(F.col("_key").alias("_g"), F.lit(0).cast("long").alias("_pos"), "_above", F.col("_digest").alias("_subroot"), "_root")
    return passes, _descend(passes, ways)


def verify(leaves: DataFrame) -> DataFrame:
    """(_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each leaf, folded with its replacement if it has one."""
    passes, ways = manifest(leaves)
    of_id = passes[0].schema["_items"].dataType.elementType["_id"].dataType.simpleString()
    return in_workers(_with_ways(passes[0], ways), _fold, f"_id {of_id}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(persist_cut(tampered_leaves(table(spark, sf_dir, "documents")))).withColumnRenamed("_id", "doc_id")


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(x) for x in ("doc_id", "source", "lang", "{n}", "text")) + ")"

#: Level by level in recursive terms; a leaf's steps are its siblings with the side they stand on.
ORACLE = f"""
WITH RECURSIVE rows0 AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS g, {_LEAF.format(n='n_chars')} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND {crc32_sql('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_LEAF.format(n='(n_chars + 1)')} ELSE {_LEAF.format(n='n_chars')} END AS now
  FROM documents
),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM rows0),
tree(g, lvl, pos, digest, n) AS (
  SELECT g, 0, pos, leaf, n FROM leaves
  UNION ALL SELECT g, lvl + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, lvl, pos // 2
),
sub AS (SELECT g, digest, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top(lvl, pos, digest, n) AS (
  SELECT 0, pos, digest, n FROM sub
  UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, pos // 2
),
way AS (
  SELECT l.g, l.pos, o.lvl, s.digest, s.pos < o.pos AS before FROM leaves l JOIN tree o ON o.g = l.g AND o.n > 1 AND o.pos = l.pos >> o.lvl LEFT JOIN tree s ON s.g = o.g AND s.lvl = o.lvl AND s.pos = xor(o.pos, 1)
  UNION ALL
  SELECT l.g, l.pos, 1000 + o.lvl, s.digest, s.pos < o.pos FROM leaves l JOIN sub ON sub.g = l.g JOIN top o ON o.n > 1 AND o.pos = sub.pos >> o.lvl LEFT JOIN top s ON s.lvl = o.lvl AND s.pos = xor(o.pos, 1)
),
steps AS (SELECT g, pos, list(CASE WHEN digest IS NULL THEN 'N' WHEN before THEN 'L' || digest ELSE 'R' || digest END ORDER BY lvl) AS s FROM way GROUP BY g, pos),
folds AS (
  SELECT l.*, sub.digest AS subroot, (SELECT digest FROM top WHERE top.n = 1) AS root, coalesce(s, []) AS s FROM leaves l JOIN sub ON sub.g = l.g LEFT JOIN steps ON steps.g = l.g AND steps.pos = l.pos
),
done AS (
  SELECT *, list_reduce(list_prepend(now, s), lambda x, y: sha256(CASE left(y, 1) WHEN 'L' THEN substr(y, 2) || x WHEN 'R' THEN x || substr(y, 2) ELSE x END)) AS folded FROM folds
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(s, lambda x: substr(x, 2)), '')) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM done
"""
