"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. A turn's place and content
give eight 32-bit numbers, whose sums along a conversation name each of its
prefixes; sums run over range-sorted parts, so one conversation may hold
any number of turns. From then on a node is known by its smallest member
and its depth.

Totals over subtrees come from contraction. A round compresses and rakes.
Compress removes every node with a single child: pointers double along
unary chains, each adding what lies between, until all point at the chain's
end, and the chain's sum moves to the node above it. Rake removes the
leaves, whose totals are then known, and adds them to their parents. After
a compress at least half of the nodes are leaves, so the rounds grow with
the logarithm of the nodes, and those of a chain with that of its length.
Contracted chains are then re-expanded, last round first: a node's total is
its sum down to the chain's end plus the end's total.

Defined cases: turns of equal number are ordered by a digest of their role
and text. A null role or text is empty, a null turn comes first. Rows
without ``conv_id`` belong to no conversation and are left out. Repeated
rows are turns of their own. Texts of any length are hashed where they are
read. Other columns are not read, whatever their names. No conversations
give no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.llm.ranking import part_shifts, placed_in_order, running_before
from claimweave.llm.tables import crc32_sql, in_workers, persist_cut, table

#: The conversation that lends its first turns: ids are grouped by so many; fewer turns than this are lent.
FAMILY, MOST_LENT = 100, 6
#: 32-bit numbers whose sums name a prefix.
SUMS = [f"_s{i}" for i in range(8)]
#: Ids in a piece of the list of a node's ends.
PIECE = 256


def _part(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def turns(conversations: DataFrame) -> DataFrame:
    """(_c, _turn, _h, _len) of each turn: its conversation, number, digest of role and text, and the text's code points."""
    content = F.concat(F.octet_length(_text("role")).cast("string"), F.lit(":"), _text("role"), _text("text"))
    return conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").alias("_c"), F.col("turn").alias("_turn"), F.sha2(content, 256).alias("_h"), F.length(_text("text")).cast("long").alias("_len"))


def lent() -> Column:
    """How many first turns conversation ``_c`` takes from the head of its family."""
    return (F.crc32(F.col("_c").cast("string").cast("binary")) % MOST_LENT).cast("long")


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds the numbers of a turn at depth ``_d``."""
    at = F.sha2(F.concat(F.col("_d").cast("string"), F.lit(":"), F.col("_h")), 256)
    return rows.withColumn("_at", at).select("*", *[_part(F.col("_at"), i).alias(s) for i, s in enumerate(SUMS)]).drop("_at", "_h")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_c, _d, _len, _end, _key, _up) of each turn of the rebuilt conversations, and (_c, _depth) of each conversation.

    ``_key`` and ``_up`` name the prefixes that end at the turn and before it; ``_end`` marks the last turn.
    """
    placed = placed_in_order(rows, "_c", ["_turn", "_h"])
    shifts = persist_cut(part_shifts(placed, "_c"))
    place = F.col("_row") + F.col("_shift")
    of_heads = placed.filter(F.col("_c") % FAMILY == 0).join(shifts, ["_c", "_part"]).filter(place < MOST_LENT - 1)
    heads = persist_cut(of_heads.select(F.col("_c").alias("_head"), (place + 1).alias("_d"), "_h", "_len"))
    has = heads.groupBy("_head").agg(F.max("_d").alias("_has"))
    sizes = shifts.groupBy("_c").agg(F.max("_size").alias("_n")).withColumns({"_lent": lent(), "_head": F.col("_c") - F.col("_c") % FAMILY})
    taken = F.least("_lent", F.coalesce("_has", F.lit(0).cast("long")))
    convs = persist_cut(
        sizes.join(has, "_head", "left").withColumn("_from", taken)
        .select("_c", "_lent", "_head", "_from", (F.col("_from") + F.greatest(F.col("_n") - F.col("_lent"), F.lit(0))).alias("_depth"))
    )
    last = (F.col("_d") == F.col("_depth")).alias("_end")
    borrowed = persist_cut(_numbered(convs.join(heads, "_head").filter("_d <= _from").select("_c", "_d", "_len", last, "_h")))
    by_conv = Window.partitionBy("_c").orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = borrowed.select("_c", "_d", "_len", "_end", *SUMS, *[F.sum(s).over(by_conv).alias("_t" + s) for s in SUMS])
    given = borrowed.groupBy("_c").agg(*[F.sum(s).alias("_g" + s) for s in SUMS])
    # Own turns: sums within each part of the sort, then those of the conversation's parts before it.
    parts = shifts.join(convs, "_c").select("_c", "_part", "_shift", "_lent", "_from", "_depth")
    own = placed.join(parts, ["_c", "_part"]).filter(place >= F.col("_lent")).withColumn("_d", F.col("_from") + place - F.col("_lent") + 1)
    within = Window.partitionBy("_c", "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = _numbered(own.select("_c", "_part", "_row", "_d", "_len", last, "_h"))
    summed = persist_cut(numbered.select("_c", "_part", "_d", "_len", "_end", *SUMS, *[F.sum(s).over(within).alias("_t" + s) for s in SUMS]))
    totals = summed.groupBy("_c", "_part").agg(*[F.sum(s).alias(s) for s in SUMS])
    before = totals.join(given, "_c", "left").select("_c", "_part", *[(running_before(totals, "_c", s) + F.coalesce("_g" + s, F.lit(0))).alias("_b" + s) for s in SUMS])
    rest = summed.join(before, ["_c", "_part"]).select("_c", "_d", "_len", "_end", *SUMS, *[(F.col("_t" + s) + F.col("_b" + s)).alias("_t" + s) for s in SUMS])
    upto, above = [F.col("_t" + s) for s in SUMS], [F.col("_t" + s) - F.col(s) for s in SUMS]
    named = first.unionByName(rest).select("_c", "_d", "_len", "_end", *[F.unhex(F.sha2(F.concat_ws(":", *sums), 256)).alias(n) for n, sums in (("_key", upto), ("_up", above))])
    return named, convs.select("_c", "_depth")


def trie(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, n_children, _own), and ends (conv_id, depth, _c) of the rebuilt conversations."""
    rows, convs = rebuilt(turns(conversations))
    found = rows.groupBy("_d", "_key").agg(F.min("_c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("_up").alias("_up"), F.first("_len").alias("_len"))
    below = persist_cut(found)
    no, nothing = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("_c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    names = below.select((F.col("_d") + 1).alias("_d"), F.col("_key").alias("_up"), F.col("conv_id").alias("parent_conv_id"))
    deep = below.filter("_d > 1").join(names, ["_d", "_up"])
    shallow = below.filter("_d = 1").crossJoin(root.select(F.col("conv_id").alias("parent_conv_id")))
    columns = ("conv_id", F.col("_d").alias("depth"), "parent_conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("_len")).alias("_own"))
    nodes = persist_cut(deep.select(*columns).unionByName(shallow.select(*columns)).unionByName(root.select("conv_id", no.alias("depth"), nothing.alias("parent_conv_id"), "n_convs", no.alias("_own"))))
    children = nodes.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = persist_cut(nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", no)))
    ends = rows.filter("_end").select("_d", "_key", "_c").join(below.select("_d", "_key", "conv_id"), ["_d", "_key"]).select("conv_id", F.col("_d").alias("depth"), "_c")
    turnless = convs.filter("_depth = 0").select("_c").crossJoin(root.select("conv_id")).select("conv_id", no.alias("depth"), "_c")
    return tree, ends.unionByName(turnless)


# --- Contraction ------------------------------------------------------------------------------

VALUES = ("_leaves", "_saved")


def _named(frame: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return frame.select(*[F.col(c).alias(prefix + c) for c in columns])


def _with_added(nodes: DataFrame, added: DataFrame) -> DataFrame:
    """The nodes (_c, _d, ...) with the sums of the rows of ``added`` that name them as parent (_pc, _pd)."""
    sums = added.groupBy(F.col("_pc").alias("_c"), F.col("_pd").alias("_d")).agg(*[F.sum(v).alias("_m" + v) for v in VALUES])
    return nodes.join(sums, ["_c", "_d"], "left").select("_c", "_d", "_pc", "_pd", *[(F.col(v) + F.coalesce("_m" + v, F.lit(0))).alias(v) for v in VALUES])


def _chains(live: DataFrame) -> DataFrame:
    """Unary nodes (_c, _d) but the root, the end (_ec, _ed) of the chain of each, their sum down to it, and parent.

    While ``_on``, a pointer is so many nodes ahead and itself in a chain:
    no two rows point at the same, so each doubling joins unique keys.
    """
    kids = live.filter("_pc IS NOT NULL").groupBy(F.col("_pc").alias("_c"), F.col("_pd").alias("_d")).agg(F.count(F.lit(1)).alias("_k"), F.max("_c").alias("_ec"), F.max("_d").alias("_ed"))
    unary = persist_cut(live.filter("_pc IS NOT NULL").join(kids.filter("_k = 1").drop("_k"), ["_c", "_d"]))
    chains = persist_cut(unary.join(_named(unary, "_n", "_c", "_d"), (F.col("_ec") == F.col("_n_c")) & (F.col("_ed") == F.col("_n_d")), "left").withColumn("_on", F.col("_n_c").isNotNull()).drop("_n_c", "_n_d"))
    while not chains.filter("_on").isEmpty():
        ahead = _named(chains, "_n", "_c", "_d", "_ec", "_ed", "_on", *VALUES)
        moved = chains.filter("_on").join(ahead, (F.col("_ec") == F.col("_n_c")) & (F.col("_ed") == F.col("_n_d"))).select(
            "_c", "_d", "_pc", "_pd", F.col("_n_ec").alias("_ec"), F.col("_n_ed").alias("_ed"), F.col("_n_on").alias("_on"), *[(F.col(v) + F.col("_n" + v)).alias(v) for v in VALUES]
        )
        chains = persist_cut(chains.filter("NOT _on").unionByName(moved))
    return chains.drop("_on")


def _compressed(live: DataFrame, chains: DataFrame) -> DataFrame:
    """The live nodes without those in chains: a chain's end hangs below the node above it, which takes the chain's sum."""
    ids = chains.select("_c", "_d")
    heads = persist_cut(chains.join(_named(ids, "_n", "_c", "_d"), (F.col("_pc") == F.col("_n_c")) & (F.col("_pd") == F.col("_n_d")), "left_anti"))
    moved = heads.select(F.col("_ec").alias("_c"), F.col("_ed").alias("_d"), F.col("_pc").alias("_h_c"), F.col("_pd").alias("_h_d"))
    kept = live.join(ids, ["_c", "_d"], "left_anti").join(moved, ["_c", "_d"], "left").select("_c", "_d", F.coalesce("_h_c", "_pc").alias("_pc"), F.coalesce("_h_d", "_pd").alias("_pd"), *VALUES)
    return persist_cut(_with_added(kept, heads))


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """(_c, _d, values) of each node (_c, _d, parent _pc, _pd, values), the values summed over its subtree."""
    live, known, rounds = persist_cut(nodes), [], []
    while not live.isEmpty():
        chains = _chains(live)
        if not chains.isEmpty():
            rounds.append(chains)
            live = _compressed(live, chains)
        parents = live.filter("_pc IS NOT NULL").select(F.col("_pc").alias("_c"), F.col("_pd").alias("_d")).distinct()
        leaves = persist_cut(live.join(parents, ["_c", "_d"], "left_anti"))
        known.append(leaves.select("_c", "_d", *VALUES))
        live = persist_cut(_with_added(live.join(parents, ["_c", "_d"], "left_semi"), leaves))
    for chains in reversed(rounds):
        ends = known[0]
        for more in known[1:]:
            ends = ends.unionByName(more)
        below = chains.select("_c", "_d", "_ec", "_ed", *VALUES).join(_named(ends, "_n", "_c", "_d", *VALUES), (F.col("_ec") == F.col("_n_c")) & (F.col("_ed") == F.col("_n_d")))
        known.append(persist_cut(below.select("_c", "_d", *[(F.col(v) + F.col("_n" + v)).alias(v) for v in VALUES])))
    out = known[0] if known else nodes.select("_c", "_d", *VALUES)
    for more in known[1:]:
        out = out.unionByName(more)
    return out


# --- Ends of conversations --------------------------------------------------------------------


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each node, of rows sorted by node and piece; a node's list is never held, only its hash state."""
    node, state = None, None
    for batch in batches:
        done: list[tuple] = []
        for conv, depth, piece in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "_piece")), strict=True):
            if (conv, depth) == node:
                state.update(b"," + piece.encode())
                continue
            if node is not None:
                done.append((*node, state.hexdigest()))
            node, state = (conv, depth), hashlib.sha256(piece.encode())
        if done:
            yield _as_batch(done)
    if node is not None:
        yield _as_batch([(*node, state.hexdigest())])


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "depth", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of each node where conversations end.

    A range sort cuts the ids into pieces of a bounded number; the digest of
    a node, which can only be computed from left to right, reads those.
    """
    placed = placed_in_order(ends, "conv_id", ["depth", "_c"])
    pieces = placed.groupBy("conv_id", "depth", "_part", F.floor(F.col("_row") / PIECE).alias("_at")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("_c")), lambda c: c.cast("string")), ",").alias("_piece"))
    in_order = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "_part", "_at")
    return in_workers(in_order.select("conv_id", "depth", "_piece"), _digests, "conv_id long, depth long, ends_sha256 string")


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    tree, ends = trie(conversations)
    above = F.when(F.col("parent_conv_id").isNotNull(), F.col("depth") - 1)
    nodes = tree.select(F.col("conv_id").alias("_c"), F.col("depth").alias("_d"), F.col("parent_conv_id").alias("_pc"), above.alias("_pd"), (F.col("n_children") == 0).cast("long").alias("_leaves"), F.col("_own").alias("_saved"))
    totals = subtree_totals(nodes).select(F.col("_c").alias("conv_id"), F.col("_d").alias("depth"), F.col("_leaves").alias("n_leaves"), F.col("_saved").alias("saved_tokens"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    full = tree.drop("_own").join(totals, ["conv_id", "depth"]).join(end_digests(ends), ["conv_id", "depth"], "left")
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_nodes(table(spark, sf_dir, "conversations"))


#: Whole prefixes as lists; every node lies on the paths of its ancestors' least members.
ORACLE = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS p FROM turns),
n AS (SELECT conv_id, count(*) AS n FROM o GROUP BY 1),
c AS (SELECT n.conv_id, {crc32_sql('CAST(n.conv_id AS VARCHAR)')} % 6 AS h, least({crc32_sql('CAST(n.conv_id AS VARCHAR)')} % 6, coalesce(b.n, 0)) AS f FROM n LEFT JOIN n b ON b.conv_id = n.conv_id - n.conv_id % {FAMILY}),
r AS (SELECT c.conv_id AS c, p AS d, role, text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % {FAMILY} AND p <= f UNION ALL SELECT c.conv_id, f + p - h, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND p > h),
m AS (SELECT c, d, length(text) AS len, list([role, text]) OVER (PARTITION BY c ORDER BY d) AS k FROM r UNION ALL SELECT conv_id, 0, 0, [] FROM c),
node AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(len) AS len FROM m GROUP BY d, k),
mn AS (SELECT m.c, m.d, node.conv_id FROM m JOIN node ON node.d = m.d AND node.k = m.k),
up AS (SELECT node.conv_id, node.d, mn.conv_id AS parent, (n_convs - 1) * len AS saved, n_convs FROM node LEFT JOIN mn ON mn.c = node.conv_id AND mn.d = node.d - 1),
kids AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n FROM up WHERE d > 0 GROUP BY 1, 2),
one AS (SELECT up.*, coalesce(kids.n, 0) AS n_children FROM up LEFT JOIN kids USING (conv_id, d)),
total AS (SELECT mn.conv_id, mn.d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM one JOIN mn ON mn.c = one.conv_id AND mn.d <= one.d GROUP BY 1, 2),
ends AS (SELECT mn.conv_id, mn.d, string_agg(CAST(mn.c AS VARCHAR), ',' ORDER BY mn.c) AS ids FROM mn JOIN (SELECT c, max(d) AS d FROM m GROUP BY 1) z ON z.c = mn.c AND z.d = mn.d GROUP BY 1, 2)
SELECT conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM one JOIN total USING (conv_id, d) LEFT JOIN ends USING (conv_id, d)
"""
