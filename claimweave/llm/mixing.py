"""Mixing sources to target weights by Pfair scheduling (native).

Target weights are whole shares of a period. Each source's rows are
shuffled by a seeded hash and cut into blocks; block k (from 1) of a
source with share a of period L is released at slot floor((k - 1) * L / a)
and due at slot ceil(k * L / a). Earliest-deadline-first over released
blocks fills every slot, and at each slot every source is less than one
block from its target. As shares are whole, the schedule repeats after L
slots: one period is worked out in one expression over the small table of
sources, and every other block's slot follows from its place in its period.

Once a source has no blocks left its slots stay empty and are left out of
the order, so that the others go on in their proportions and every row is
kept exactly once. The deviation is counted in slots of the schedule.

Ranks, positions and slots come from one shuffle of narrow rows; the
schedule (one row for each slot of a period) and the sources (at most
``MOST_SOURCES``) are broadcast. ``mixed`` takes any number of sources: where
there are more, those whose weight is worth ``OWN_SLOTS`` slots of a period
have slots of their own, and the others share one group's. Within the group
row r of a source of weight w is due at r / w, and rows follow each other by
that time, so that each source keeps to its weight to within a row.
Block, release, deadline and slot of the group's rows are then the group's.

Defined cases: a null source is a source of its own; ties (repeated rows)
are broken by any order within their block; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.llm.ranking import bucket_count, seeded_hash, with_rank
from claimweave.llm.tables import persist_cut, table, unused

#: Rows of a block, shares of a period, and the power of its size that gives a source's default weight.
BLOCK_ROWS, PERIOD, TEMPERATURE, SEED = 16, 1000, 0.7, "mix-1"
#: Sources that have slots of their own, at most; where there are more, the slots that a source must be worth.
MOST_SOURCES, OWN_SLOTS = 500, 10
#: The group of the other sources; no source has this key.
OTHERS = "*"


def source_key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))


def tempered_shares(sizes: DataFrame, period: int = PERIOD, power: float = TEMPERATURE) -> DataFrame:
    """(_source, _size) to (_source, _size, _share): shares by size to ``power``, at least 1, that add up to ``period``.

    What rounding down leaves over goes to the largest source.
    """
    free = F.lit(period) - F.col("_k")
    every = F.struct(F.col("_size").alias("n"), F.col("_source").alias("s"))
    listed = sizes.groupBy().agg(F.array_sort(F.collect_list(every)).alias("l")).withColumn("_k", F.size("l"))
    total = F.aggregate("l", F.lit(0.0), lambda acc, x: acc + F.pow(x["n"].cast("double"), F.lit(power)))
    whole = listed.withColumn("_t", total).withColumn("m", F.transform("l", lambda x: F.struct(x["n"].alias("n"), x["s"].alias("s"), (F.floor(free * F.pow(x["n"].cast("double"), F.lit(power)) / F.col("_t")) + 1).alias("a"))))
    left = F.lit(period) - F.aggregate("m", F.lit(0).cast("long"), lambda acc, x: acc + x["a"])
    exploded = whole.withColumn("_left", left).select("_k", "_left", F.posexplode("m").alias("i", "x"))
    return exploded.select(F.col("x.s").alias("_source"), F.col("x.n").alias("_size"), (F.col("x.a") + F.when(F.col("i") == F.col("_k") - 1, F.col("_left")).otherwise(0)).alias("_share"))


def one_period(shares: DataFrame, period: int) -> DataFrame:
    """(_source, _nth, _slot): the slot of each source's n-th block (both from 0) in a period, earliest deadline first."""
    listed = shares.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("_source").alias("s"), F.col("_share").cast("int").alias("a")))).alias("l")).filter("size(l) > 0")
    # State: how many blocks each source has had, and who had each slot.
    pick = f"""
      aggregate(sequence(0, {period} - 1),
        named_struct('had', transform(l, x -> 0), 'order', cast(array() as array<int>), 'next', -1),
        (state, t) -> transform(array(
            array_min(transform(l, (x, i) -> if(state.had[i] < x.a and state.had[i] * {period} div x.a <= t,
              named_struct('due', ((state.had[i] + 1) * {period} + x.a - 1) div x.a, 'i', i), null))).i), n ->
          named_struct('had', transform(state.had, (h, i) -> if(i = n, h + 1, h)), 'order', concat(state.order, array(cast(n as int))), 'next', n))[0],
        state -> state.order)"""
    slots = listed.select("l", F.posexplode(F.expr(pick)).alias("_slot", "_i"))
    one = slots.select(F.expr("l[_i].s").alias("_source"), "_slot")
    return one.groupBy("_source").agg(F.array_sort(F.collect_list("_slot")).alias("_slots")).select("_source", F.posexplode("_slots").alias("_nth", "_slot"))


def _ranked(rows: DataFrame, total: int) -> DataFrame:
    return with_rank(rows, "_source", ["_hash", "_id", "_crc"], bucket_count(total), "_hash")


def _grouped_shares(sizes: DataFrame, period: int) -> DataFrame:
    """As ``tempered_shares``, for many sources: those worth OWN_SLOTS have their whole slots, the group of the others the rest."""
    weighed = sizes.withColumn("_weight", F.pow(F.col("_size").cast("double"), F.lit(TEMPERATURE)))
    worth = period / weighed.agg(F.sum("_weight")).first()[0]
    own = weighed.select("_source", "_size", F.floor(F.col("_weight") * worth).alias("_share")).filter(f"_share >= {OWN_SLOTS}")
    own = persist_cut(own)
    taken = own.agg(F.coalesce(F.sum("_share"), F.lit(0))).first()[0]
    rest = sizes.join(F.broadcast(own.select("_source")), "_source", "left_anti").agg(F.sum("_size").alias("_size"))
    return own.unionByName(rest.select(F.lit(OTHERS).alias("_source"), "_size", F.lit(period - taken).cast("long").alias("_share")))


def _grouped(ranked: DataFrame, shares: DataFrame) -> DataFrame:
    """Ranked rows of all sources; those of the group have its key, and their rank in it by the time at which they are due."""
    own = F.broadcast(shares.select("_source"))
    rest = ranked.join(own, "_source", "left_anti").withColumn("_due", F.col("_rank") / F.pow(F.col("_size").cast("double"), F.lit(TEMPERATURE)))
    # Sorted by ranges: a row's rank is its place in its partition, after those before.
    rest = persist_cut(persist_cut(rest.orderBy("_due", "_source", "_rank")).withColumn("_place", F.monotonically_increasing_id()))
    rest = rest.withColumns({"_part": F.shiftright("_place", 33), "_row": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = rest.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    rest = rest.join(F.broadcast(before), "_part").withColumns({"_rank": F.col("_before") + F.col("_row") + 1, "_source": F.lit(OTHERS)})
    return ranked.join(own, "_source", "left_semi").unionByName(rest.select(*ranked.columns))


def mixed(docs: DataFrame, carry: tuple[str, ...] = (), period: int = PERIOD, crc: Column | None = None, **options) -> DataFrame:  # noqa: ANN003
    """As ``schedule``, for any number of sources; ``carry`` names columns of ``docs`` to pass on."""
    sizes = persist_cut(docs.groupBy(source_key(options.get("source_col", "source")).alias("_source")).agg(F.count(F.lit(1)).alias("_size")))
    if sizes.count() <= MOST_SOURCES:
        return schedule(docs, tempered_shares(sizes, period), period, carry=carry, crc=crc, **options)
    return schedule(docs, _grouped_shares(sizes, period), period, carry=carry, crc=crc, grouped=True, **options)


def schedule(docs: DataFrame, shares: DataFrame | None = None, period: int = PERIOD, block_rows: int = BLOCK_ROWS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = (), crc: Column | None = None, grouped: bool = False) -> DataFrame:
    """id, source, block, release, deadline, slot, position (from 0, gapless) of every row.

    ``shares``: (_source as ``source_key`` gives it, _size, _share), shares adding up to ``period``;
    if ``grouped``, sources that it lacks are in the group ``OTHERS``. ``crc``: the text's checksum, if
    ``docs`` has it in place of the text.
    """
    if crc is None:
        crc = F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), source_key(source_col).alias("_source"), crc.alias("_crc"), *carry).withColumn("_hash", seeded_hash(seed, "_id"))
    sizes = docs.groupBy(source_key(source_col).alias("_source")).agg(F.count(F.lit(1)).alias("_size"))
    if shares is None:
        sizes = persist_cut(sizes)
        known = sizes.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("_size"), F.lit(0)).alias("n")).first()
        if known["k"] > MOST_SOURCES:
            raise ValueError(f"{known['k']} sources; at most {MOST_SOURCES} can have slots of their own, mixed() takes any number")
        total = known["n"]
        shares = tempered_shares(sizes, period)
    else:
        total = docs.count()
    shares = persist_cut(shares)  # a row for each source
    slots = persist_cut(one_period(shares, period))  # a row for each slot of a period
    ranked = _ranked(rows, total)
    ranked = (_grouped(ranked, shares) if grouped else ranked).drop("_size")
    placed = (
        ranked.join(F.broadcast(shares), "_source")
        .withColumn("_block", F.expr(f"(_rank - 1) div {block_rows}"))
        .withColumn("_cycle", F.expr("_block div _share"))
        .withColumn("_nth", F.expr("cast(_block % _share as int)"))
        .join(F.broadcast(slots), ["_source", "_nth"])
    )
    # Rows before a slot: of each source the blocks that its earlier slots hold, or all it has.
    listed = shares.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("_source").alias("s"), F.col("_share").alias("a"), F.col("_size").alias("n")))).alias("l")).filter("size(l) > 0")
    had = slots.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("_slot").alias("t"), F.col("_source").alias("s")))).alias("o"))
    # had_before[t][i]: blocks of source i in slots before t.
    table_of = listed.withColumn("_one", F.lit(1)).join(had.withColumn("_one", F.lit(1)), "_one").select("l", F.expr("""
      aggregate(o, named_struct('sofar', transform(l, x -> 0), 'rows', cast(array() as array<array<int>>)),
        (state, p) -> named_struct('sofar', transform(state.sofar, (h, i) -> if(l[i].s = p.s, h + 1, h)), 'rows', concat(state.rows, array(state.sofar))),
        state -> state.rows)""").alias("r"))
    prefix = persist_cut(table_of.select("l", F.posexplode("r").alias("_slot", "_had")))
    out = placed.join(F.broadcast(prefix), "_slot").withColumn("_before", F.expr(f"aggregate(zip_with(l, _had, (x, h) -> least(x.n, {block_rows} * (_cycle * x.a + h))), 0L, (acc, x) -> acc + x)"))
    return out.select(
        F.col("_id").alias(id_col), "source",
        F.col("_block").cast("long").alias("block"),
        F.expr(f"_block * {period} div _share").cast("long").alias("release"),
        F.expr(f"((_block + 1) * {period} + _share - 1) div _share").cast("long").alias("deadline"),
        (F.col("_cycle") * period + F.col("_slot")).cast("long").alias("slot"),
        (F.col("_before") + (F.col("_rank") - 1) % block_rows).cast("long").alias("position"),
        *carry,
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def ordered(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The rows of ``docs`` with their columns, in the order of the schedule.

    Spark sorts by ranges of the position, so that files follow each other
    in the mixture's order. Ids are matched null-safely, so rows that share
    an id stand together at the first of its places; no row is lost.
    """
    id_col = options.get("id_col", "doc_id")
    placed_id, position = unused(docs, "_placed_id", "_position")
    places = mixed(docs, **options).groupBy(F.col(id_col).alias(placed_id)).agg(F.min("position").alias(position))
    keyed = docs.join(places, docs[id_col].eqNullSafe(places[placed_id]), "left")
    return keyed.orderBy(position).select(*[docs[c] for c in docs.columns])


ORACLE = f"""
WITH RECURSIVE src AS (SELECT coalesce('=' || source, '-') AS s, count(*) AS n FROM documents GROUP BY 1),
t AS (SELECT count(*) AS k, sum(pow(n, {TEMPERATURE})) AS w FROM src),
floors AS (SELECT s, n, CAST(floor(({PERIOD} - k) * pow(n, {TEMPERATURE}) / w) AS BIGINT) + 1 AS a FROM src, t),
sh AS (SELECT s, a + CASE WHEN row_number() OVER (ORDER BY n DESC, s DESC) = 1 THEN {PERIOD} - CAST(sum(a) OVER () AS BIGINT) ELSE 0 END AS a,
              row_number() OVER (ORDER BY s) - 1 AS i FROM floors),
lst AS (SELECT list(a ORDER BY s) AS l FROM sh),
period AS (
  SELECT 0 AS t, list_transform(l, lambda x: CAST(0 AS BIGINT)) AS had, CAST(NULL AS BIGINT) AS p FROM lst
  UNION ALL
  SELECT t + 1, list_transform(had, lambda h, j: h + CASE WHEN j - 1 = q THEN 1 ELSE 0 END), q
  FROM (SELECT t, had, list_min(list_transform(range(len(l)), lambda i:
          CASE WHEN had[i + 1] < l[i + 1] AND had[i + 1] * {PERIOD} // l[i + 1] <= t
               THEN ((had[i + 1] + 1) * {PERIOD} + l[i + 1] - 1) // l[i + 1] * 100000 + i END)) % 100000 AS q
        FROM period, lst WHERE t < {PERIOD})
),
slots AS (SELECT t - 1 AS slot, p AS i, row_number() OVER (PARTITION BY p ORDER BY t) - 1 AS nth FROM period WHERE t > 0),
r AS (SELECT doc_id, source, coalesce('=' || source, '-') AS s,
             row_number() OVER (PARTITION BY coalesce('=' || source, '-') ORDER BY md5('{SEED}|=' || doc_id), doc_id) AS r FROM documents),
b AS (SELECT doc_id, source, r, a, (r - 1) // {BLOCK_ROWS} AS block, i FROM r JOIN sh USING (s)),
placed AS (SELECT doc_id, source, r, a, block, (block // a) * {PERIOD} + slots.slot AS slot FROM b JOIN slots ON slots.i = b.i AND slots.nth = block % a)
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(block * {PERIOD} // a AS BIGINT) AS release,
       CAST(((block + 1) * {PERIOD} + a - 1) // a AS BIGINT) AS deadline, CAST(slot AS BIGINT) AS slot,
       CAST(row_number() OVER (ORDER BY slot, r) - 1 AS BIGINT) AS position
FROM placed
"""
