"""Documents to events: exact and near duplicates, mentions, triage and entity resolution."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.functions import score, text
from claimweave.session import cut

#: Bits in which near-duplicates may differ, and events that are looked back on.
BITS, RECENT = 3, 2000


def exact_duplicates(events: DataFrame) -> DataFrame:
    """Adds hash, lineage (the earliest event with the hash) and status of (event_id, fetched, text).

    The earliest is an aggregate that is joined back, so a hash with very
    many copies is counted map-side and never sorted in one task.
    """
    hashed = events.select("event_id", "fetched", F.sha2("text", 256).alias("hash"))
    first = hashed.groupBy("hash").agg(F.min(F.struct("fetched", "event_id"))["event_id"].alias("lineage_id"))
    return hashed.join(first, "hash").withColumn("status", F.when(F.col("event_id") == F.col("lineage_id"), "pending").otherwise("duplicate"))


@F.pandas_udf(T.LongType())
def simhash64(texts: pd.Series) -> pd.Series:
    """Signed 64-bit simhash of lower-cased three-word shingles, repeated ones counted; 0 without words."""
    import numpy as np

    def one(value: str | None) -> int:
        words = (value or "").lower().split()
        if not words:
            return 0
        parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
        codes = np.frombuffer(b"".join(hashlib.blake2b(p.encode("utf-8", "replace"), digest_size=8).digest() for p in parts), dtype=">u8")
        bits = np.unpackbits(codes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        high = 2 * bits.sum(0, dtype=np.int64) > len(codes)
        return int(np.packbits(high).view(">i8")[0])

    return texts.map(one).astype("int64") if len(texts) else pd.Series([], dtype="int64")


def simhash_md5(value):  # noqa: ANN001, ANN201
    """The same sketch over 60 bits of MD5, in SQL functions only."""
    words = F.filter(F.split(F.lower(value), r"\s+"), lambda w: w != "")
    n = F.size(words)
    parts = F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(3)), " "))).when(n > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
    codes = F.transform(parts, lambda p: F.conv(F.substring(F.md5(p.cast("binary")), 1, 15), 16, 10).cast("long"))
    zero = F.array_repeat(F.lit(0), 60)
    sums = F.aggregate(codes, zero, lambda acc, c: F.transform(acc, lambda s, i: s + F.getbit(c, i).cast("int")))
    weighed = F.transform(sums, lambda s, i: F.when(2 * s > F.size(codes), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(weighed, F.lit(0).cast("long"), lambda acc, b: acc + b)


def arrival_ranks(rows: DataFrame) -> DataFrame:
    """``position`` replaced by the row's gapless place in order of arrival, from 0; ties by event.

    Rows are range-sorted and numbered within their parts; only the sizes of the parts are summed in one task.
    """
    at = rows.repartitionByRange("position", "event_id").sortWithinPartitions("position", "event_id").withColumn("_at", F.monotonically_increasing_id())
    placed = cut(at).withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    shifts = sizes.select("_part", (F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(F.broadcast(shifts), "_part").withColumn("position", F.col("_row") + F.col("_shift")).select(*rows.columns)


def lineages(parents: DataFrame) -> DataFrame:
    """(event_id, lineage_id) of each (event_id, near_id): the event at which the chain of near_id ends; null ends it.

    Pointers double, so a chain of n copies of copies takes log n joins.
    """
    chain = cut(parents.select("event_id", F.coalesce("near_id", "event_id").alias("_to")))
    while True:
        ahead = chain.filter("_to != event_id").select(F.col("event_id").alias("_at"), F.col("_to").alias("_next"))
        step = chain.join(ahead, chain["_to"] == ahead["_at"], "left").select("event_id", F.coalesce("_next", "_to").alias("_to"), F.col("_next").isNotNull().alias("_moved"))
        chain = cut(step)
        if chain.filter("_moved").isEmpty():
            return chain.select("event_id", F.col("_to").alias("lineage_id"))
        chain = chain.drop("_moved")


def near_duplicates(events: DataFrame, bits: int = BITS, recent: int = RECENT) -> DataFrame:
    """(event_id, near_id): the latest earlier event, of the last ``recent``, within ``bits`` bits of the simhash.

    Four 16-bit bands: of two hashes at most three bits apart one band is
    equal, so an equi-join on bands misses none. ``position`` is the order of
    arrival; events without words (simhash 0) and gaps take up no places. Events of one hash are joined through the hash's latest earlier
    positions, not through all pairs: hashes are joined, and each event then
    takes the latest position before its own among the hashes near its own.
    """
    rows = arrival_ranks(cut(events.select("event_id", "position", "simhash")).filter("simhash != 0"))  # the sketch is costly and used five times
    # Blocks of ``recent`` positions: a partner is in the same block or the one before.
    rows = rows.withColumn("_block", F.expr(f"position div {recent}"))
    band = lambda h: F.posexplode(F.array(*[F.shiftrightunsigned(h, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]))
    hashes = rows.select("simhash", "_block").distinct()
    later = hashes.select(F.col("simhash").alias("h1"), F.col("_block").alias("k1"), band(F.col("simhash")).alias("band", "value"))
    earlier = hashes.select(F.col("simhash").alias("h2"), F.col("_block").alias("k2"), F.explode(F.array(F.col("_block"), F.col("_block") + 1)).alias("k1"), band(F.col("simhash")).alias("band", "value"))
    near = later.join(earlier, ["k1", "band", "value"]).filter(F.bit_count(F.col("h1").bitwiseXOR(F.col("h2"))) <= bits).select("h1", "k1", "h2", "k2").distinct()
    # Positions of each hash in a block, as one sorted list of at most ``recent``.
    places = rows.groupBy(F.col("simhash").alias("h2"), F.col("_block").alias("k2")).agg(F.array_sort(F.collect_list(F.struct("position", "event_id"))).alias("at"))
    around = near.join(places, ["h2", "k2"]).groupBy("h1", "k1").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))
    mine = rows.join(around, (rows["simhash"] == around["h1"]) & (rows["_block"] == around["k1"]))
    before = F.filter("at", lambda p: (p["position"] < F.col("position")) & (p["position"] >= F.col("position") - recent))
    return mine.select("event_id", F.try_element_at(before, F.lit(-1))["event_id"].alias("near_id")).filter("near_id is not null")


def triage(events: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Scores pending events; fast ones of a watched ticker raise an alert."""
    scored = events.filter("status = 'pending'").select("event_id", "ticker", score.materiality(F.col("connector"), F.col("form"), F.col("items"), F.col("title")).alias("materiality"))
    watched = watchlist.filter("active").select("ticker").distinct().withColumn("_watched", F.lit(True))
    fast = F.col("materiality") >= score.FAST_FROM
    return scored.join(watched, "ticker", "left").select("event_id", "materiality", F.when(fast, "fast").otherwise("slow").alias("route"), (fast & F.coalesce("_watched", F.lit(False))).alias("alert"))


def write_mentions(tagged: DataFrame) -> DataFrame:
    """One row for each distinct trimmed surface of an event; pending if any tag is a company or security."""
    some = tagged.select("event_id", F.trim("surface").alias("surface"), "tag").filter("surface != ''")
    return some.groupBy("event_id", "surface").agg(F.when(F.bool_or(F.col("tag").isin("company", "security")), "pending").otherwise("skipped-v0").alias("state"))


def resolve(mentions: DataFrame, alias: DataFrame, tickers: DataFrame, names: DataFrame) -> DataFrame:
    """Tiers in order: alias, ticker, exact name, stripped name if unique. Each is an equi-join of distinct surfaces.

    alias (surface, entity), tickers (ticker, entity), names (name, entity).
    """
    surface = mentions.select("surface").distinct().withColumn("_norm", text.norm(F.col("surface"))).withColumn("_bare", text.strip_suffix(F.col("surface")))
    one = lambda frame, key, name: frame.groupBy(key.alias(f"_k_{name}")).agg(F.min("entity").alias(f"_{name}"), F.countDistinct("entity").alias(f"_n_{name}"))
    tables = {
        "alias": (one(alias, text.norm(F.col("surface")), "alias"), "_norm"),
        "ticker": (one(tickers, F.upper(F.trim("ticker")), "ticker"), "_norm"),
        "exact": (one(names, text.norm(F.col("name")), "exact"), "_norm"),
        "stripped": (one(names, text.strip_suffix(F.col("name")), "stripped").filter("_n_stripped = 1"), "_bare"),
    }
    found = surface
    for name, (keyed, column) in tables.items():
        found = found.join(keyed, (found[column] == keyed[f"_k_{name}"]) & (found[column] != ""), "left")
    tier = F.when(F.col("_alias").isNotNull(), "alias").when(F.col("_ticker").isNotNull(), "ticker").when(F.col("_exact").isNotNull(), "name_exact").when(F.col("_stripped").isNotNull(), "name_stripped").otherwise("queue")
    confidence = F.when(tier.isin("alias", "name_exact"), 0.95).when(tier == "ticker", 0.85).when(tier == "name_stripped", 0.8)
    return found.select("surface", tier.alias("tier"), F.coalesce("_alias", "_ticker", "_exact", "_stripped").alias("entity"), confidence.alias("confidence"))


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
