"""Claims to edges: canonical predicates and entities, links, edges, contradictions and reliability."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions import score, text
from claimweave.session import cut

# A predicate that contains one of these has one object at a time.
SINGLE_VALUED = ("ceo", "cfo", "chair", "headquarter", "incorporat", "ticker", "parent", "owner")
#: Literals further apart than this conflict.
LITERAL_GAP = 0.05
#: Claims that a source needs to be scored.
LEAST_CLAIMS = 5


def latest_map(predicate_map: DataFrame) -> DataFrame:
    """(raw, canon) of the latest version."""
    latest = predicate_map.agg(F.max("version").alias("version"))
    return predicate_map.join(latest, "version").select(F.col("predicate_raw").alias("raw"), F.col("predicate_canon").alias("canon"))


def with_canon(claims: DataFrame, predicate_map: DataFrame) -> DataFrame:
    """Adds predicate_canon: the latest map's, else the lower-cased predicate. The map is small; Spark broadcasts it if its size is under the threshold."""
    found = latest_map(predicate_map).select(F.col("raw").alias("_map_raw"), F.col("canon").alias("_map_canon"))
    key = F.lower(F.coalesce("predicate_raw", F.lit("")))
    return claims.join(found, key == found["_map_raw"], "left").withColumn("predicate_canon", F.coalesce("_map_canon", key)).drop("_map_raw", "_map_canon")


def canonicalize(frame: DataFrame, same_as: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds for each column the entity that it was merged into, or itself; merges are one hop."""
    for column, out in columns.items():
        merge = same_as.select(F.col("a").alias("_from"), F.col("b").alias("_into"))
        frame = frame.join(merge, frame[column] == merge["_from"], "left").withColumn(out, F.coalesce("_into", column)).drop("_from", "_into")
    return frame


def materialize_edges(claims: DataFrame, same_as: DataFrame, predicate_map: DataFrame) -> DataFrame:
    """One edge for each canonical (source, target, predicate) of asserted, fully linked claims; open-ended if a claim is."""
    linked = claims.filter("status = 'asserted' and subject_entity is not null and object_entity is not null")
    linked = canonicalize(with_canon(linked, predicate_map), same_as, {"subject_entity": "src", "object_entity": "dst"})
    return linked.groupBy("src", "dst", F.col("predicate_canon").alias("predicate")).agg(
        F.array_sort(F.collect_list("claim_id")).alias("claim_ids"),
        F.min("valid_from").alias("valid_from"),
        F.when(F.bool_or(F.col("valid_to").isNull()), None).otherwise(F.max("valid_to")).alias("valid_to"),
        F.max("confidence").alias("confidence"),
        F.max("observed_at").alias("last_evidence_at"),
    ).withColumn("half_life_days", score.edge_half_life(F.col("predicate")))


def link_both(claims: DataFrame, mentions: DataFrame, same_as: DataFrame) -> DataFrame:
    """(claim_id, subject, object) of claims whose ends change once linked: each to what its surface in the claim's event resolved to, merge-folded.

    Surfaces are unique in an event; of several the least counts. An end whose surface resolved to nothing stays.
    """
    one = mentions.filter("resolved_entity is not null").groupBy("event_id", "surface").agg(F.min("resolved_entity").alias("_r"))
    named = canonicalize(one, same_as, {"_r": "_to"}).select("event_id", "surface", "_to")
    subjects = named.select("event_id", F.col("surface").alias("subject_surface"), F.col("_to").alias("_s"))
    objects = named.select("event_id", F.col("surface").alias("object_surface"), F.col("_to").alias("_o"))
    ends = claims.select("claim_id", "event_id", "subject_surface", "object_surface", "subject_entity", "object_entity").join(subjects, ["event_id", "subject_surface"], "left").join(objects, ["event_id", "object_surface"], "left")
    linked = ends.select("claim_id", "subject_entity", "object_entity", F.coalesce("_s", "subject_entity").alias("subject"), F.coalesce("_o", "object_entity").alias("object"))
    return linked.filter(~F.col("subject").eqNullSafe(F.col("subject_entity")) | ~F.col("object").eqNullSafe(F.col("object_entity"))).select("claim_id", "subject", "object")


def link_claims(claims: DataFrame, mentions: DataFrame, same_as: DataFrame) -> DataFrame:
    """(claim_id, linked_subject): what the mention of the subject's surface in the claim's event resolved to, merge-folded."""
    resolved = canonicalize(mentions.filter("resolved_entity is not null"), same_as, {"resolved_entity": "linked_subject"})
    resolved = resolved.select(F.col("event_id"), F.col("surface").alias("subject_surface"), "linked_subject")
    return claims.join(resolved, ["event_id", "subject_surface"]).filter(~F.col("subject_entity").eqNullSafe(F.col("linked_subject"))).select("claim_id", "subject_entity", "linked_subject")


def _overlap(a: str, b: str) -> Column:
    """Closed validity intervals overlap; a null bound is open."""
    apart = lambda x, y: F.coalesce(F.col(f"{x}.valid_from") > F.col(f"{y}.valid_to"), F.lit(False))
    return ~apart(a, b) & ~apart(b, a)


def contradictions(claims: DataFrame, predicate_map: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of asserted claims on a subject and predicate that cannot both hold.

    Two equi-joins instead of all pairs of a group: objects can conflict only
    under single-valued predicates, literals only with equal period and
    currency. A pair is an object conflict first.

    Columns of ``carry`` come along as ``…_a`` and ``…_b``. Pairs are many
    times as many as claims, so what is known of a claim is joined to it
    before it is paired; no pair is shuffled here.
    """
    some = _facts(claims, predicate_map, carry)
    return _pairs(some.filter(_OBJECT), some.filter(_LITERAL), carry)


#: Claims that objects, or literals, may set against each other.
_OBJECT, _LITERAL = "_single and _object != ''", "literal_value is not null"
#: What such claims have in common besides subject and predicate.
_OBJECT_KEYS, _LITERAL_KEYS = ["_kind"], ["literal_currency", "literal_as_of", "literal_unit"]


def _facts(claims: DataFrame, predicate_map: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """Of asserted claims what decides on their pairs."""
    some = with_canon(claims.filter("status = 'asserted' and subject_entity is not null"), predicate_map)
    some = some.withColumn("_kind", F.when(F.col("object_entity").isNotNull(), "e").otherwise("s")).withColumn("_object", F.coalesce("object_entity", text.norm(F.coalesce("object_surface", F.lit("")))))
    return some.select("claim_id", F.col("subject_entity").alias("_subject"), "predicate_canon", "_kind", "_object", "lineage_id", "observed_at", "valid_from", "valid_to", "literal_value", "literal_currency", "literal_as_of", "literal_unit", score.contains_any(F.col("predicate_canon"), SINGLE_VALUED).alias("_single"), *carry)


def _not_alone(facts: DataFrame) -> DataFrame:
    """The claims that meet another one by their keys, written once, with the kind of keys as ``_by``; the rest is in no pair.

    Claims are worked out and dealt once, by a hash of their keys; two keys of
    one hash only let more pass.
    """
    key = lambda kind, keys: F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind), "_subject", "predicate_canon", *keys).alias("key"))
    ways = F.array_compact(F.array(F.when(F.expr(_OBJECT), key("object", _OBJECT_KEYS)), F.when(F.expr(_LITERAL), key("literal", _LITERAL_KEYS))))
    met = facts.withColumn("_way", F.explode(ways)).withColumns({"_by": F.col("_way.kind"), "_group": F.col("_way.key")}).drop("_way")
    return cut(met.withColumn("_met", F.count(F.lit(1)).over(Window.partitionBy("_group"))).filter("_met > 1").drop("_met", "_group"))


def _pairs(single: DataFrame, literal: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """``contradictions`` of what ``_facts`` gives of claims with a single object, and of those with a literal."""
    out = []
    objects_differ = F.col("a._object") != F.col("b._object")
    by_object = F.col("a._single") & (F.col("a._kind") == F.col("b._kind")) & (F.col("a._object") != "") & (F.col("b._object") != "") & objects_differ
    for rows, kind, keys, differ in (
        (single, "object_conflict", _OBJECT_KEYS, objects_differ),
        (literal, "literal_conflict", _LITERAL_KEYS, (score.relative_difference(F.col("a.literal_value"), F.col("b.literal_value")) > LITERAL_GAP) & ~by_object),
    ):
        on = (F.col("a._subject") == F.col("b._subject")) & (F.col("a.predicate_canon") == F.col("b.predicate_canon")) & (F.col("a.claim_id") < F.col("b.claim_id"))
        for key in keys:
            on = on & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
        pairs = rows.alias("a").join(rows.alias("b"), on).filter(_overlap("a", "b") & differ)
        out.append(pairs.select(
            F.col("a._subject").alias("subject_entity"), F.col("a.predicate_canon").alias("predicate_canon"), F.col("a.claim_id").alias("claim_a"), F.col("b.claim_id").alias("claim_b"), F.lit(kind).alias("kind"),
            (F.col("a.lineage_id") == F.col("b.lineage_id")).alias("same_lineage"), F.col("a.observed_at").alias("observed_a"), F.col("b.observed_at").alias("observed_b"),
            F.when(~F.col("a._single"), F.to_json(F.struct("a.literal_currency", "a.literal_as_of", "a.literal_unit"))).alias("period"), F.col("a.lineage_id").alias("lineage_a"),
            *[F.col(f"{side}.{c}").alias(f"{c}_{side}") for c in carry for side in "ab"],
        ))
    objects, literals = out
    return objects.unionByName(literals)


def with_raw(claims: DataFrame, mentions: DataFrame, subject: str = "subject_entity") -> DataFrame:
    """Adds raw: what the claim's ``subject`` was before merges, from the mention of its surface in its event."""
    named = mentions.filter("resolved_entity is not null").groupBy("event_id", F.col("surface").alias("subject_surface")).agg(F.min("resolved_entity").alias("_named"))
    return claims.join(named, ["event_id", "subject_surface"], "left").withColumn("raw", F.coalesce("_named", subject)).drop("_named")


def raw_subjects(claims: DataFrame, mentions: DataFrame) -> DataFrame:
    """(claim_id, raw) of all claims."""
    return with_raw(claims.select("claim_id", "event_id", "subject_surface", "subject_entity"), mentions).select("claim_id", "raw")


_GROUP = ["subject_entity", "predicate_canon", "lineage_a", "period"]


def _walk(pairs: DataFrame) -> DataFrame:
    """(older, newer, at_a, at_b): the claims that go, and the pair at which, when pairs that may supersede are walked in order.

    Such a pair depends only on pairs of its own subject, predicate and
    lineage (of its period too, where the predicate takes many objects).
    Those stream by in sorted order, with no more in memory than the claims
    of one group that went.
    """

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, gone = None, set()  # of the group at hand alone
        for rows in batches:
            out = []
            for *key, a, b, at_a, at_b in rows.itertuples(index=False, name=None):
                if key != here:
                    here, gone = key, set()
                if a not in gone and b not in gone:
                    newer, older = (a, b) if (at_a, a) > (at_b, b) else (b, a)
                    gone.add(older)
                    out.append((older, newer, a, b))
            yield pd.DataFrame(out, columns=["older", "newer", "at_a", "at_b"])

    ordered = pairs.select(*_GROUP, "claim_a", "claim_b", "observed_a", "observed_b")
    ordered = ordered.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "claim_a", "claim_b")
    return cut(ordered.mapInPandas(settle, "older string, newer string, at_a string, at_b string"))


def resolve_claims(claims: DataFrame, predicate_map: DataFrame, watched: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """``resolve_contradictions`` of all pairs of ``claims``; nothing is recorded yet.

    Claims have their ``raw`` subject, unless ``mentions`` are given to find it.
    Those that meet no other are left out first, so that what follows, the
    mentions too, moves only claims that pairs may come from. These are paired
    twice. The first time only pairs that may supersede are formed, and walked.
    What went, and whether a subject is watched, is then joined to the claims,
    so that the second time each pair is decided where it is formed, and pairs
    are neither written nor shuffled.
    """
    settles = F.coalesce(F.col("same_lineage") & F.col("raw_a").eqNullSafe(F.col("raw_b")), F.lit(False))
    met = _not_alone(_facts(claims, predicate_map, ("raw",) if mentions is None else ("event_id", "subject_surface")))
    if mentions is not None:
        met = cut(with_raw(met, mentions, "_subject").drop("event_id", "subject_surface"))
    sides = [met.filter(F.col("_by") == kind).drop("_by") for kind in ("object", "literal")]
    went = _walk(_pairs(*sides, ("raw",)).filter(F.col("same_lineage") & F.col("raw_a").eqNullSafe(F.col("raw_b"))))
    gone = went.select(F.col("older").alias("claim_id"), F.struct(F.struct(F.col("at_a").alias("claim_a"), F.col("at_b").alias("claim_b")).alias("at"), "newer").alias("_went"))
    on = watched.select(F.col("entity_id").alias("_subject"), F.lit(True).alias("_watched")).distinct()
    known = [side.join(gone, "claim_id", "left").join(on, "_subject", "left") for side in sides]
    pairs = _pairs(*known, ("raw", "_went", "_watched")).withColumn("_settles", settles)
    at = F.struct("claim_a", "claim_b")
    newer = F.coalesce(*[F.when(F.col(f"_went_{side}.at") == at, F.col(f"_went_{side}.newer")) for side in "ab"])
    still = F.lit(True)
    for side in "ab":
        still = still & (F.col(f"_went_{side}").isNull() | (F.col(f"_went_{side}.at") >= at))
    out = pairs.withColumn("kept", F.when(F.col("_settles"), newer)).filter(F.when(F.col("_settles"), F.col("kept").isNotNull()).otherwise(still))
    state = F.when(F.col("_settles"), "auto_resolved").otherwise("open")
    return out.select("subject_entity", "predicate_canon", "claim_a", "claim_b", "kind", state.alias("state"), "kept", (~F.col("_settles") & F.coalesce("_watched_a", F.lit(False))).alias("alert"))


def resolve_contradictions(pairs: DataFrame, raw: DataFrame | None = None, watched: DataFrame | None = None, recorded: DataFrame | None = None) -> DataFrame:
    """State of each pair: in order, the older claim of a pair of one lineage is superseded; a superseded claim enters no later pair.

    ``raw`` (claim_id, raw): pairs whose subjects coincide only by a merge
    supersede nothing and stay open. ``watched`` (entity_id): open pairs on
    these subjects raise an alert. ``recorded`` (claim_a, claim_b): pairs of
    earlier runs are left out.

    Only pairs that may supersede depend on their order, and are walked in
    it; every other pair is decided by joins with the claims that went. Where
    the pairs come from claims at hand, ``resolve_claims`` moves far less.
    """
    if recorded is not None:
        pairs = pairs.join(recorded.select("claim_a", "claim_b"), ["claim_a", "claim_b"], "left_anti")
    settles = F.col("same_lineage")
    if raw is not None:
        for side in "ab":
            pairs = pairs.join(raw.select(F.col("claim_id").alias(f"claim_{side}"), F.col("raw").alias(f"raw_{side}")), f"claim_{side}", "left")
        settles = settles & F.col("raw_a").eqNullSafe(F.col("raw_b"))
    pairs = cut(pairs.withColumn("_settles", F.coalesce(settles, F.lit(False))))
    went = _walk(pairs.filter("_settles"))
    settled = went.select(F.col("at_a").alias("claim_a"), F.col("at_b").alias("claim_b"), F.col("newer").alias("kept"))
    out = pairs.filter("_settles").join(settled, ["claim_a", "claim_b"]).unionByName(pairs.filter("not _settles"), allowMissingColumns=True)
    at = F.struct("claim_a", "claim_b")
    for side in "ab":
        of = went.select(F.col("older").alias(f"claim_{side}"), F.struct(F.col("at_a").alias("claim_a"), F.col("at_b").alias("claim_b")).alias(f"_went_{side}"))
        out = out.join(of, f"claim_{side}", "left").filter(F.col(f"_went_{side}").isNull() | (F.col(f"_went_{side}") >= at))
    out = out.withColumn("state", F.when(F.col("_settles"), "auto_resolved").otherwise("open"))
    if watched is not None:
        out = out.join(watched.select(F.col("entity_id").alias("subject_entity"), F.lit(True).alias("_watched")).distinct(), "subject_entity", "left").withColumn("alert", (F.col("state") == "open") & F.coalesce("_watched", F.lit(False)))
    return out.select("subject_entity", "predicate_canon", "claim_a", "claim_b", "kind", "state", "kept", *(["alert"] if watched is not None else []))


def reliability(claims: DataFrame, predicate_map: DataFrame) -> DataFrame:
    """Score of each source with enough claims: corroborated by another lineage up, superseded down. Keys are not merge-folded."""
    canon = with_canon(claims, predicate_map)
    full = F.expr("status = 'asserted' and subject_entity is not null and object_entity is not null")
    keys = ["subject_entity", "predicate_canon", "object_entity"]
    backed = canon.filter(full).groupBy(*keys).agg(F.countDistinct("lineage_id").alias("n")).filter("n >= 2").select(*keys, F.lit(1).alias("_backed"))
    marked = canon.withColumn("_full", full).join(backed, keys, "left")
    by_source = marked.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_claims"), F.count_if(F.col("_full") & F.col("_backed").isNotNull()).alias("corroborated"), F.count_if(F.col("status") == "superseded").alias("superseded")).filter(F.col("n_claims") >= LEAST_CLAIMS)
    return by_source.withColumn("score", score.source_reliability(F.col("corroborated") / F.col("n_claims"), F.col("superseded") / F.col("n_claims")))


def ends_of(claims: DataFrame, *more: str) -> DataFrame:
    """(claim_id, entity, ...): both ends of each claim, an end that is both once."""
    return claims.select("claim_id", *more, F.explode(F.array_distinct(F.array_compact(F.array("subject_entity", "object_entity")))).alias("entity"))


def heal_unmerge(pairs: DataFrame, claims: DataFrame, mentions: DataFrame) -> DataFrame:
    """Same-lineage pairs whose claims' subjects were resolved to different entities before merging."""
    raw = claims.select("claim_id", "event_id", "subject_surface", "subject_entity").join(mentions.select("event_id", F.col("surface").alias("subject_surface"), "resolved_entity"), ["event_id", "subject_surface"], "left")
    raw = raw.select("claim_id", F.coalesce("resolved_entity", "subject_entity").alias("raw"))
    a = raw.select(F.col("claim_id").alias("claim_a"), F.col("raw").alias("raw_a"))
    b = raw.select(F.col("claim_id").alias("claim_b"), F.col("raw").alias("raw_b"))
    return made_by_merge(pairs.join(a, "claim_a").join(b, "claim_b"))


def made_by_merge(pairs: DataFrame) -> DataFrame:
    """Of pairs that carry what their subjects were before merges, those where that differs."""
    return pairs.filter(~F.col("raw_a").eqNullSafe(F.col("raw_b"))).select("claim_a", "claim_b", "raw_a", "raw_b")


def merge_log(same_as: DataFrame, a: str, b: str) -> DataFrame:
    """Merges after merging ``a`` into ``b``: what was merged into a now points at b's canonical entity, so maps stay one hop."""
    target = same_as.filter(F.col("a") == b).agg(F.coalesce(F.max("b"), F.lit(b)).alias("_to"))
    added = target.select(F.lit(a).alias("a"), F.col("_to").alias("b"))
    moved = same_as.filter(F.col("a") != a).join(target.withColumn("b", F.lit(a)), "b", "left").select("a", F.coalesce("_to", "b").alias("b"))
    return moved.unionByName(added).filter("a != b")

