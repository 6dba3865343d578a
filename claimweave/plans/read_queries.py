"""Queries behind pages and lists: filters, joins, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions import open_json, text
from claimweave.operators import discovery, graph, ingest, intervals
from claimweave.plans.registry import query
from claimweave.sources.claimgraph import ClaimGraph

NOW, SINCE = "2001-08-02 00:00:00", "2001-07-01 00:00:00"


def ts(value: str):  # noqa: ANN201
    return F.lit(value).cast("timestamp_ntz")


@query("claims_filter", f"SELECT claim_id, predicate_canon, observed_at FROM canon_claim JOIN event e USING (event_id) WHERE canon_claim.status = 'asserted' AND predicate_canon = 'supplies' AND e.connector = 'rss' AND observed_at >= TIMESTAMP '2001-01-01' AND contains(lower(coalesce(object_surface, '')), 'e') AND (subject_entity = 'S1' OR object_entity = 'S1' OR subject_entity LIKE 'S%')")
def _(g: ClaimGraph) -> DataFrame:
    """Status, canonical predicate, connector, days, text on a surface, and an entity at either end."""
    some = graph.with_canon(g.asserted, g.predicate_map).filter((F.col("predicate_canon") == "supplies") & (F.col("observed_at") >= ts("2001-01-01 00:00:00")))
    some = some.filter(F.contains(F.lower(F.coalesce("object_surface", F.lit(""))), F.lit("e")))
    some = some.filter((F.col("subject_entity") == "S1") | (F.col("object_entity") == "S1") | F.col("subject_entity").like("S%"))
    return some.join(g.event.filter("connector = 'rss'").select("event_id"), "event_id", "left_semi").select("claim_id", "predicate_canon", "observed_at")


_CONTEXT = "SELECT claim_id, e.connector, s.reliability, x.name AS subject_name, y.name AS object_name FROM claim c JOIN event e USING (event_id) JOIN source s ON s.source_id = e.source_id LEFT JOIN entity x ON x.entity_id = c.subject_entity LEFT JOIN entity y ON y.entity_id = c.object_entity"


def claim_context(g: ClaimGraph) -> DataFrame:
    names = g.entity.select("entity_id", "name")
    out = g.claim.drop("source_id").join(g.event.select("event_id", "connector", "source_id", "title"), "event_id").join(g.source.select("source_id", "reliability"), "source_id")
    for end, name in (("subject_entity", "subject_name"), ("object_entity", "object_name")):
        out = out.join(names.select(F.col("entity_id").alias(end), F.col("name").alias(name)), end, "left")
    return out


@query("join_claim_context", _CONTEXT)
def _(g: ClaimGraph) -> DataFrame:
    return claim_context(g).select("claim_id", "connector", "reliability", "subject_name", "object_name")


@query("claims_page", f"SELECT * FROM ({_CONTEXT} WHERE c.status = 'asserted' ORDER BY c.observed_at DESC, claim_id LIMIT 50 OFFSET 100)")
def _(g: ClaimGraph) -> DataFrame:
    """A page is chosen before anything is joined to it."""
    page = g.asserted.orderBy(F.col("observed_at").desc(), "claim_id").offset(100).limit(50)
    names = g.entity.select("entity_id", "name")
    out = page.drop("source_id").join(g.event.select("event_id", "connector", "source_id"), "event_id").join(g.source.select("source_id", "reliability"), "source_id")
    for end, name in (("subject_entity", "subject_name"), ("object_entity", "object_name")):
        out = out.join(names.select(F.col("entity_id").alias(end), F.col("name").alias(name)), end, "left")
    return out.select("claim_id", "connector", "reliability", "subject_name", "object_name")


@query("documents_filter", "SELECT event_id FROM event WHERE contains(lower(coalesce(title, '')), 'board') AND connector IN ('edgar', 'rss', 'manual') AND status IN ('pending', 'extracting') AND coalesce(published_at, fetched_at) >= TIMESTAMP '2000-01-01' AND ticker <> 'T5'")
def _(g: ClaimGraph) -> DataFrame:
    return g.event.filter(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit("board")) & F.col("connector").isin("edgar", "rss", "manual") & F.col("status").isin("pending", "extracting") & (F.coalesce("published_at", "fetched_at") >= ts("2000-01-01 00:00:00")) & (F.col("ticker") != "T5")).select("event_id")


@query("documents_page", "SELECT * FROM (SELECT e.event_id, (SELECT count(*) FROM claim c WHERE c.event_id = e.event_id AND c.status = 'asserted') AS claims, (SELECT count(DISTINCT x) FROM (SELECT src AS x FROM canon_claim c WHERE c.event_id = e.event_id UNION ALL SELECT dst FROM canon_claim c WHERE c.event_id = e.event_id)) AS entities FROM event e ORDER BY coalesce(published_at, fetched_at) DESC, event_id LIMIT 40)")
def _(g: ClaimGraph) -> DataFrame:
    """Counts are taken for the page's documents alone."""
    page = g.event.select("event_id", F.coalesce("published_at", "fetched_at").alias("_at")).orderBy(F.col("_at").desc(), "event_id").limit(40)
    some = g.claim.join(page.select("event_id"), "event_id", "left_semi")
    folded = graph.canonicalize(some, g.same_as, {"subject_entity": "src", "object_entity": "dst"})
    claims = some.groupBy("event_id").agg(F.count_if(F.col("status") == "asserted").alias("claims"))
    entities = folded.select("event_id", F.explode(F.array("src", "dst")).alias("x")).groupBy("event_id").agg(F.countDistinct("x").alias("entities"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return page.join(claims, "event_id", "left").join(entities, "event_id", "left").select("event_id", zero("claims"), zero("entities"))


@query("ilike_any", "SELECT predicate_raw, count(*) AS n FROM claim WHERE regexp_matches(lower(predicate_raw), 'suppl|sourc|partner') GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    return g.claim.filter(F.col("predicate_raw").ilike("%suppl%") | F.col("predicate_raw").ilike("%sourc%") | F.col("predicate_raw").ilike("%partner%")).groupBy("predicate_raw").agg(F.count(F.lit(1)).alias("n"))


@query("json_field_filter", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) > 50")
def _(g: ClaimGraph) -> DataFrame:
    return g.table("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).filter("k > 50")


_MAPS = "(SELECT event_id, CASE WHEN event_id % 3 = 0 THEN json_object('stance', event_type, 'history', [json_object('from', event_type), json_object(CASE WHEN user_id % 2 = 0 THEN 'refined' ELSE 'seen' END, value)]) WHEN event_id % 3 = 1 THEN json_object(event_type, NULL) ELSE props END AS m FROM events)"


def open_maps(g: ClaimGraph) -> DataFrame:
    """Qualifiers and histories of every event as JSON of no fixed schema."""
    some = F.to_json(F.struct(F.col("event_type").alias("stance"), F.array(F.to_json(F.struct(F.col("event_type").alias("from"))), F.concat(F.lit('{"'), F.when(F.col("user_id") % 2 == 0, "refined").otherwise("seen"), F.lit('": '), F.col("value").cast("string"), F.lit("}"))).alias("history")))
    some = F.replace(F.replace(F.replace(some, F.lit('\\"'), F.lit('"')), F.lit('"{'), F.lit("{")), F.lit('}"'), F.lit("}"))
    key = F.concat(F.lit('{"'), F.col("event_type"), F.lit('": null}'))
    return g.table("events").select("event_id", open_json.parsed(F.when(F.col("event_id") % 3 == 0, some).when(F.col("event_id") % 3 == 1, key).otherwise(F.col("props"))).alias("m"))


@query("json_key_filter", f"SELECT event_id, json_extract_string(m, '$.stance') AS stance FROM {_MAPS} WHERE list_has_any(json_keys(m), ['error', 'k']) OR json_extract_string(m, '$.stance') = 'click'")
def _(g: ClaimGraph) -> DataFrame:
    """Maps that have a key, whatever its value, or a field of some value."""
    m = F.col("m")
    return open_maps(g).filter(open_json.has_key(m, "error") | open_json.has_key(m, "k") | open_json.equals(m, "$.stance", F.lit("click"))).select("event_id", open_json.field(m, "$.stance").alias("stance"))


@query("json_history_filter", f"SELECT event_id FROM {_MAPS} WHERE event_id % 3 = 0 AND NOT list_contains(json_keys(m -> 'history' -> 1), 'refined')")
def _(g: ClaimGraph) -> DataFrame:
    """Maps with a history of which no entry says that it was refined."""
    m = F.col("m")
    return open_maps(g).filter(open_json.has_key(m, "history") & ~open_json.any_has(m, "refined", "$.history")).select("event_id")


@query("null_safe_compare", "SELECT event_id, surface FROM mention WHERE resolved_entity IS DISTINCT FROM 'S1'")
def _(g: ClaimGraph) -> DataFrame:
    return g.mention.filter(~F.col("resolved_entity").eqNullSafe(F.lit("S1"))).select("event_id", "surface")


@query("firewall_view", "SELECT claim_id FROM asserted")
def _(g: ClaimGraph) -> DataFrame:
    return g.asserted.select("claim_id")


_SUMMARY = "status IN ('extracted', 'failed') AND lineage_id IS NOT NULL AND event_id NOT IN (SELECT event_id FROM event WHERE ticker = 'T3')"


@query("summarize_candidates", f"SELECT event_id, requested FROM (SELECT event_id, attempts = 3 AS requested, fetched_at FROM event WHERE {_SUMMARY} ORDER BY requested DESC, fetched_at, event_id LIMIT 30)")
def _(g: ClaimGraph) -> DataFrame:
    """Requested documents first, then in order of arrival; a set of tickers is excluded."""
    some = g.event.filter(F.col("status").isin("extracted", "failed") & F.col("lineage_id").isNotNull() & (F.col("ticker") != "T3"))
    return some.select("event_id", (F.col("attempts") == 3).alias("requested"), "fetched_at").orderBy(F.col("requested").desc(), "fetched_at", "event_id").limit(30).drop("fetched_at")


@query("requested_count", f"SELECT count(*) AS n FROM event WHERE attempts = 3 AND {_SUMMARY}")
def _(g: ClaimGraph) -> DataFrame:
    return g.event.filter(F.col("status").isin("extracted", "failed") & F.col("lineage_id").isNotNull() & (F.col("ticker") != "T3") & (F.col("attempts") == 3)).agg(F.count(F.lit(1)).alias("n"))


@query("entity_has_alias", "SELECT entity_id FROM entity e WHERE EXISTS (SELECT 1 FROM mention m WHERE m.resolved_entity = e.entity_id AND contains(lower(m.surface), '7')) OR contains(lower(name), 'ring')")
def _(g: ClaimGraph) -> DataFrame:
    aliased = g.mention.filter(F.contains(F.lower("surface"), F.lit("7"))).select(F.col("resolved_entity").alias("entity_id")).distinct()
    return g.entity.join(aliased, "entity_id", "left_semi").select("entity_id").union(g.entity.filter(F.contains(F.lower("name"), F.lit("ring"))).select("entity_id")).distinct()


@query("entities_not_merged", "SELECT entity_id FROM entity WHERE entity_id NOT IN (SELECT a FROM same_as)")
def _(g: ClaimGraph) -> DataFrame:
    return g.entity.join(g.same_as.select(F.col("a").alias("entity_id")), "entity_id", "left_anti").select("entity_id")


@query("watchlist_entities", "SELECT DISTINCT entity_id FROM entity e JOIN watchlist w ON w.ticker = e.ticker WHERE active")
def _(g: ClaimGraph) -> DataFrame:
    return discovery.watched_entities(g.entity, g.watchlist)


@query("sec_registry_left", "SELECT w.ticker, e.name FROM watchlist w LEFT JOIN entity e ON e.ticker = w.ticker")
def _(g: ClaimGraph) -> DataFrame:
    return g.watchlist.join(g.entity.filter("ticker is not null").select("ticker", "name"), "ticker", "left").select("ticker", "name")


@query("copies", "SELECT lineage_id, count(*) - 1 AS copies, min(event_id) AS root FROM event GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    """Events of a lineage besides its root, counted rather than paired."""
    return g.event.groupBy("lineage_id").agg((F.count(F.lit(1)) - 1).alias("copies"), F.min("event_id").alias("root"))


@query("interval_overlap", "SELECT a.subject_entity, count(*) AS overlapping FROM claim a JOIN claim b ON a.subject_entity = b.subject_entity AND a.object_entity = b.object_entity AND a.claim_id < b.claim_id WHERE NOT coalesce(a.valid_from > b.valid_to, false) AND NOT coalesce(b.valid_from > a.valid_to, false) GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    """Counted by a sweep over starts and ends: no pair is formed. Claims alone on their subject and object count nothing."""
    keys = ["subject_entity", "object_entity"]
    claims = g.claim.filter("object_entity is not null").select("claim_id", *keys, "valid_from", "valid_to")
    counts = intervals.overlap_counts_between(intervals.in_groups(claims, keys), keys, "claim_id")
    return counts.groupBy("subject_entity").agg(F.sum("overlapping").alias("overlapping")).filter("overlapping > 0")


@query("interval_pairs", "SELECT a.subject_entity, a.object_entity, a.claim_id AS id_a, b.claim_id AS id_b FROM claim a JOIN claim b ON a.subject_entity = b.subject_entity AND a.object_entity = b.object_entity AND a.claim_id < b.claim_id WHERE NOT coalesce(a.valid_from > b.valid_to, false) AND NOT coalesce(b.valid_from > a.valid_to, false)")
def _(g: ClaimGraph) -> DataFrame:
    """Where the pairs themselves are wanted, they are formed in the stretch of time in which they meet."""
    return intervals.overlap_pairs(g.claim.select("claim_id", "subject_entity", "object_entity", "valid_from", "valid_to"), ["subject_entity", "object_entity"], "claim_id", days=90)


# Aggregates ---------------------------------------------------------------


@query("agg_status_counts", "SELECT k.status, count(e.event_id) AS n FROM (VALUES ('pending'), ('extracted'), ('failed'), ('duplicate'), ('resolved')) k(status) LEFT JOIN event e ON e.status = k.status GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    """Counts with a row for each known status: a conditional count for each, in one pass."""
    states = ("pending", "extracted", "failed", "duplicate", "resolved")
    one = g.event.agg(*[F.count_if(F.col("status") == s).alias(s) for s in states])
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in states])).alias("r")).select("r.status", "r.n")


@query("agg_mentions_state", "SELECT CASE WHEN resolved_entity IS NOT NULL THEN 'resolved' WHEN resolver = 'skipped-v0' THEN 'skipped' ELSE 'pending' END AS state, count(*) AS n FROM mention GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    state = F.when(F.col("resolved_entity").isNotNull(), "resolved").when(F.col("resolver") == "skipped-v0", "skipped").otherwise("pending")
    return g.mention.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_mentions_tier", "SELECT split_part(resolver, ':', 1) AS tier, count(*) AS n FROM mention GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    return g.mention.groupBy(F.split_part("resolver", F.lit(":"), F.lit(1)).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_filter_count", f"SELECT count(*) AS claims, count(*) FILTER (WHERE observed_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS week FROM claim")
def _(g: ClaimGraph) -> DataFrame:
    return g.claim.agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("observed_at") >= ts(NOW) - F.expr("interval 7 days")).alias("week"))


@query("agg_having", "SELECT s.source_id, count(e.event_id) FILTER (WHERE e.status = 'pending') AS n FROM source s LEFT JOIN event e ON e.source_id = s.source_id GROUP BY 1, s.status HAVING count(e.event_id) FILTER (WHERE e.status = 'pending') > 0 OR s.status <> 'dropped'")
def _(g: ClaimGraph) -> DataFrame:
    counted = g.event.groupBy("source_id").agg(F.count_if(F.col("status") == "pending").alias("n"))
    return g.source.join(counted, "source_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long")).filter((F.col("n") > 0) | (F.col("status") != "dropped")).select("source_id", "n")


_ENDS = "--more\nends AS (SELECT claim_id, event_id, status, observed_at, unnest(list_distinct([subject_entity, object_entity])) AS e FROM claim) "


@query("agg_entity_claims", _ENDS + "SELECT entity_id, name, count(ends.claim_id) AS claims FROM entity LEFT JOIN ends ON e = entity_id WHERE entity_id NOT IN (SELECT a FROM same_as) GROUP BY 1, 2 ORDER BY claims DESC, entity_id LIMIT 100")
def _(g: ClaimGraph) -> DataFrame:
    """Entities with claims of any status, most first; a claim with an entity at both ends counts once."""
    counted = graph.ends_of(g.claim).groupBy("entity").agg(F.count(F.lit(1)).alias("claims"))
    alive = g.entity.join(g.same_as.select(F.col("a").alias("entity_id")), "entity_id", "left_anti")
    return alive.join(counted, alive["entity_id"] == counted["entity"], "left").select("entity_id", "name", F.coalesce("claims", F.lit(0)).cast("long").alias("claims")).orderBy(F.col("claims").desc(), "entity_id").limit(100)


@query("agg_distinct_entities", "SELECT event_id, count(DISTINCT x) AS entities FROM (SELECT event_id, src AS x FROM canon_claim UNION ALL SELECT event_id, dst FROM canon_claim) GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    folded = graph.canonicalize(g.claim, g.same_as, {"subject_entity": "src", "object_entity": "dst"})
    return folded.select("event_id", F.explode(F.array("src", "dst")).alias("x")).groupBy("event_id").agg(F.countDistinct("x").alias("entities"))


@query("agg_doc_entities", _ENDS + ", cl AS (SELECT event_id, e, count(*) AS claims FROM ends GROUP BY 1, 2), me AS (SELECT event_id, resolved_entity AS e, count(*) AS mentions FROM mention WHERE resolved_entity IS NOT NULL GROUP BY 1, 2) SELECT coalesce(cl.event_id, me.event_id) AS event_id, coalesce(cl.e, me.e) AS entity, coalesce(claims, 0) AS claims, coalesce(mentions, 0) AS mentions FROM cl FULL JOIN me ON cl.event_id = me.event_id AND cl.e = me.e")
def _(g: ClaimGraph) -> DataFrame:
    """Both counts are rows of one union, so that one shuffle by (event, entity) does for a full join."""
    claims = graph.ends_of(g.claim, "event_id").select("event_id", "entity", F.lit(1).alias("c"), F.lit(0).alias("m"))
    mentions = g.mention.filter("resolved_entity is not null").select("event_id", F.col("resolved_entity").alias("entity"), F.lit(0).alias("c"), F.lit(1).alias("m"))
    return claims.unionByName(mentions).groupBy("event_id", "entity").agg(F.sum("c").alias("claims"), F.sum("m").alias("mentions"))


@query("agg_digest", f"SELECT connector, count(*) AS n FROM event WHERE fetched_at >= TIMESTAMP '{SINCE}' GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    return g.event.filter(F.col("fetched_at") >= ts(SINCE)).groupBy("connector").agg(F.count(F.lit(1)).alias("n"))


@query("digest_entities", _ENDS + f", n AS (SELECT ends.e, count(*) AS n FROM ends WHERE observed_at >= TIMESTAMP '{SINCE}' GROUP BY 1), w AS (SELECT DISTINCT entity_id FROM entity x JOIN watchlist y ON x.ticker = y.ticker WHERE active) SELECT n.e AS entity, n, n.e IN (SELECT entity_id FROM w) AS watched FROM n ORDER BY watched DESC, n DESC, entity LIMIT 8")
def _(g: ClaimGraph) -> DataFrame:
    recent = graph.ends_of(g.claim.filter(F.col("observed_at") >= ts(SINCE))).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    watched = discovery.watched_entities(g.entity, g.watchlist).select(F.col("entity_id").alias("entity"), F.lit(True).alias("_w"))
    return recent.join(watched, "entity", "left").select("entity", "n", F.coalesce("_w", F.lit(False)).alias("watched")).orderBy(F.col("watched").desc(), F.col("n").desc(), "entity").limit(8)


@query("agg_predicates", "SELECT lower(predicate_raw) AS predicate, count(*) AS n FROM claim GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    return g.claim.groupBy(F.lower("predicate_raw").alias("predicate")).agg(F.count(F.lit(1)).alias("n"))


@query("llm_rollup", "SELECT connector, count(*) AS calls, round(sum(coalesce(CASE WHEN attempts > 0 THEN cost END, 0)), 2) AS cost, CAST(sum(attempts) AS BIGINT) AS attempts FROM event GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    return g.event.groupBy("connector").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(F.coalesce(F.when(F.col("attempts") > 0, F.col("cost")), F.lit(0.0))), 2).alias("cost"), F.sum("attempts").alias("attempts"))


@query("spike_stats", "SELECT source_id, count(DISTINCT event_id) AS docs, count(*) AS claims, round(count(*) / count(DISTINCT event_id), 6) AS per_doc, round(avg(CASE WHEN literal_value IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS literal_share FROM claim GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    docs = F.countDistinct("event_id")
    return g.claim.groupBy("source_id").agg(docs.alias("docs"), F.count(F.lit(1)).alias("claims"), F.round(F.count(F.lit(1)) / docs, 6).alias("per_doc"), F.round(F.avg(F.when(F.col("literal_value").isNotNull(), 1.0).otherwise(0.0)), 6).alias("literal_share"))


@query("predicate_singletons", "SELECT count(*) AS predicates, count_if(n = 1) AS once FROM (SELECT object_surface, count(*) AS n FROM claim WHERE object_surface IS NOT NULL GROUP BY 1)")
def _(g: ClaimGraph) -> DataFrame:
    return g.claim.filter("object_surface is not null").groupBy("object_surface").count().agg(F.count(F.lit(1)).alias("predicates"), F.count_if(F.col("count") == 1).alias("once"))


@query("surface_rollup", "SELECT surface, bool_and(resolved_entity IS NOT NULL) AS resolved, count(DISTINCT resolver) AS outcomes FROM mention GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    return g.mention.groupBy("surface").agg(F.bool_and(F.col("resolved_entity").isNotNull()).alias("resolved"), F.countDistinct("resolver").alias("outcomes"))


# Windows, top-k and sets ----------------------------------------------------


@query("latest_per_key", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _(g: ClaimGraph) -> DataFrame:
    """An aggregate of the greatest (time, id) instead of a sorted window: it combines map-side."""
    return g.table("events").groupBy("event_type").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"))


@query("first_per_key", "SELECT name, min(entity_id) AS entity_id FROM entity GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    return g.entity.groupBy("name").agg(F.min("entity_id").alias("entity_id"))


@query("topn_per_group", "SELECT source_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC, event_id) AS n FROM event) WHERE n <= 20")
def _(g: ClaimGraph) -> DataFrame:
    """Spark limits each group map-side before it shuffles (WindowGroupLimit)."""
    by = Window.partitionBy("source_id").orderBy(F.col("fetched_at").desc(), "event_id")
    return g.event.withColumn("_n", F.row_number().over(by)).filter("_n <= 20").select("source_id", "event_id")


@query("topk_global", "SELECT event_id, cost FROM event ORDER BY cost DESC, event_id LIMIT 30")
def _(g: ClaimGraph) -> DataFrame:
    return g.event.select("event_id", "cost").orderBy(F.col("cost").desc(), "event_id").limit(30)


@query("recent_window", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000")
def _(g: ClaimGraph) -> DataFrame:
    return g.table("events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(2000).select("event_id")


@query("setop_union_all", "SELECT e, count(*) AS n FROM (SELECT subject_entity AS e FROM claim UNION ALL SELECT object_entity FROM claim WHERE object_entity IS NOT NULL) GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    return g.claim.select(F.explode(F.array_compact(F.array("subject_entity", "object_entity"))).alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n"))


@query("setop_intersect", "SELECT event_id FROM asserted WHERE subject_entity = 'S1' INTERSECT SELECT event_id FROM asserted WHERE subject_entity = 'S2'")
def _(g: ClaimGraph) -> DataFrame:
    of = lambda e: g.asserted.filter(F.col("subject_entity") == e).select("event_id")
    return of("S1").intersect(of("S2"))


@query("setop_distinct", "SELECT DISTINCT subject_entity, object_entity FROM asserted WHERE object_entity IS NOT NULL")
def _(g: ClaimGraph) -> DataFrame:
    return g.asserted.filter("object_entity is not null").select("subject_entity", "object_entity").distinct()


@query("setop_except", "SELECT DISTINCT lower(predicate_raw) AS predicate FROM claim WHERE lower(predicate_raw) NOT IN (SELECT raw FROM pmap)")
def _(g: ClaimGraph) -> DataFrame:
    known = graph.latest_map(g.predicate_map).select(F.col("raw").alias("predicate"))
    return g.claim.select(F.lower("predicate_raw").alias("predicate")).distinct().join(known, "predicate", "left_anti")


@query("entity_page", "SELECT coalesce(s.b, 'S9') AS canonical, (SELECT string_agg(a, ',' ORDER BY a) FROM same_as WHERE b = coalesce(s.b, 'S9')) AS merged_from, (SELECT count(*) FROM edge WHERE src = coalesce(s.b, 'S9') OR dst = coalesce(s.b, 'S9')) AS edges, (SELECT count(DISTINCT surface) FROM mention m LEFT JOIN same_as x ON x.a = m.resolved_entity WHERE coalesce(x.b, m.resolved_entity) = coalesce(s.b, 'S9')) AS aliases FROM (SELECT 1) LEFT JOIN same_as s ON s.a = 'S9'")
def _(g: ClaimGraph) -> DataFrame:
    """An entity's page: where it was merged to, what was merged into that, its edges and surfaces."""
    asked = g.entity.filter("entity_id = 'S9'").select("entity_id")
    at = graph.canonicalize(asked, g.same_as, {"entity_id": "canonical"}).select("canonical")
    merged = g.same_as.join(at, g.same_as["b"] == at["canonical"]).groupBy("canonical").agg(F.array_join(F.array_sort(F.collect_list("a")), ",").alias("merged_from"))
    e = graph.materialize_edges(g.claim, g.same_as, g.predicate_map)
    touched = e.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("canonical")).join(at, "canonical", "left_semi").groupBy("canonical").agg(F.count(F.lit(1)).alias("edges"))
    surfaces = graph.canonicalize(g.mention.filter("resolved_entity is not null"), g.same_as, {"resolved_entity": "canonical"}).groupBy("canonical").agg(F.countDistinct("surface").alias("aliases"))
    return at.join(merged, "canonical", "left").join(touched, "canonical", "left").join(surfaces, "canonical", "left").select("canonical", "merged_from", "edges", "aliases")


@query("document_page", "SELECT 'E100' AS event_id, (SELECT count(*) FROM claim WHERE event_id = 'E100') AS claims, (SELECT count(*) FROM mention WHERE event_id = 'E100') AS mentions, (SELECT count(*) FROM event x WHERE x.lineage_id = e.lineage_id AND x.event_id <> 'E100') AS copies FROM event e WHERE event_id = 'E100'")
def _(g: ClaimGraph) -> DataFrame:
    one = g.event.filter("event_id = 'E100'").select("event_id", "lineage_id")
    count = lambda rows, name: rows.filter("event_id = 'E100'").groupBy("event_id").agg(F.count(F.lit(1)).alias(name))
    copies = g.event.filter("event_id != 'E100'").join(one.select("lineage_id"), "lineage_id", "left_semi").groupBy("lineage_id").agg(F.count(F.lit(1)).alias("copies"))
    out = one.join(count(g.claim, "claims"), "event_id", "left").join(count(g.mention, "mentions"), "event_id", "left").join(copies, "lineage_id", "left")
    return out.select("event_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("claims", "mentions", "copies")])


@query("er_queue_list", "SELECT surface, count(*) AS n, min(event_id) AS example FROM mention WHERE resolved_entity IS NULL GROUP BY 1 ORDER BY n DESC, surface LIMIT 20")
def _(g: ClaimGraph) -> DataFrame:
    return g.mention.filter("resolved_entity is null").groupBy("surface").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("example")).orderBy(F.col("n").desc(), "surface").limit(20)


@query("entity_names", "SELECT event_id, string_agg(coalesce(name, subject_entity), '; ' ORDER BY claim_id) AS names FROM claim LEFT JOIN entity ON entity_id = subject_entity GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    """Names in order, the id where there is none."""
    named = g.claim.select("event_id", "claim_id", "subject_entity").join(g.entity.select(F.col("entity_id").alias("subject_entity"), "name"), "subject_entity", "left")
    listed = F.array_sort(F.collect_list(F.struct("claim_id", F.coalesce("name", "subject_entity").alias("n"))))
    return named.groupBy("event_id").agg(F.array_join(F.transform(listed, lambda x: x["n"]), "; ").alias("names"))


@query("upsert_latest", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _(g: ClaimGraph) -> DataFrame:
    """Upsert: of old and incoming rows the latest of each key stays; the log is one table here."""
    return g.table("events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("r")).select("user_id", "r.event_type", "r.value")


@query("insert_new_only", "SELECT count(*) AS added FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text)")
def _(g: ClaimGraph) -> DataFrame:
    """On conflict do nothing: incoming rows whose key is known are left out."""
    return g.table("documents").join(g.table("benchmark").select("text"), "text", "left_anti").agg(F.count(F.lit(1)).alias("added"))


@query("lease_next", "SELECT event_id FROM event WHERE status = 'pending' OR (status = 'failed' AND attempts < 3 AND fetched_at < TIMESTAMP '2001-01-01') ORDER BY fetched_at, event_id LIMIT 1")
def _(g: ClaimGraph) -> DataFrame:
    """The next job: pending, or failed with attempts left and an expired lease, in order of arrival."""
    ready = (F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("attempts") < 3) & (F.col("fetched_at") < ts("2001-01-01 00:00:00")))
    return g.event.filter(ready).orderBy("fetched_at", "event_id").limit(1).select("event_id")


@query("retry_failed", "SELECT event_id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' THEN 0 ELSE attempts END AS attempts FROM event")
def _(g: ClaimGraph) -> DataFrame:
    failed = F.col("status") == "failed"
    return g.event.select("event_id", F.when(failed, "pending").otherwise(F.col("status")).alias("status"), F.when(failed, 0).otherwise(F.col("attempts")).alias("attempts"))


@query("source_toggle", "SELECT source_id, CASE status WHEN 'active' THEN 'demoted' WHEN 'demoted' THEN 'active' ELSE status END AS status FROM source")
def _(g: ClaimGraph) -> DataFrame:
    return g.source.select("source_id", F.when(F.col("status") == "active", "demoted").when(F.col("status") == "demoted", "active").otherwise(F.col("status")).alias("status"))


@query("alerts_dedup", "SELECT event_id, kind FROM (SELECT DISTINCT event_id, 'material' AS kind FROM event WHERE connector = 'edgar' UNION SELECT DISTINCT event_id, 'claim' FROM claim WHERE confidence > 0.95)")
def _(g: ClaimGraph) -> DataFrame:
    """One alert for each kind and event."""
    material = g.event.filter("connector = 'edgar'").select("event_id", F.lit("material").alias("kind"))
    claims = g.claim.filter("confidence > 0.95").select("event_id", F.lit("claim").alias("kind"))
    return material.unionByName(claims).dropDuplicates(["kind", "event_id"])


@query("gardener_map", "SELECT lower(predicate_raw) AS raw, coalesce(max(canon), lower(predicate_raw)) AS canon FROM claim LEFT JOIN pmap ON raw = lower(predicate_raw) GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    """The next full version of the mapping: what was mapped is carried, the rest maps to itself."""
    raw = g.claim.select(F.lower("predicate_raw").alias("raw")).distinct()
    return raw.join(graph.latest_map(g.predicate_map), "raw", "left").select("raw", F.coalesce("canon", "raw").alias("canon"))


@query("rollup_status", "SELECT connector, status, count(*) AS n FROM event GROUP BY ROLLUP (connector, status)")
def _(g: ClaimGraph) -> DataFrame:
    """An extension: grouping sets."""
    return g.event.rollup("connector", "status").agg(F.count(F.lit(1)).alias("n"))


@query("format_literals", "SELECT claim_id, concat_ws(' ', CAST(CAST(literal_value AS BIGINT) AS VARCHAR), literal_currency, '(as_of=' || literal_as_of || ')') AS literal FROM claim WHERE literal_value IS NOT NULL")
def _(g: ClaimGraph) -> DataFrame:
    rounded = F.bround("literal_value", 0).cast("long").cast("string")
    return g.claim.filter("literal_value is not null").select("claim_id", text.format_literal(rounded, F.col("literal_currency"), F.col("literal_as_of")).alias("literal"))


@query("er_lookup", "SELECT surface, CASE WHEN e.entity_id IS NOT NULL THEN 'name_exact' ELSE 'queue' END AS tier, e.entity_id AS entity FROM (SELECT DISTINCT object_surface AS surface FROM claim WHERE object_surface IS NOT NULL) LEFT JOIN (SELECT upper(name) AS n, min(entity_id) AS entity_id FROM entity GROUP BY 1) e ON e.n = upper(surface)")
def _(g: ClaimGraph) -> DataFrame:
    surfaces = g.claim.filter("object_surface is not null").select(F.col("object_surface").alias("surface"))
    alias = g.mention.filter("resolver = 'alias:exact'").select("surface", F.col("resolved_entity").alias("entity")).distinct()
    tickers = g.entity.filter("ticker is not null").select("ticker", F.col("entity_id").alias("entity"))
    names = g.entity.select("name", F.col("entity_id").alias("entity"))
    return ingest.resolve(surfaces, alias, tickers, names).select("surface", "tier", "entity")
