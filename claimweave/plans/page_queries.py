"""Queries behind review pages and investigations: hypotheses, evidence, alerts, watchlists and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.operators import discovery, graph
from claimweave.plans.graph_queries import _DEP, hypotheses
from claimweave.plans.registry import query
from claimweave.sources.claimgraph import ClaimGraph


def _named(x: str) -> str:
    return f"coalesce((SELECT max(name) FROM entity WHERE entity_id = {x}), {x})"


@query("hyp_subgraph", _DEP + f""", cited AS (SELECT hypothesis_id, a, b, c.*, row_number() OVER (PARTITION BY hypothesis_id ORDER BY observed_at DESC, claim_id) AS n FROM (SELECT hypothesis_id, a, b, unnest(list_distinct(evidence)) AS claim_id FROM hypothesis) JOIN asserted c USING (claim_id)),
ev AS (SELECT * EXCLUDE n, 0 AS part, row_number() OVER (PARTITION BY hypothesis_id ORDER BY observed_at, claim_id) AS n FROM cited WHERE n <= 30),
first AS (SELECT h.hypothesis_id, a, b, c.*, 1 AS part, row_number() OVER (PARTITION BY h.hypothesis_id ORDER BY observed_at DESC, c.claim_id) AS n FROM hypothesis h JOIN asserted c ON c.subject_entity = a OR c.object_entity = a
  WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.hypothesis_id = h.hypothesis_id AND ev.claim_id = c.claim_id) QUALIFY n <= 15),
second AS (SELECT h.hypothesis_id, a, b, c.*, 2 AS part, row_number() OVER (PARTITION BY h.hypothesis_id ORDER BY observed_at DESC, c.claim_id) AS n FROM hypothesis h JOIN asserted c ON c.subject_entity = b OR c.object_entity = b
  WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.hypothesis_id = h.hypothesis_id AND ev.claim_id = c.claim_id) AND NOT EXISTS (SELECT 1 FROM first f WHERE f.hypothesis_id = h.hypothesis_id AND f.claim_id = c.claim_id) QUALIFY n <= 15),
lines AS (SELECT r.*, json_object('id', claim_id, 'subject', coalesce(x.name, subject_surface), 'predicate', predicate_raw, 'object', CASE WHEN coalesce(y.name, object_surface) IS NOT NULL THEN to_json(coalesce(y.name, object_surface)) WHEN literal_value IS NOT NULL THEN json_object('value', literal_value, 'currency', literal_currency, 'as_of', literal_as_of, 'unit', literal_unit) END,
    'quote', NULL, 'source', source_id, 'observed_at', strftime(observed_at, '%Y-%m-%dT%H:%M:%S'), 'confidence', confidence, 'lineage', lineage_id)::VARCHAR AS line
  FROM (FROM ev UNION ALL BY NAME FROM first UNION ALL BY NAME FROM second) r LEFT JOIN entity x ON x.entity_id = subject_entity LEFT JOIN entity y ON y.entity_id = object_entity)
SELECT hypothesis_id, string_agg(claim_id, ',' ORDER BY part, n) AS shown, string_agg(line, chr(10) ORDER BY part, n) || chr(10) || chr(10) || 'No recorded relationship between ' || {_named("any_value(a)")} || ' and ' || {_named("any_value(b)")} || '.' AS subgraph FROM lines GROUP BY hypothesis_id""")
def _(g: ClaimGraph) -> DataFrame:
    """The claims around a hypothesis: its latest evidence, the latest claims of both subjects, and what is not recorded."""
    return discovery.subgraph(hypotheses(g), g.asserted, g.entity)


@query("subject_claims", "SELECT subject_entity, claim_id FROM (SELECT *, row_number() OVER (PARTITION BY subject_entity ORDER BY observed_at DESC, claim_id) AS n FROM asserted) WHERE n <= 15")
def _(g: ClaimGraph) -> DataFrame:
    latest = Window.partitionBy("subject_entity").orderBy(F.col("observed_at").desc(), "claim_id")
    return g.asserted.select("subject_entity", "claim_id", "observed_at").withColumn("_n", F.row_number().over(latest)).filter("_n <= 15").select("subject_entity", "claim_id")


@query("inv_search_claims", "SELECT claim_id FROM asserted WHERE predicate_raw ILIKE '%source%' OR object_surface ILIKE '%ring%' ORDER BY observed_at DESC, claim_id LIMIT 30")
def _(g: ClaimGraph) -> DataFrame:
    return g.asserted.filter(F.col("predicate_raw").ilike("%source%") | F.col("object_surface").ilike("%ring%")).orderBy(F.col("observed_at").desc(), "claim_id").limit(30).select("claim_id")


@query("inv_ground", "SELECT event_id, string_agg(lineage_id, ',' ORDER BY first) AS lineages FROM (SELECT event_id, lineage_id, min(claim_id) AS first FROM asserted GROUP BY 1, 2) GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    """Cited claims that the firewall holds, and their lineages in order of first citation."""
    cited = g.claim.select("event_id", "claim_id")
    held = cited.join(g.asserted.select("claim_id", "lineage_id").distinct(), "claim_id")
    first = held.groupBy("event_id", "lineage_id").agg(F.min("claim_id").alias("first"))
    return first.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "lineage_id"))), lambda x: x["lineage_id"]), ",").alias("lineages"))


@query("hyp_dispose", _DEP + "SELECT hypothesis_id, CASE WHEN length(hypothesis_id) % 2 = 0 THEN 'refuted' ELSE 'refined' END AS state, least(8, greatest(1, length(hypothesis_id))) AS calls FROM hypothesis")
def _(g: ClaimGraph) -> DataFrame:
    """A refined plan needs something to confirm and to refute; its budget is clamped."""
    plan = F.when(F.length("hypothesis_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a source")))
    state = F.when((F.size("confirm") == 0) | (F.size("refute") == 0), "refuted").otherwise("refined")
    return hypotheses(g).select("hypothesis_id", plan.alias("confirm"), F.array(F.lit("a reason")).alias("refute")).select("hypothesis_id", state.alias("state"), F.least(F.lit(8), F.greatest(F.lit(1), F.length("hypothesis_id"))).alias("calls"))


@query("hypothesis_list", _DEP + "SELECT hypothesis_id, x.name AS name_a, y.name AS name_b, len(evidence) AS evidence FROM hypothesis JOIN entity x ON x.entity_id = a JOIN entity y ON y.entity_id = b")
def _(g: ClaimGraph) -> DataFrame:
    names = g.entity.select("entity_id", "name")
    out = hypotheses(g)
    for side in ("a", "b"):
        out = out.join(names.select(F.col("entity_id").alias(side), F.col("name").alias(f"name_{side}")), side)
    return out.select("hypothesis_id", "name_a", "name_b", F.size("evidence").cast("long").alias("evidence"))


@query("hyp_review", _DEP + "SELECT hypothesis_id, CASE WHEN a < 'S5' THEN 'refuted' ELSE 'generated' END AS state, a < 'S5' AS archive_edge FROM hypothesis")
def _(g: ClaimGraph) -> DataFrame:
    """A rejected hypothesis is refuted and its edge archived; an accepted one is only labelled."""
    rejected = F.col("a") < "S5"
    return hypotheses(g).select("hypothesis_id", F.when(rejected, "refuted").otherwise(F.col("state")).alias("state"), rejected.alias("archive_edge"))


@query("contradiction_choice", "SELECT claim_id, CASE WHEN status = 'superseded' THEN 'dismissed' WHEN lineage_id < 'L3' THEN 'kept' ELSE 'retired' END AS outcome FROM claim WHERE predicate_raw = 'appointed_ceo'")
def _(g: ClaimGraph) -> DataFrame:
    some = g.claim.filter("predicate_raw = 'appointed_ceo'")
    return some.select("claim_id", F.when(F.col("status") == "superseded", "dismissed").when(F.col("lineage_id") < "L3", "kept").otherwise("retired").alias("outcome"))


@query("alerts_list", "SELECT event_id, ticker, CASE WHEN attempts > 1 THEN fetched_at END AS read_at FROM event WHERE connector = 'edgar' AND ticker IN (SELECT ticker FROM watchlist WHERE active) ORDER BY (attempts > 1), fetched_at DESC, event_id LIMIT 50")
def _(g: ClaimGraph) -> DataFrame:
    """Unread alerts first, then the latest."""
    watched = g.watchlist.filter("active").select("ticker").distinct()
    read = F.col("attempts") > 1
    some = g.event.filter("connector = 'edgar'").join(watched, "ticker", "left_semi").select("event_id", "ticker", F.when(read, F.col("fetched_at")).alias("read_at"), read.alias("_read"), "fetched_at")
    return some.orderBy("_read", F.col("fetched_at").desc(), "event_id").limit(50).select("event_id", "ticker", "read_at")


@query("alert_read_all", "SELECT event_id, coalesce(published_at, TIMESTAMP '2002-01-01') AS read_at FROM event WHERE connector = 'edgar'")
def _(g: ClaimGraph) -> DataFrame:
    """Idempotent: what has been read keeps its time."""
    return g.event.filter("connector = 'edgar'").select("event_id", F.coalesce("published_at", F.lit("2002-01-01 00:00:00").cast("timestamp_ntz")).alias("read_at"))


@query("watchlist_resolve", "SELECT w.ticker, coalesce(e.name, 'unknown') AS name, CASE WHEN e.name IS NULL THEN 'none' ELSE 'sec' END AS origin, w.sector FROM watchlist w LEFT JOIN entity e ON e.ticker = w.ticker")
def _(g: ClaimGraph) -> DataFrame:
    found = g.watchlist.join(g.entity.filter("ticker is not null").select("ticker", "name"), "ticker", "left")
    return found.select("ticker", F.coalesce("name", F.lit("unknown")).alias("name"), F.when(F.col("name").isNull(), "none").otherwise("sec").alias("origin"), "sector")


@query("ticker_toggle", "SELECT ticker, CASE WHEN ticker = 'T7' THEN NOT active ELSE active END AS active FROM watchlist")
def _(g: ClaimGraph) -> DataFrame:
    return g.watchlist.select("ticker", F.when(F.col("ticker") == "T7", ~F.col("active")).otherwise(F.col("active")).alias("active"))


@query("status_page", "SELECT 'claims' AS what, count(*) AS n FROM claim UNION ALL SELECT 'mentions', count(*) FROM mention UNION ALL SELECT 'edges', count(*) FROM edge UNION ALL SELECT 'failed', count(*) FROM event WHERE status = 'failed'")
def _(g: ClaimGraph) -> DataFrame:
    edges = graph.materialize_edges(g.claim, g.same_as, g.predicate_map)
    count = lambda rows, what: rows.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"))
    return count(g.claim, "claims").unionByName(count(g.mention, "mentions")).unionByName(count(edges, "edges")).unionByName(count(g.event.filter("status = 'failed'"), "failed"))


@query("failed_events", "SELECT event_id, attempts FROM event WHERE status = 'failed' ORDER BY fetched_at DESC, event_id LIMIT 200")
def _(g: ClaimGraph) -> DataFrame:
    return g.event.filter("status = 'failed'").orderBy(F.col("fetched_at").desc(), "event_id").limit(200).select("event_id", "attempts")


@query("record_failure", "SELECT event_id, CASE WHEN attempts + 1 >= 2 THEN 'parked' ELSE 'open' END AS state FROM event")
def _(g: ClaimGraph) -> DataFrame:
    """Errors are entries of the history; two of them park."""
    history = F.transform(F.sequence(F.lit(0), F.col("attempts")), lambda i: F.struct(F.when(i >= 0, "timeout").alias("error")))
    return g.event.select("event_id", history.alias("h")).select("event_id", F.when(F.size(F.filter("h", lambda x: x["error"].isNotNull())) >= 2, "parked").otherwise("open").alias("state"))


@query("telemetry_prune", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def _(g: ClaimGraph) -> DataFrame:
    events = g.table("events")
    last = events.agg(F.max("ts").alias("_last"))
    return events.join(F.broadcast(last), events["ts"] >= F.col("_last") - F.expr("interval 7 days")).select("event_id")


@query("client_facets", "SELECT sector, count(*) AS n FROM watchlist WHERE active GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    return g.watchlist.filter("active").groupBy("sector").agg(F.count(F.lit(1)).alias("n"))


@query("document_sources", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    return g.table("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("caption_pick", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'en-manual' ELSE 'en-auto' END AS track FROM conversations")
def _(g: ClaimGraph) -> DataFrame:
    """Of offered tracks the first by kind (subtitles before automatic), language and format."""
    rank = lambda kind, lang, form: F.struct(F.lit({"manual": 0, "auto": 1}[kind]).alias("k"), F.lit({"en": 0, "de": 1}[lang]).alias("l"), F.lit({"json3": 0, "vtt": 1}[form]).alias("f"), F.lit(f"{lang}-{kind}").alias("name"))
    offered = F.when(F.col("role") == "user", F.array(rank("auto", "en", "json3"), rank("manual", "en", "vtt"), rank("manual", "de", "json3"))).otherwise(F.array(rank("auto", "de", "json3"), rank("auto", "en", "vtt"), rank("auto", "en", "json3")))
    return g.table("conversations").select("conv_id", "turn", F.array_min(offered)["name"].alias("track"))


@query("feed_sniff", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'atom' ELSE 'html' END AS kind, 'https://e.example.com/' || page_id || '.xml' AS alternate FROM pages")
def _(g: ClaimGraph) -> DataFrame:
    """What a fetched body is by its head, and the feed that a page names."""
    page = F.concat(F.lit('<html><head><link rel="alternate" type="application/rss+xml" href="https://e.example.com/'), F.col("page_id").cast("string"), F.lit('.xml"></head>'), "html")
    third = F.col("page_id") % 3
    body = F.when(third == 0, F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><link>'), "url")).when(third == 1, F.concat(F.lit('<FEED xmlns="http://www.w3.org/2005/Atom"><id>'), "url")).otherwise(F.regexp_replace("html", "(?i)<(rss|feed)", "<"))
    head = F.left(body, F.lit(500))
    kind = F.when(head.rlike(r"(?i)<rss\b"), "rss").when(head.rlike(r"(?i)<feed\b"), "atom").otherwise("html")
    return g.table("pages").select("page_id", kind.alias("kind"), F.regexp_extract(page, r'(?i)<link[^>]*type="application/(?:rss|atom)\+xml"[^>]*href="([^"]*)"', 1).alias("alternate"))


@query("wall_detect", "SELECT page_id, CASE WHEN contains(html, 'spam') THEN 'blocked' WHEN length(html) < 900 THEN 'thin' ELSE 'open' END AS wall FROM pages")
def _(g: ClaimGraph) -> DataFrame:
    """Ordered marker tests of a page's text."""
    return g.table("pages").select("page_id", F.when(F.contains("html", F.lit("spam")), "blocked").when(F.length("html") < 900, "thin").otherwise("open").alias("wall"))


@query("extract_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def _(g: ClaimGraph) -> DataFrame:
    """The first JSON object of an answer with text and a fence around it."""
    answer = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))
    return g.table("events").select("event_id", F.get_json_object(F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), "$.k").cast("int").alias("k"))


@query("manifest", "SELECT source AS source_type, count(*) AS docs, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM documents GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    return g.table("documents").groupBy(F.col("source").alias("source_type")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


@query("router_dup", "SELECT page_id FROM (SELECT page_id, min(page_id) OVER (PARTITION BY regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS first FROM pages) WHERE page_id > first")
def _(g: ClaimGraph) -> DataFrame:
    """Pages whose host the source of an earlier page covers already."""
    hosts = g.table("pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#:]*)", 1).alias("host"))
    live = hosts.groupBy("host").agg(F.min("page_id").alias("first"))
    return hosts.join(live, "host").filter("page_id > first").select("page_id")


@query("link_prediction", _DEP + ", d AS (SELECT via, count(*) AS n FROM side GROUP BY 1) SELECT a, b, round(sum(1.0 / ln(1 + n)), 6) AS score FROM shared JOIN d USING (via) GROUP BY 1, 2 ORDER BY score DESC, a, b LIMIT 100")
def _(g: ClaimGraph) -> DataFrame:
    """An extension: pairs of companies by shared dependencies, rare ones weighing more."""
    return discovery.best_linked(discovery.dependencies(g.asserted, g.entity), 100).orderBy(F.col("score").desc(), "a", "b")
