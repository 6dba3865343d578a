"""Queries over claims and edges: materialisation, quality and discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions import score
from claimweave.operators import discovery, edge_store, graph, merges
from claimweave.plans.registry import query
from claimweave.session import cut
from claimweave.sources.claimgraph import ClaimGraph
from claimweave.streaming import streams

#: Queries take the time at which they look as a parameter; this is the registered ones'.
AT = "2002-01-01 00:00:00"


def at():  # noqa: ANN201
    return F.lit(AT).cast("timestamp_ntz")


def edges(g: ClaimGraph) -> DataFrame:
    return graph.materialize_edges(g.claim, g.same_as, g.predicate_map)


@query("materialize_edges", "SELECT * FROM edge")
def _(g: ClaimGraph) -> DataFrame:
    return edges(g)


@query("predicate_canon", "SELECT claim_id, predicate_canon FROM canon_claim")
def _(g: ClaimGraph) -> DataFrame:
    return graph.with_canon(g.claim, g.predicate_map).select("claim_id", "predicate_canon")


@query("same_as_canonical", "SELECT claim_id, src, dst FROM canon_claim")
def _(g: ClaimGraph) -> DataFrame:
    return graph.canonicalize(g.claim, g.same_as, {"subject_entity": "src", "object_entity": "dst"}).select("claim_id", "src", "dst")


@query("edge_relevance", f"""SELECT src, dst, predicate, round(CASE WHEN half_life_days IS NULL THEN 1.0
  ELSE pow(2.0, -(epoch_us(TIMESTAMP '{AT}') - epoch_us(last_evidence_at)) / 86400000000.0 / half_life_days) END, 6) AS relevance FROM edge""")
def _(g: ClaimGraph) -> DataFrame:
    return edges(g).select("src", "dst", "predicate", F.round(score.edge_relevance(F.col("half_life_days"), F.col("last_evidence_at"), at()), 6).alias("relevance"))


@query("confidence_now", f"""SELECT claim_id, round_even(CASE WHEN predicate_raw = 'owns' THEN confidence ELSE confidence * pow(2.0,
  -greatest(0.0, (epoch_us(TIMESTAMP '{AT}') - epoch_us(observed_at)) / 86400000000.0) / CASE WHEN predicate_raw = 'reported_revenue' THEN 365 ELSE 540 END) END, 2) AS now FROM claim""")
def _(g: ClaimGraph) -> DataFrame:
    return g.claim.select("claim_id", score.confidence_now(F.col("confidence"), F.col("observed_at"), F.col("predicate_raw"), at()).alias("now"))


@query("link_claims", "SELECT claim_id, subject_entity, coalesce(s.b, m.resolved_entity) AS linked_subject FROM claim c JOIN mention m ON m.event_id = c.event_id AND m.surface = c.subject_surface LEFT JOIN same_as s ON s.a = m.resolved_entity WHERE m.resolved_entity IS NOT NULL AND c.subject_entity IS DISTINCT FROM coalesce(s.b, m.resolved_entity)")
def _(g: ClaimGraph) -> DataFrame:
    return graph.link_claims(g.claim, g.mention, g.same_as)


_VARIED = ("appointed_ceo", "named_cfo", "chairs_board", "headquartered_in", "incorporated_in", "incorporation", "ticker_is", "parent_of", "owner_of", "located_in")


def varied(claims: DataFrame) -> DataFrame:
    """The claims on chief executives spread over predicates with each single-valued keyword, and one without."""
    nth = F.floor(F.substring("subject_entity", 2, 20).cast("int") / 10) % len(_VARIED)
    return claims.withColumn("predicate_raw", F.when(F.col("predicate_raw") == "appointed_ceo", F.get(F.array(*map(F.lit, _VARIED)), nth.cast("int"))).otherwise(F.col("predicate_raw")))


def folded(g: ClaimGraph) -> DataFrame:
    """The varied claims under the entities that their subjects were merged into, with what those were before."""
    claims = graph.with_raw(varied(g.claim), g.mention)
    return graph.canonicalize(claims, g.same_as, {"subject_entity": "_folded"}).withColumn("subject_entity", F.col("_folded")).drop("_folded")


_PAIRS = f"""--more
c AS (SELECT * REPLACE (CASE WHEN predicate_raw = 'appointed_ceo' THEN {list(_VARIED)}[1 + CAST(substr(subject_entity, 2) AS INT) // 10 % 10] ELSE predicate_canon END AS predicate_canon), CASE WHEN object_entity IS NOT NULL THEN 'e' ELSE 's' END AS k, coalesce(object_entity, upper(object_surface), '') AS o FROM canon_claim WHERE status = 'asserted'),
pairs AS (SELECT a.subject_entity, a.predicate_canon, a.claim_id AS claim_a, b.claim_id AS claim_b,
  CASE WHEN regexp_matches(a.predicate_canon, 'ceo|cfo|chair|headquarter|incorporat|ticker|parent|owner') AND a.k = b.k AND a.o <> '' AND b.o <> '' AND a.o <> b.o THEN 'object_conflict'
       WHEN a.literal_value IS NOT NULL AND b.literal_value IS NOT NULL AND a.literal_currency IS NOT DISTINCT FROM b.literal_currency AND a.literal_as_of IS NOT DISTINCT FROM b.literal_as_of AND a.literal_unit IS NOT DISTINCT FROM b.literal_unit
        AND abs(a.literal_value - b.literal_value) / greatest(abs(a.literal_value), abs(b.literal_value)) > 0.05 THEN 'literal_conflict' END AS kind,
  a.lineage_id = b.lineage_id AS same_lineage, a.observed_at AS observed_a, b.observed_at AS observed_b
  FROM c a JOIN c b ON a.subject_entity = b.subject_entity AND a.predicate_canon = b.predicate_canon AND a.claim_id < b.claim_id
  WHERE NOT coalesce(a.valid_from > b.valid_to, false) AND NOT coalesce(b.valid_from > a.valid_to, false))
"""


@query("contradictions_detect", _PAIRS + "SELECT subject_entity, predicate_canon, claim_a, claim_b, kind, same_lineage FROM pairs WHERE kind IS NOT NULL")
def _(g: ClaimGraph) -> DataFrame:
    return graph.contradictions(varied(g.claim), g.predicate_map).select("subject_entity", "predicate_canon", "claim_a", "claim_b", "kind", "same_lineage")


@query("contradictions_resolve")
def _(g: ClaimGraph) -> DataFrame:
    """The greedy order inside a group is beyond SQL; tests compare with a plain loop."""
    return graph.resolve_claims(varied(g.claim), g.predicate_map, discovery.watched_entities(g.entity, g.watchlist), g.mention)


@query("contradiction_alerts", _PAIRS + "SELECT subject_entity, count(*) AS conflicts FROM pairs JOIN entity e ON e.entity_id = subject_entity JOIN watchlist w ON w.ticker = e.ticker AND w.active WHERE pairs.kind IS NOT NULL AND NOT same_lineage GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    watched = discovery.watched_entities(g.entity, g.watchlist).withColumnRenamed("entity_id", "subject_entity")
    return graph.contradictions(varied(g.claim), g.predicate_map).filter("not same_lineage").join(watched, "subject_entity", "left_semi").groupBy("subject_entity").agg(F.count(F.lit(1)).alias("conflicts"))


@query("unmerge_heal", _PAIRS.replace("a.subject_entity", "a.src").replace("b.subject_entity", "b.src").replace("SELECT a.src,", "SELECT a.src AS subject_entity,") + ", raw AS (SELECT c.claim_id, coalesce(m.resolved_entity, c.subject_entity) AS r FROM claim c LEFT JOIN mention m ON m.event_id = c.event_id AND m.surface = c.subject_surface) "
  "SELECT claim_a, claim_b, x.r AS raw_a, y.r AS raw_b FROM pairs JOIN raw x ON x.claim_id = claim_a JOIN raw y ON y.claim_id = claim_b WHERE kind IS NOT NULL AND x.r IS DISTINCT FROM y.r")
def _(g: ClaimGraph) -> DataFrame:
    """Conflicts that only exist because subjects were merged."""
    return graph.made_by_merge(graph.contradictions(folded(g), g.predicate_map, ("raw",)))


@query("reliability", """--more
backed AS (SELECT subject_entity, predicate_canon, object_entity FROM canon_claim WHERE status = 'asserted' AND object_entity IS NOT NULL GROUP BY ALL HAVING count(DISTINCT lineage_id) >= 2),
n AS (SELECT source_id, count(*) AS n_claims, count_if(status = 'asserted' AND b.subject_entity IS NOT NULL) AS corroborated, count_if(status = 'superseded') AS superseded
  FROM canon_claim c LEFT JOIN backed b USING (subject_entity, predicate_canon, object_entity) GROUP BY 1)
SELECT source_id, n_claims, CAST(corroborated AS BIGINT) AS corroborated, CAST(superseded AS BIGINT) AS superseded,
  round(least(0.95, greatest(0.1, 0.5 + 0.3 * corroborated / n_claims - 0.4 * superseded / n_claims)), 6) AS score FROM n WHERE n_claims >= 5""")
def _(g: ClaimGraph) -> DataFrame:
    return graph.reliability(g.claim, g.predicate_map).withColumn("score", F.round("score", 6))


_DEP = """--more
dep AS (SELECT * FROM asserted c WHERE object_entity IS NOT NULL AND subject_entity <> object_entity AND regexp_matches(lower(predicate_raw), 'suppl|customer|audit|agent|board|backs|partner|invest|contract|sourc|depend|procur|relies|buys')
  AND EXISTS (SELECT 1 FROM entity e WHERE e.entity_id = c.subject_entity AND e.kind = 'company')),
side AS (SELECT DISTINCT subject_entity AS s, object_entity AS via FROM dep),
shared AS (SELECT x.s AS a, y.s AS b, x.via FROM side x JOIN side y ON x.via = y.via AND x.s < y.s),
open_pairs AS (SELECT * FROM shared WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE (e.src = a AND e.dst = b) OR (e.src = b AND e.dst = a))),
hyp AS (SELECT a, b, min(via) AS via FROM (SELECT * FROM open_pairs ORDER BY a, b, via LIMIT 50) GROUP BY a, b),
ranked AS (SELECT subject_entity AS s, object_entity AS via, claim_id, row_number() OVER (PARTITION BY subject_entity, object_entity ORDER BY observed_at DESC, claim_id) AS n FROM dep),
ids AS (SELECT s, via, list(claim_id ORDER BY n) AS ids FROM ranked WHERE n <= 30 GROUP BY 1, 2),
hypothesis AS (SELECT a || '|' || b AS hypothesis_id, a, b, hyp.via, list_concat(x.ids, y.ids) AS evidence FROM hyp JOIN ids x ON x.s = a AND x.via = hyp.via JOIN ids y ON y.s = b AND y.via = hyp.via)
"""


def hypotheses(g: ClaimGraph) -> DataFrame:
    """Written once for a graph, as several steps of a query read them; there are at most ``discovery.MOST``."""
    if not hasattr(g, "_hypotheses"):
        g._hypotheses = cut(discovery.attribute_join(g.asserted, g.entity, edges(g)))
    return g._hypotheses


@query("dependency_claims", _DEP + "SELECT claim_id, subject_entity, object_entity FROM dep")
def _(g: ClaimGraph) -> DataFrame:
    return discovery.dependencies(g.asserted, g.entity).select("claim_id", "subject_entity", "object_entity")


@query("attr_self_join", _DEP + "SELECT a, b, count(*) AS shared FROM shared GROUP BY 1, 2")
def _(g: ClaimGraph) -> DataFrame:
    return discovery.shared_pairs(discovery.dependencies(g.asserted, g.entity)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


@query("no_existing_edge", _DEP + ", e2 AS (SELECT DISTINCT l1.subject_entity AS src, l2.subject_entity AS dst FROM claim l1 JOIN claim l2 ON l1.event_id = l2.event_id AND l1.subject_entity <> l2.subject_entity AND l1.predicate_raw = 'owns' AND l2.predicate_raw = 'owns') "
  "SELECT DISTINCT a, b FROM shared WHERE NOT EXISTS (SELECT 1 FROM e2 WHERE src = a AND dst = b) AND NOT EXISTS (SELECT 1 FROM e2 WHERE src = b AND dst = a)")
def _(g: ClaimGraph) -> DataFrame:
    """Pairs of companies without a joint ownership event; such events stand for edges between companies here."""
    owns = g.claim.filter("predicate_raw = 'owns'").select("event_id", "subject_entity").distinct()
    known = owns.withColumnRenamed("subject_entity", "src").join(owns.withColumnRenamed("subject_entity", "dst"), "event_id").filter("src != dst")
    return discovery.without_edge(discovery.shared_pairs(discovery.dependencies(g.asserted, g.entity)).select("a", "b").distinct(), known)


@query("attribute_join", _DEP + "SELECT hypothesis_id, a, b, via, evidence FROM hypothesis")
def _(g: ClaimGraph) -> DataFrame:
    return hypotheses(g).drop("state", "strategy")


_FUNNEL = _DEP + """,
seen AS (SELECT DISTINCT event_id, e FROM (SELECT event_id, subject_entity AS e FROM asserted UNION ALL SELECT event_id, object_entity FROM asserted WHERE object_entity IS NOT NULL)),
co AS (SELECT h.hypothesis_id, count(y.event_id) AS together FROM hypothesis h LEFT JOIN seen x ON x.e = h.a LEFT JOIN seen y ON y.e = h.b AND y.event_id = x.event_id GROUP BY 1),
watched AS (SELECT DISTINCT entity_id FROM entity e JOIN watchlist w ON w.ticker = e.ticker WHERE active),
scored AS (SELECT h.hypothesis_id, together, 1.0 / (1.0 + together) * CASE (a IN (FROM watched))::INT + (b IN (FROM watched))::INT WHEN 2 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.4 END * 0.6 AS score FROM hypothesis h JOIN co USING (hypothesis_id)),
best AS (SELECT hypothesis_id FROM scored WHERE score >= 0.05 ORDER BY round(score, 9) DESC, hypothesis_id LIMIT 5)
"""


@query("co_mention_pairs", _FUNNEL + "SELECT hypothesis_id, together FROM scored")
def _(g: ClaimGraph) -> DataFrame:
    return discovery.co_mentions(g.asserted, hypotheses(g)).select("hypothesis_id", "together")


@query("funnel_triage", _FUNNEL + "SELECT hypothesis_id, round(score, 6) AS score, CASE WHEN hypothesis_id IN (FROM best) THEN 'triaged' ELSE 'generated' END AS state FROM scored")
def _(g: ClaimGraph) -> DataFrame:
    return discovery.funnel(hypotheses(g), g.asserted, g.entity, g.watchlist).select("hypothesis_id", F.round("score", 6).alias("score"), "state")


def evidence(g: ClaimGraph) -> DataFrame:
    cited = hypotheses(g).select("hypothesis_id", F.explode("evidence").alias("claim_id"))
    return cited.join(g.claim.select("claim_id", "lineage_id", "source_id"), "claim_id").join(g.source, "source_id")


_GATE = _DEP + """,
ev AS (SELECT hypothesis_id, unnest(evidence) AS claim_id FROM hypothesis),
lin AS (SELECT hypothesis_id, lineage_id, max(reliability) AS rel FROM ev JOIN claim USING (claim_id) JOIN source USING (source_id) GROUP BY 1, 2),
ind AS (SELECT hypothesis_id, count_if(rel >= 0.4) + least(count_if(rel IS NULL OR rel < 0.4), 1) AS independent, coalesce(bool_or(rel >= 0.5), false) AS established FROM lin GROUP BY 1)
"""


@query("evidence_independence", _GATE + "SELECT hypothesis_id, CAST(independent AS BIGINT) AS independent, established FROM ind")
def _(g: ClaimGraph) -> DataFrame:
    return discovery.independence(evidence(g))


@query("verify_gate", _GATE + """SELECT hypothesis_id, CAST(independent AS BIGINT) AS independent, CASE WHEN v = 'promote' AND independent >= 2 AND established THEN 'promoted' WHEN v = 'refute' THEN 'refuted' ELSE 'parked' END AS state, conf AS confidence
  FROM (SELECT *, CASE length(hypothesis_id) % 3 WHEN 0 THEN 'promote' WHEN 1 THEN 'refute' ELSE 'odd' END AS v, CASE length(hypothesis_id) % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.25 END AS conf FROM ind)""")
def _(g: ClaimGraph) -> DataFrame:
    third = F.length("hypothesis_id") % 3
    verdicts = hypotheses(g).select("hypothesis_id", F.when(third == 0, "promote").when(third == 1, "refute").otherwise("odd").alias("verdict"), F.when(third == 0, "1.7").when(third == 1, "much").otherwise("0.25").alias("confidence"))
    return discovery.verify_gate(verdicts, discovery.independence(evidence(g)))


@query("wake", _DEP + """, last AS (SELECT e, max(t) AS t FROM (SELECT subject_entity AS e, observed_at AS t FROM asserted UNION ALL SELECT object_entity, observed_at FROM asserted) GROUP BY 1)
SELECT DISTINCT hypothesis_id FROM hypothesis h JOIN last ON e IN (a, b, via) WHERE t > TIMESTAMP '2001-07-15 00:00:00'""")
def _(g: ClaimGraph) -> DataFrame:
    parked = hypotheses(g).select("hypothesis_id", F.lit("2001-07-15 00:00:00").cast("timestamp_ntz").alias("parked_at"), F.array("a", "b", "via").alias("entities"))
    return discovery.wake(parked, g.asserted)


@query("edge_peer", "SELECT entity, peer, predicate FROM (SELECT src AS entity, dst AS peer, predicate FROM edge UNION ALL SELECT dst, src, predicate FROM edge WHERE src <> dst)")
def _(g: ClaimGraph) -> DataFrame:
    e = edges(g).select(F.col("src").alias("entity"), F.col("dst").alias("peer"), "predicate")
    return e.unionByName(e.filter("entity != peer").select(F.col("peer").alias("entity"), F.col("entity").alias("peer"), "predicate"))


@query("doc_edges", "SELECT event_id, src, dst, predicate, count(*) AS here FROM (SELECT src, dst, predicate, unnest(claim_ids) AS claim_id FROM edge) JOIN claim USING (claim_id) GROUP BY 1, 2, 3, 4")
def _(g: ClaimGraph) -> DataFrame:
    cited = edges(g).select("src", "dst", "predicate", F.explode("claim_ids").alias("claim_id"))
    return cited.join(g.claim.select("claim_id", "event_id"), "claim_id").groupBy("event_id", "src", "dst", "predicate").agg(F.count(F.lit(1)).alias("here"))


@query("doc_hypotheses", _DEP + "SELECT DISTINCT event_id, hypothesis_id FROM (SELECT hypothesis_id, unnest(evidence) AS claim_id FROM hypothesis) JOIN claim USING (claim_id)")
def _(g: ClaimGraph) -> DataFrame:
    return hypotheses(g).select("hypothesis_id", F.explode("evidence").alias("claim_id")).join(g.claim.select("claim_id", "event_id"), "claim_id").select("event_id", "hypothesis_id").distinct()


@query("join_evidence_lineage", _DEP + "SELECT hypothesis_id, claim_id, lineage_id, reliability FROM (SELECT hypothesis_id, unnest(evidence) AS claim_id FROM hypothesis) JOIN claim USING (claim_id) JOIN source USING (source_id)")
def _(g: ClaimGraph) -> DataFrame:
    return evidence(g).select("hypothesis_id", "claim_id", "lineage_id", "reliability")


@query("merge_into", "--more\nt AS (SELECT coalesce((SELECT b FROM same_as WHERE a = 'S29'), 'S29') AS t) SELECT a, CASE WHEN b = 'S10' THEN t ELSE b END AS b FROM same_as, t UNION ALL SELECT 'S10', t FROM t")
def _(g: ClaimGraph) -> DataFrame:
    """Merging S10 (into which S19 was merged) into S29, which stands for S20."""
    return graph.merge_log(g.same_as, "S10", "S29")


@query("unmerge", "SELECT src, dst, predicate, len(claim_ids) AS claims FROM (SELECT subject_entity AS src, coalesce(s.b, object_entity) AS dst, predicate_canon AS predicate, list(claim_id) AS claim_ids FROM canon_claim LEFT JOIN same_as s ON s.a = object_entity WHERE status = 'asserted' AND object_entity IS NOT NULL AND subject_entity IN ('S9', 'S0') GROUP BY 1, 2, 3)")
def _(g: ClaimGraph) -> DataFrame:
    """Edges of S0 and S9 after their merge is undone."""
    some = g.claim.filter("subject_entity in ('S0', 'S9')")
    return graph.materialize_edges(some, g.same_as.filter("a != 'S9'"), g.predicate_map).select("src", "dst", "predicate", F.size("claim_ids").cast("long").alias("claims"))


def merge_requests(g: ClaimGraph) -> DataFrame:
    """For each ten suppliers a chain of merges; every other family takes the last ones back."""
    steps = [(1, "merge", 1, 2), (2, "merge", 2, 3), (3, "merge", 3, 4), (4, "merge", 6, 6), (5, "merge", 7, 4), (6, "unmerge", 3, None), (7, "unmerge", 2, None)]
    step = F.explode(F.array(*[F.struct(F.lit(n).alias("step"), F.lit(kind).alias("kind"), F.lit(x).alias("x"), F.lit(y).cast("int").alias("y")) for n, kind, x, y in steps]))
    each = g.table("supplier").filter("s_suppkey % 10 = 0").select("s_suppkey", step.alias("s")).select("s_suppkey", "s.*").filter((F.col("kind") == "merge") | (F.col("s_suppkey") % 20 == 0))
    name = lambda c: F.concat(F.lit("S"), (F.col("s_suppkey") + F.col(c)).cast("string"))
    return each.select((F.col("s_suppkey") * 10 + F.col("step")).alias("op"), "kind", name("x").alias("entity"), name("y").alias("into"))


@query("merge_state", "SELECT 'S' || (s_suppkey + x) AS a, 'S' || (s_suppkey + y) AS b FROM supplier, (VALUES (true, 1, 2), (true, 7, 4), (false, 1, 4), (false, 2, 4), (false, 3, 4), (false, 7, 4)) AS v(undone, x, y) WHERE s_suppkey % 10 = 0 AND undone = (s_suppkey % 20 = 0)")
def _(g: ClaimGraph) -> DataFrame:
    """Who is merged into whom after all requests: chains re-pointed, and unwound one operation at a time."""
    return merges.current(merges.play(merge_requests(g))).select("a", "b")


@query("merge_heal", _PAIRS.replace("a.subject_entity", "a.src").replace("b.subject_entity", "b.src").replace("SELECT a.src,", "SELECT a.src AS subject_entity,") + """, raw AS (SELECT c.claim_id, coalesce(m.resolved_entity, c.subject_entity) AS r FROM claim c LEFT JOIN mention m ON m.event_id = c.event_id AND m.surface = c.subject_surface)
SELECT claim_a, claim_b, claim_a AS restored FROM pairs JOIN raw x ON x.claim_id = claim_a JOIN raw y ON y.claim_id = claim_b WHERE kind IS NOT NULL AND same_lineage AND x.r IS DISTINCT FROM y.r AND (x.r IN (SELECT a FROM same_as) OR y.r IN (SELECT a FROM same_as))""")
def _(g: ClaimGraph) -> DataFrame:
    """Pairs of one lineage that met through a merge, with the claim that comes back when all merges are undone; here the second of a pair was kept."""
    claims = merges.with_undone(folded(g), g.same_as.select(F.col("a").alias("entity")))
    resolved = graph.contradictions(claims, g.predicate_map, ("raw", "undone")).filter("same_lineage").withColumn("kept", F.col("claim_b"))
    return merges.heal_carried(resolved)


_OBJECTS = "--more\npm AS (SELECT event_id, object_surface AS surface, CASE WHEN min(claim_id) LIKE '%7' THEN 'S9' ELSE 'P' || min(length(claim_id)) END AS resolved_entity FROM claim WHERE object_surface IS NOT NULL GROUP BY 1, 2)\n"


@query("link_claims_both", _OBJECTS + """SELECT claim_id, subject, object FROM (SELECT claim_id, coalesce(s.b, m.resolved_entity, c.subject_entity) AS subject, coalesce(t.b, n.resolved_entity, c.object_entity) AS object, c.subject_entity AS was_s, c.object_entity AS was_o FROM claim c
  LEFT JOIN mention m ON m.event_id = c.event_id AND m.surface = c.subject_surface AND m.resolved_entity IS NOT NULL LEFT JOIN same_as s ON s.a = m.resolved_entity
  LEFT JOIN pm n ON n.event_id = c.event_id AND n.surface = c.object_surface LEFT JOIN same_as t ON t.a = n.resolved_entity) WHERE subject IS DISTINCT FROM was_s OR object IS DISTINCT FROM was_o""")
def _(g: ClaimGraph) -> DataFrame:
    """Subjects and objects linked to what the mentions of their surfaces in the claim's event resolved to, merges folded; changed claims only."""
    named = g.claim.filter("object_surface is not null").groupBy("event_id", F.col("object_surface").alias("surface")).agg(F.min("claim_id").alias("_c"), F.min(F.length("claim_id")).alias("_l"))
    objects = named.select("event_id", "surface", F.when(F.endswith("_c", F.lit("7")), "S9").otherwise(F.concat(F.lit("P"), F.col("_l").cast("string"))).alias("resolved_entity"))
    return graph.link_both(g.claim, g.mention.select("event_id", "surface", "resolved_entity").unionByName(objects), g.same_as)


@query("edges_refreshed", "SELECT src, dst, predicate, len(claim_ids) AS claims, confidence FROM edge")
def _(g: ClaimGraph) -> DataFrame:
    """Edge files that were built before the claims of some suppliers came in, brought up to date in the slices these touch."""
    path = f"{streams.fresh_folder(g.spark)}/edges"
    late = F.expr("int(substr(subject_entity, 2)) % 20 = 3")
    edge_store.rebuild(g.claim.filter(~late), g.same_as, g.predicate_map, path)
    edge_store.refresh(g.claim.filter(late), g.claim, g.same_as, g.predicate_map, path)
    return edge_store.stored(g.spark, path).select("src", "dst", "predicate", F.size("claim_ids").cast("long").alias("claims"), "confidence")
