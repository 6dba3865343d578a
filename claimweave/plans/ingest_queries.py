"""Queries of ingestion: duplicates, mentions, claims, triage and resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions import score
from claimweave.operators import graph, ingest
from claimweave.plans.registry import query
from claimweave.sources import artifacts
from claimweave.sources.claimgraph import ClaimGraph
from claimweave.streaming import streams


def arrivals(g: ClaimGraph) -> DataFrame:
    """Documents as events in order of arrival."""
    return g.table("documents").select(F.col("doc_id").alias("event_id"), F.col("doc_id").alias("fetched"), F.coalesce("text", F.lit("")).alias("text"))


@query("ingest_exact_dup", "SELECT doc_id AS event_id, sha256(coalesce(text, '')) AS hash, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS lineage_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY coalesce(text, '')) THEN 'pending' ELSE 'duplicate' END AS status FROM documents")
def _(g: ClaimGraph) -> DataFrame:
    return ingest.exact_duplicates(arrivals(g)).select("event_id", "hash", "lineage_id", "status")


@query("simhash64")
def _(g: ClaimGraph) -> DataFrame:
    """BLAKE2b is in neither engine's SQL; tests compare with a plain version."""
    return arrivals(g).select("event_id", ingest.simhash64("text").alias("simhash"))


_WORDS = """--more
w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '') AS w FROM benchmark),
sh AS (SELECT item_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
code AS (SELECT item_id, CAST('0x' || substr(md5(s), 1, 15) AS BIGINT) AS c FROM sh),
bit AS (SELECT item_id, i, sum((c >> i) & 1) AS ones, count(*) AS n FROM code, range(60) r(i) GROUP BY 1, 2)
"""


@query("simhash_md5", _WORDS + "SELECT item_id, CAST(sum(CASE WHEN 2 * ones > n THEN CAST(1 AS BIGINT) << i ELSE 0 END) AS BIGINT) AS simhash FROM bit GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    """The sketch over MD5, of the passages of ``benchmark``."""
    return g.table("benchmark").select("item_id", ingest.simhash_md5(F.col("text")).alias("simhash"))


@query("hamming64", "SELECT event_id, bit_count(xor(event_id * 2654435761, user_id * 40503)) AS distance FROM events")
def _(g: ClaimGraph) -> DataFrame:
    return g.table("events").select("event_id", F.bit_count((F.col("event_id") * 2654435761).bitwiseXOR(F.col("user_id") * 40503)).cast("int").alias("distance"))


_NEAR = """--more
h AS (SELECT event_id, user_id * 131 + (event_id % 3) AS h, row_number() OVER (ORDER BY event_id) AS place FROM events WHERE user_id * 131 + (event_id % 3) <> 0),
near AS (SELECT a.event_id, max(b.event_id) AS near_id FROM h a JOIN h b ON b.place < a.place AND b.place >= a.place - 2000 AND bit_count(xor(a.h, b.h)) <= 3 GROUP BY 1)"""


def sketched(g: ClaimGraph) -> DataFrame:
    """Sketches made of the users of ``events``, which SQL can check."""
    return g.table("events").select("event_id", F.col("event_id").alias("position"), (F.col("user_id") * 131 + F.col("event_id") % 3).alias("simhash"))


@query("ingest_near_dup", _NEAR + "SELECT * FROM near")
def _(g: ClaimGraph) -> DataFrame:
    """Near matches among the last 2000 that have a sketch."""
    return ingest.near_duplicates(sketched(g))


LINEAGES = "--recursive" + _NEAR.replace("--more", "", 1) + ", p AS (SELECT h.event_id, near_id FROM h LEFT JOIN near USING (event_id)), c(event_id, root) AS (SELECT event_id, event_id FROM p WHERE near_id IS NULL UNION ALL SELECT p.event_id, c.root FROM c JOIN p ON p.near_id = c.event_id) SELECT event_id, root AS lineage_id FROM c"


@query("near_dup_lineage", LINEAGES)
def _(g: ClaimGraph) -> DataFrame:
    """The lineage of every arrival: a near copy joins that of its match, and so on to the first."""
    rows = sketched(g)
    return ingest.lineages(rows.filter("simhash != 0").select("event_id").join(ingest.near_duplicates(rows), "event_id", "left"))


@query("document_near_dup")
def _(g: ClaimGraph) -> DataFrame:
    """The same over the simhash of every document."""
    rows = arrivals(g).select("event_id", F.col("fetched").alias("position"), ingest.simhash64("text").alias("simhash"))
    return ingest.near_duplicates(rows)


@query("ingest_new", "SELECT count(DISTINCT coalesce(text, '')) AS new_lineages FROM documents")
def _(g: ClaimGraph) -> DataFrame:
    return ingest.exact_duplicates(arrivals(g)).filter("status = 'pending'").agg(F.count(F.lit(1)).alias("new_lineages"))


@query("artifact_path", "SELECT doc_id, source || '/' || substr(sha256(coalesce(text, '')), 1, 2) || '/' || sha256(coalesce(text, '')) || '.txt' AS path, length(rtrim(coalesce(text, ''), chr(10))) AS chars FROM documents")
def _(g: ClaimGraph) -> DataFrame:
    """Content-addressed place of a document, and its length without trailing line ends."""
    text = F.coalesce("text", F.lit(""))
    return g.table("documents").select("doc_id", F.concat("source", F.lit("/"), F.left(F.sha2(text, 256), F.lit(2)), F.lit("/"), F.sha2(text, 256), F.lit(".txt")).alias("path"), F.length(F.rtrim(text, F.lit("\n"))).cast("long").alias("chars"))


@query("artifact_read", "SELECT uri, CASE WHEN octet_length(encode(t)) > 200 THEN NULL ELSE t END AS text, length(rtrim(t, chr(10))) AS chars, octet_length(encode(t)) > 200 AS partial FROM (SELECT DISTINCT source || '/' || substr(sha256(coalesce(text, '')), 1, 2) || '/' || sha256(coalesce(text, '')) || '.txt' AS uri, coalesce(text, '') AS t FROM documents)")
def _(g: ClaimGraph) -> DataFrame:
    """Every document put into the store, twice, and read back with a bound of 200 bytes; the heads of longer ones are left to the tests."""
    root = f"{streams.fresh_folder(g.spark)}/artifacts"
    contents = g.table("documents").select(F.col("source").alias("slug"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"), F.lit(".txt").alias("ext"))
    for _ in range(2):
        artifacts.put(contents, root)
    read = artifacts.read_bounded(artifacts.addressed(contents).select("uri"), root, 200)
    return read.select("uri", F.when(~F.col("partial"), F.col("text")).alias("text"), "chars", "partial")


@query("write_mentions", "SELECT event_id, surface, CASE WHEN bool_or(tag IN ('company', 'security')) THEN 'pending' ELSE 'skipped-v0' END AS state FROM (SELECT 'E' || l_orderkey AS event_id, 'Supplier ' || l_suppkey AS surface, CASE l_linenumber % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'person' ELSE 'place' END AS tag FROM lineitem) GROUP BY 1, 2")
def _(g: ClaimGraph) -> DataFrame:
    third = F.col("l_linenumber") % 3
    tagged = g.table("lineitem").select(F.concat(F.lit("E"), "l_orderkey").alias("event_id"), F.concat(F.lit(" Supplier "), "l_suppkey").alias("surface"), F.when(third == 0, "company").when(third == 1, "person").otherwise("place").alias("tag"))
    return ingest.write_mentions(tagged)


_CLAIM_JSON = "array<struct<subject:string,predicate:string,object:string,literal:double,confidence:double>>"


@query("write_claims", "SELECT 'E' || l_orderkey AS event_id, 'S' || l_suppkey AS subject, CASE WHEN l_discount = 0 THEN 0.5 ELSE round(l_discount, 2) END AS confidence FROM lineitem WHERE l_linenumber <> 3 AND l_tax > 0.01")
def _(g: ClaimGraph) -> DataFrame:
    """An extraction's JSON (made here from order lines) to claims: incomplete ones go, confidence 0 or none becomes 0.5."""
    lines = g.table("lineitem")
    one = F.struct(
        F.when(F.col("l_linenumber") != 3, F.concat(F.lit("S"), "l_suppkey")).otherwise("").alias("subject"), F.lit("ships").alias("predicate"),
        F.when(F.col("l_tax") > 0.01, F.concat(F.lit("P"), "l_partkey")).alias("object"), F.lit(None).cast("double").alias("literal"), F.round(F.col("l_discount") + F.lit(0.0), 2).alias("confidence"),
    )
    payload = lines.groupBy("l_orderkey").agg(F.to_json(F.collect_list(one)).alias("payload"))
    parsed = payload.select(F.concat(F.lit("E"), "l_orderkey").alias("event_id"), F.explode(F.from_json("payload", _CLAIM_JSON)).alias("c")).select("event_id", "c.*")
    full = (F.col("subject") != "") & (F.col("predicate") != "") & (F.col("object").isNotNull() | F.col("literal").isNotNull())
    return parsed.filter(full).select("event_id", "subject", F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 0.5).otherwise(F.col("confidence")).alias("confidence"))


@query("extract_guards", "SELECT event_id, CASE WHEN count_if(ok) > 0 THEN 'extracted' WHEN max(attempts) >= 1 THEN 'failed' ELSE 'pending' END AS status FROM (SELECT c.event_id, c.object_entity IS NOT NULL AS ok, attempts FROM claim c JOIN event e USING (event_id)) GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    """An event fails at its second strike; a strike is an extraction of which nothing is left."""
    joined = g.claim.select("event_id", F.col("object_entity").isNotNull().alias("ok")).join(g.event.select("event_id", "attempts"), "event_id")
    status = F.when(F.count_if("ok") > 0, "extracted").when(F.max("attempts") >= 1, "failed").otherwise("pending")
    return joined.groupBy("event_id").agg(status.alias("status"))


_TRIAGE = """CASE WHEN connector = 'edgar' THEN CASE items WHEN '2.01,9.01' THEN 0.9 WHEN '5.02' THEN 0.7 WHEN '8.01' THEN 0.5 ELSE CASE form WHEN '8-K' THEN 0.5 ELSE 0.4 END END
  WHEN regexp_matches(lower(coalesce(title, '')), 'acquisition|resign') THEN 0.7 ELSE 0.3 END::DOUBLE"""


@query("materiality", f"SELECT event_id, {_TRIAGE} AS materiality FROM event")
def _(g: ClaimGraph) -> DataFrame:
    return g.event.select("event_id", score.materiality(F.col("connector"), F.col("form"), F.col("items"), F.col("title")).alias("materiality"))


@query("triage", f"SELECT e.event_id, m AS materiality, CASE WHEN m >= 0.6 THEN 'fast' ELSE 'slow' END AS route, m >= 0.6 AND e.ticker IN (SELECT ticker FROM watchlist WHERE active) AS alert FROM (SELECT *, {_TRIAGE} AS m FROM event WHERE status = 'pending') e")
def _(g: ClaimGraph) -> DataFrame:
    return ingest.triage(g.event, g.watchlist)


@query("er_resolve_surfaces", "SELECT 'Supplier ' || s_suppkey AS surface, CASE WHEN s_suppkey % 5 = 1 THEN 'alias' WHEN s_suppkey % 4 = 0 THEN 'name_exact' WHEN s_suppkey % 4 = 1 AND s_suppkey >= 10 THEN 'name_stripped' ELSE 'queue' END AS tier, CASE WHEN s_suppkey % 5 = 1 OR s_suppkey % 4 = 0 OR (s_suppkey % 4 = 1 AND s_suppkey >= 10) THEN 'S' || s_suppkey END AS entity FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)")
def _(g: ClaimGraph) -> DataFrame:
    """Surfaces of mentions against aliases, tickers and registered names, some with a legal form."""
    key = F.col("s_suppkey")
    suppliers = g.table("supplier")
    registered = suppliers.filter(key % 4 < 2).select(F.when(key % 4 == 0, F.concat(F.lit("Supplier "), key)).otherwise(F.concat(F.lit("The Supplier "), key, F.lit(" Holdings, Inc."))).alias("name"), F.concat(F.lit("S"), key).alias("entity"))
    alias = g.mention.filter("resolver = 'alias:exact'").select("surface", F.col("resolved_entity").alias("entity")).distinct()
    tickers = g.entity.filter("ticker is not null").select("ticker", F.col("entity_id").alias("entity"))
    # A one-digit key is dropped as a stray letter, so those bare names are shared and stay in the queue.
    return ingest.resolve(g.mention.select("surface"), alias, tickers, registered).select("surface", "tier", "entity")


@query("surface_fuzzy", "--more\nn AS (SELECT DISTINCT p_name AS p, split_part(p_name, ' ', 1) AS k FROM part) SELECT a.p AS a, b.p AS b, round(1 - levenshtein(a.p, b.p) / greatest(length(a.p), length(b.p)), 6) AS ratio FROM n a JOIN n b ON a.k = b.k AND a.p < b.p WHERE round(1 - levenshtein(a.p, b.p) / greatest(length(a.p), length(b.p)), 6) >= 0.6")
def _(g: ClaimGraph) -> DataFrame:
    """Near spellings of product names within one first word, by edit distance: blocks are words, sides distinct."""
    names = g.table("part").select("p_name").distinct().withColumn("block", F.split_part("p_name", F.lit(" "), F.lit(1)))
    a, b = names.withColumnRenamed("p_name", "a"), names.withColumnRenamed("p_name", "b")
    near = a.join(b, "block").filter("a < b").withColumn("ratio", F.round(1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b")), 6))
    return near.filter("ratio >= 0.6").select("a", "b", "ratio")


@query("adjudicate_apply", "SELECT surface, CASE WHEN k % 3 = 0 THEN 'match' WHEN k % 3 = 1 THEN 'new_entity' ELSE 'ambiguous' END AS verdict, CASE WHEN k % 3 = 0 THEN 'S' || k WHEN k % 3 = 1 THEN sha256('name:supplier ' || k) END AS entity FROM (SELECT DISTINCT surface, CAST(split_part(surface, ' ', 2) AS INT) AS k FROM mention WHERE resolved_entity IS NULL)")
def _(g: ClaimGraph) -> DataFrame:
    """Verdicts on queued surfaces: matches are pinned to a candidate, new entities get an id of their lower-cased name."""
    queue = g.mention.filter("resolved_entity is null").select("surface").distinct().withColumn("k", F.split_part("surface", F.lit(" "), F.lit(2)).cast("int"))
    verdict = F.when(F.col("k") % 3 == 0, "match").when(F.col("k") % 3 == 1, "new_entity").otherwise("ambiguous")
    candidates = g.entity.filter("kind = 'company'").select(F.col("entity_id").alias("_c"))
    pinned = queue.join(candidates, F.concat(F.lit("S"), "k") == F.col("_c"), "left").withColumn("verdict", verdict)
    made = F.sha2(F.concat(F.lit("name:"), F.lower("surface")), 256)
    return pinned.select("surface", F.when((F.col("verdict") == "match") & F.col("_c").isNull(), "ambiguous").otherwise(F.col("verdict")).alias("verdict"), F.when(F.col("verdict") == "match", F.col("_c")).when(F.col("verdict") == "new_entity", made).alias("entity"))


@query("summarize_dispose", "SELECT doc_id, CASE WHEN length(coalesce(text, '')) < 600 THEN 'skipped' ELSE 'done' END AS state, CASE WHEN length(coalesce(text, '')) >= 600 THEN left(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')), 2000) END AS summary FROM documents")
def _(g: ClaimGraph) -> DataFrame:
    """White space squeezed and the summary bounded; short documents are skipped."""
    short = F.length(F.coalesce("text", F.lit(""))) < 600
    return g.table("documents").select("doc_id", F.when(short, "skipped").otherwise("done").alias("state"), F.when(~short, F.left(F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0b]+", " ")), F.lit(2000))).alias("summary"))


@query("history_append", "SELECT event_id, len(h) AS entries, h[-1] AS last FROM (SELECT event_id, list_append(CASE WHEN attempts > 0 THEN list_transform(range(attempts), lambda i: 'try ' || i) ELSE [] END, 'now ' || status) AS h FROM event)")
def _(g: ClaimGraph) -> DataFrame:
    tries = F.when(F.col("attempts") > 0, F.transform(F.sequence(F.lit(0), F.col("attempts") - 1), lambda i: F.concat(F.lit("try "), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    history = F.array_append(tries, F.concat(F.lit("now "), "status"))
    return g.event.select("event_id", F.size(history).cast("long").alias("entries"), F.element_at(history, -1).alias("last"))


@query("array_overlap", "SELECT count_if(list_has_any(ids, ['S1', 'S2'])) AS overlaps, count_if(list_contains(ids, 'S1')) AS has, count_if(list_has_all(ids, ['S1', 'S2'])) AS all_of FROM (SELECT event_id, list(DISTINCT subject_entity) AS ids FROM claim GROUP BY 1)")
def _(g: ClaimGraph) -> DataFrame:
    ids = g.claim.groupBy("event_id").agg(F.collect_set("subject_entity").alias("ids"))
    both = F.array(F.lit("S1"), F.lit("S2"))
    return ids.agg(F.count_if(F.arrays_overlap("ids", both)).alias("overlaps"), F.count_if(F.array_contains("ids", "S1")).alias("has"), F.count_if(F.size(F.array_except(both, "ids")) == 0).alias("all_of"))


@query("ner_link_stats", "SELECT count(*) AS claims, count(linked) AS linked FROM (SELECT c.claim_id, max(m.resolved_entity) AS linked FROM claim c LEFT JOIN mention m ON m.event_id = c.event_id AND m.surface = c.subject_surface GROUP BY 1)")
def _(g: ClaimGraph) -> DataFrame:
    linked = g.claim.select("claim_id", "event_id", F.col("subject_surface").alias("surface")).join(g.mention, ["event_id", "surface"], "left")
    return linked.agg(F.countDistinct("claim_id").alias("claims"), F.count("resolved_entity").alias("linked"))


@query("edge_archive", "SELECT count(*) AS kept FROM edge WHERE predicate <> 'owns'")
def _(g: ClaimGraph) -> DataFrame:
    return graph.materialize_edges(g.claim, g.same_as, g.predicate_map).filter("predicate != 'owns'").agg(F.count(F.lit(1)).alias("kept"))
