"""Scalar functions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions import score, text
from claimweave.plans.registry import query
from claimweave.sources.claimgraph import ClaimGraph


def names(g: ClaimGraph) -> DataFrame:
    """Company-like names made of suppliers' keys."""
    key = F.col("s_suppkey")
    form = F.when(key % 4 == 0, "The Vale & Co., Inc.").when(key % 4 == 1, "Aktien-Bau S.p.A. Holdings").when(key % 4 == 2, "north GROUP ltd").otherwise("Inc.")
    return g.table("supplier").select("s_suppkey", F.concat(form, F.lit(" "), F.when(key % 2 == 0, "").otherwise("LLC")).alias("name"))


_NAMES = "(SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'The Vale & Co., Inc.' WHEN 1 THEN 'Aktien-Bau S.p.A. Holdings' WHEN 2 THEN 'north GROUP ltd' ELSE 'Inc.' END || ' ' || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'LLC' END AS name FROM supplier)"


@query("fn_norm", f"SELECT s_suppkey, trim(regexp_replace(replace(upper(name), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g')) AS norm FROM {_NAMES}")
def _(g: ClaimGraph) -> DataFrame:
    return names(g).select("s_suppkey", text.norm(F.col("name")).alias("norm"))


@query("fn_strip_suffix", f"SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'VALE AND' WHEN 1 THEN 'AKTIEN BAU' WHEN 2 THEN 'NORTH' ELSE '' END AS bare FROM {_NAMES}")
def _(g: ClaimGraph) -> DataFrame:
    return names(g).select("s_suppkey", text.strip_suffix(F.col("name")).alias("bare"))


@query("fn_initials", f"SELECT s_suppkey, array_to_string(list_transform(string_split(trim(regexp_replace(replace(upper(name), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g')), ' '), lambda x: left(x, 1)), '') AS initials FROM {_NAMES}")
def _(g: ClaimGraph) -> DataFrame:
    return names(g).select("s_suppkey", text.initials(F.col("name")).alias("initials"))


@query("fn_prefix_match", "SELECT a.p_partkey, count(*) AS n FROM part a JOIN (SELECT DISTINCT p_name FROM part) b ON b.p_name LIKE split_part(a.p_name, ' ', 1) || ' %' WHERE length(split_part(a.p_name, ' ', 1)) >= 4 GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    """Names that begin with a word: an equi-join on first words."""
    first = F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first")
    known = g.table("part").select("p_name").distinct().filter(F.contains("p_name", F.lit(" "))).groupBy(first).agg(F.count(F.lit(1)).alias("n"))
    return g.table("part").select("p_partkey", first).filter(F.length("first") >= 4).join(known, "first").select("p_partkey", "n")


@query("fn_host", "SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host FROM pages")
def _(g: ClaimGraph) -> DataFrame:
    return g.table("pages").select("page_id", text.host_of(F.col("url")).alias("host"))


@query("fn_url_normalize", r"""SELECT page_id, base || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url FROM (SELECT page_id, rtrim(regexp_extract(url, '^([^?#]*)', 1), '/') AS base,
  array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|fbclid|gclid|mc_cid|mc_eid|ref|ref_src)=')), '&') AS q FROM pages)""")
def _(g: ClaimGraph) -> DataFrame:
    return g.table("pages").select("page_id", text.normalize_url(F.col("url")).alias("url"))


@query("fn_private_host", "SELECT event_id, (a IN (0, 10, 127) OR a >= 224 OR (a = 192 AND b = 168) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 198 AND b IN (18, 19))) AS private FROM (SELECT event_id, event_id % 256 AS a, user_id % 256 AS b FROM events)")
def _(g: ClaimGraph) -> DataFrame:
    """Addresses made of ids and users."""
    host = F.concat_ws(".", (F.col("event_id") % 256).cast("string"), (F.col("user_id") % 256).cast("string"), F.lit("7"), F.lit("9"))
    return g.table("events").select("event_id", text.is_private_host(host).alias("private"))


@query("fn_predicate_key", "SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' -- ' || p_name), '[^a-z0-9]+', '_', 'g'), '_') AS key FROM part")
def _(g: ClaimGraph) -> DataFrame:
    return g.table("part").select("p_partkey", text.predicate_key(F.concat("p_brand", F.lit(" -- "), "p_name")).alias("key"))


@query("fn_snippet", "SELECT doc_id, CASE WHEN pos > 0 THEN substr(text, greatest(1, pos - 50), least(pos - 1, 50) + 4 + 50) ELSE substr(text, 1, 100) END AS snippet FROM (SELECT doc_id, text, strpos(lower(text), 'tion') AS pos FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))")
def _(g: ClaimGraph) -> DataFrame:
    return g.table("documents").select("doc_id", text.snippet(F.coalesce("text", F.lit("")), F.lit("tion"), 50).alias("snippet"))


@query("fn_context_line", "SELECT event_id, coalesce(title, 'Untitled') || ' — ' || source_id || CASE WHEN published_at IS NOT NULL THEN ', ' || strftime(published_at, '%Y-%m-%d') ELSE '' END AS line FROM event")
def _(g: ClaimGraph) -> DataFrame:
    return g.event.select("event_id", text.context_line(F.col("title"), F.col("source_id"), F.date_format("published_at", "yyyy-MM-dd")).alias("line"))


@query("fn_date_of", "SELECT event_id, CASE event_id % 3 WHEN 2 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events")
def _(g: ClaimGraph) -> DataFrame:
    """Dates written as RFC 822, as ISO, and not at all."""
    third = F.col("event_id") % 3
    written = F.when(third == 0, F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(third == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    return g.table("events").select("event_id", text.date_of(written).alias("day"))


@query("fn_header", "SELECT doc_id, coalesce(source, '') AS source_of, 'a: ' || coalesce(lang, '') || ' goes on' AS title_of, length(trim(coalesce(text, ''), chr(10))) AS body_chars FROM documents")
def _(g: ClaimGraph) -> DataFrame:
    """Documents get a header block here, which is parsed again."""
    some = g.table("documents").select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("source", "lang", "text")])
    written = F.concat(F.lit("# source: old\n# title: a: "), "lang", F.lit(" \n\n  goes on\n# source: "), "source", F.lit("\n---\n"), "text")
    of = lambda key: F.try_element_at(text.header_of(written), F.lit(key)).alias(f"{key}_of")
    return some.select("doc_id", of("source"), of("title"), F.length(text.body_of(written)).cast("long").alias("body_chars"))


@query("fn_half_life_edge", "SELECT DISTINCT predicate, half_life_days FROM edge")
def _(g: ClaimGraph) -> DataFrame:
    from claimweave.operators.graph import with_canon

    linked = with_canon(g.asserted.filter("object_entity is not null"), g.predicate_map).select(F.col("predicate_canon").alias("predicate")).distinct()
    return linked.select("predicate", score.edge_half_life(F.col("predicate")).alias("half_life_days"))


@query("fn_half_life_claim", "SELECT DISTINCT predicate_raw, CASE predicate_raw WHEN 'owns' THEN NULL WHEN 'reported_revenue' THEN 365 ELSE 540 END AS days FROM claim")
def _(g: ClaimGraph) -> DataFrame:
    return g.claim.select("predicate_raw").distinct().select("predicate_raw", score.claim_half_life(F.col("predicate_raw")).alias("days"))


@query("fn_relative_difference", "SELECT p_partkey, round(abs(p_retailprice - p_size * 30) / nullif(greatest(abs(p_retailprice), abs(p_size * 30)), 0), 9) AS gap FROM part")
def _(g: ClaimGraph) -> DataFrame:
    return g.table("part").select("p_partkey", F.round(score.relative_difference(F.col("p_retailprice"), F.col("p_size") * F.lit(30.0)), 9).alias("gap"))


@query("fn_clamp01", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.5 ELSE least(1.0, greatest(0.0, round(value / 10, 6))) END::DOUBLE AS c FROM events")
def _(g: ClaimGraph) -> DataFrame:
    written = F.when(F.col("event_id") % 4 == 0, "high").otherwise(F.round(F.col("value") / 10, 6).cast("string"))
    return g.table("events").select("event_id", score.clamp01(written, 0.5).alias("c"))


@query("fn_uuid_parse", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21) END AS u FROM (SELECT doc_id, md5(coalesce(text, '')) AS m FROM documents)")
def _(g: ClaimGraph) -> DataFrame:
    m = F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    part = lambda a, n: F.substring(m, a, n)
    written = F.when(F.col("doc_id") % 2 == 0, F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))).otherwise(m)
    return g.table("documents").select("doc_id", F.when(written.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), written).alias("u"))


@query("fn_json_merge", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type AS kind FROM events")
def _(g: ClaimGraph) -> DataFrame:
    """A parsed map joined with another; the right one's keys win."""
    left = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: k != "kind")
    merged = F.map_concat(left, F.create_map(F.lit("kind"), F.col("event_type")))
    return g.table("events").select("event_id", F.try_element_at(merged, F.lit("k")).cast("int").alias("k"), F.try_element_at(merged, F.lit("kind")).alias("kind"))


@query("fn_document_text", "SELECT doc_id, left(text, 200000) AS body, length(text) AS chars, length(text) > 200000 AS truncated FROM documents")
def _(g: ClaimGraph) -> DataFrame:
    return g.table("documents").select("doc_id", F.left("text", F.lit(200_000)).alias("body"), F.length("text").cast("long").alias("chars"), (F.length("text") > 200_000).alias("truncated"))
