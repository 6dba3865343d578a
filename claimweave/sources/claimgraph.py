"""The claim graph as projections of the relational tables.

Each view is a plan over the Parquet scans; nothing is materialised, so
filters and column pruning reach the files. Timestamps are UTC without zone.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.session import importable_by_workers


def text(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


class ClaimGraph:
    """Views of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = importable_by_workers(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def claim(self) -> DataFrame:
        lines, orders, parts = self.table("lineitem"), self.table("orders"), self.table("part")
        kind = F.col("p_type")
        predicate = (
            F.when(kind == "PROMO", "supplies").when(kind == "LARGE", "Sources_From").when(kind == "ECONOMY", "partner_of")
            .when(kind == "SMALL", "reported_revenue").when(kind == "MEDIUM", "appointed_ceo").otherwise("owns")
        )
        literal = kind == "SMALL"
        return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
            F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("claim_id"),
            text("S", "l_suppkey").alias("subject_entity"), text("Supplier ", "l_suppkey").alias("subject_surface"),
            predicate.alias("predicate_raw"),
            F.when(~kind.isin("SMALL", "MEDIUM"), text("P", "l_partkey")).alias("object_entity"),
            F.when(~literal, F.col("p_name")).alias("object_surface"),
            F.when(literal, F.col("l_extendedprice")).alias("literal_value"),
            F.when(literal, F.col("l_returnflag")).alias("literal_currency"),
            F.when(literal, F.date_format("o_orderdate", "yyyy-MM")).alias("literal_as_of"), F.when(literal, F.col("l_linestatus")).alias("literal_unit"),
            text("E", "o_orderkey").alias("event_id"), F.concat(F.lit("L"), (F.col("o_custkey") % 97).cast("string")).alias("lineage_id"),
            F.col("o_orderpriority").alias("source_id"), F.col("o_orderdate").alias("observed_at"), F.col("o_orderdate").alias("valid_from"),
            F.when(F.col("l_shipdate") > F.col("o_orderdate"), F.col("l_shipdate")).alias("valid_to"),
            F.round(1 - F.col("l_discount") - F.col("l_tax") + F.lit(0.0), 4).alias("confidence"),
            F.when(F.col("o_orderstatus") == "P", "superseded").otherwise("asserted").alias("status"),
        )

    @cached_property
    def asserted(self) -> DataFrame:
        """The firewall: every discovery read goes through asserted claims."""
        return self.claim.filter("status = 'asserted'")

    @cached_property
    def event(self) -> DataFrame:
        key, priority, state = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
        return self.table("orders").select(
            text("E", "o_orderkey").alias("event_id"), priority.alias("source_id"),
            F.when(priority == "1-URGENT", "edgar").when(priority == "2-HIGH", "rss").when(priority == "3-MEDIUM", "podcast").when(priority == "4-NOT SPECIFIED", "x").otherwise("manual").alias("connector"),
            F.col("o_orderdate").alias("fetched_at"),
            F.when(key % 3 == 0, F.col("o_orderdate") - F.expr("interval 2 days")).alias("published_at"),
            F.when(state == "F", "extracted").when(state == "O", "pending").otherwise("failed").alias("status"),
            (key % 4).cast("int").alias("attempts"),
            F.concat(F.lit("L"), (F.col("o_custkey") % 97).cast("string")).alias("lineage_id"),
            F.when(key % 2 == 0, "8-K").otherwise("10-K").alias("form"),
            F.when(key % 5 == 0, "2.01,9.01").when(key % 5 == 1, "5.02").when(key % 5 == 2, "8.01").alias("items"),
            F.when(key % 7 == 0, F.concat(F.lit("Acquisition of plant "), key.cast("string"))).when(key % 7 == 1, "Board resigns").when(key % 7 < 6, F.concat(F.lit("Daily note "), (key % 100).cast("string"))).alias("title"),
            F.concat(F.lit("T"), (F.col("o_custkey") % 100).cast("string")).alias("ticker"),
            F.col("o_totalprice").alias("cost"),
        )

    @cached_property
    def entity(self) -> DataFrame:
        suppliers = self.table("supplier").select(text("S", "s_suppkey").alias("entity_id"), F.lit("company").alias("kind"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, text("T", "s_suppkey")).alias("ticker"))
        customers = self.table("customer").select(text("C", "c_custkey").alias("entity_id"), F.lit("company").alias("kind"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("ticker"))
        parts = self.table("part").select(text("P", "p_partkey").alias("entity_id"), F.lit("product").alias("kind"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("ticker"))
        return suppliers.unionByName(customers).unionByName(parts)

    @cached_property
    def same_as(self) -> DataFrame:
        """Active merges, one hop: every tenth supplier into the first of its ten."""
        return self.table("supplier").filter("s_suppkey % 10 = 9").select(text("S", "s_suppkey").alias("a"), F.concat(F.lit("S"), (F.col("s_suppkey") - 9).cast("string")).alias("b"))

    @cached_property
    def predicate_map(self) -> DataFrame:
        """Two versions of the mapping; the later one counts. Its rows come from the kinds of part that there are."""
        raw = self.table("part").select("p_type").distinct()
        first = raw.filter("p_type = 'PROMO'").select(F.lit(1).alias("version"), F.lit("supplies").alias("predicate_raw"), F.lit("provides").alias("predicate_canon"))
        second = raw.filter("p_type in ('PROMO', 'LARGE', 'ECONOMY')").select(
            F.lit(2).alias("version"),
            F.when(F.col("p_type") == "PROMO", "supplies").when(F.col("p_type") == "LARGE", "sources_from").otherwise("partner_of").alias("predicate_raw"),
            F.when(F.col("p_type") == "ECONOMY", "partners_with").otherwise("supplies").alias("predicate_canon"),
        )
        return first.unionByName(second)

    @cached_property
    def watchlist(self) -> DataFrame:
        return self.table("supplier").filter("s_suppkey % 7 = 0").select(text("T", "s_suppkey").alias("ticker"), (F.col("s_suppkey") % 14 != 0).alias("active"), F.concat(F.lit("sector "), (F.col("s_nationkey") % 3).cast("string")).alias("sector"))

    @cached_property
    def source(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderpriority").alias("source_id")).distinct().select("source_id", F.when(F.col("source_id").startswith("1"), 0.9).when(F.col("source_id").startswith("2"), 0.6).when(F.col("source_id").startswith("3"), 0.3).when(F.col("source_id").startswith("4"), 0.35).alias("reliability"), F.when(F.col("source_id").startswith("5"), "demoted").otherwise("active").alias("status"))

    @cached_property
    def mention(self) -> DataFrame:
        """One row for each surface of an event, with what it resolved to."""
        key = F.col("l_suppkey")
        return self.table("lineitem").select("l_orderkey", "l_suppkey").distinct().select(
            text("E", "l_orderkey").alias("event_id"), text("Supplier ", "l_suppkey").alias("surface"),
            F.when(key % 5 != 0, text("S", "l_suppkey")).alias("resolved_entity"),
            F.when(key % 5 == 0, "skipped-v0").when(key % 5 == 1, "alias:exact").when(key % 5 == 2, "ticker:guarded").otherwise("name_exact:sec").alias("resolver"),
        )


#: The same views as SQL, for the checks.
VIEWS = """
claim AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS claim_id,
    'S' || l_suppkey AS subject_entity, 'Supplier ' || l_suppkey AS subject_surface,
    CASE p_type WHEN 'PROMO' THEN 'supplies' WHEN 'LARGE' THEN 'Sources_From' WHEN 'ECONOMY' THEN 'partner_of'
      WHEN 'SMALL' THEN 'reported_revenue' WHEN 'MEDIUM' THEN 'appointed_ceo' ELSE 'owns' END AS predicate_raw,
    CASE WHEN p_type NOT IN ('SMALL', 'MEDIUM') THEN 'P' || l_partkey END AS object_entity,
    CASE WHEN p_type <> 'SMALL' THEN p_name END AS object_surface,
    CASE WHEN p_type = 'SMALL' THEN l_extendedprice END AS literal_value,
    CASE WHEN p_type = 'SMALL' THEN l_returnflag END AS literal_currency,
    CASE WHEN p_type = 'SMALL' THEN strftime(o_orderdate, '%Y-%m') END AS literal_as_of, CASE WHEN p_type = 'SMALL' THEN l_linestatus END AS literal_unit,
    'E' || o_orderkey AS event_id, 'L' || (o_custkey % 97) AS lineage_id, o_orderpriority AS source_id,
    o_orderdate AS observed_at, o_orderdate AS valid_from, CASE WHEN l_shipdate > o_orderdate THEN l_shipdate END AS valid_to,
    round(1 - l_discount - l_tax + 0.0, 4) AS confidence, CASE o_orderstatus WHEN 'P' THEN 'superseded' ELSE 'asserted' END AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
),
asserted AS (SELECT * FROM claim WHERE status = 'asserted'),
event AS (
  SELECT 'E' || o_orderkey AS event_id, o_orderpriority AS source_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'edgar' WHEN '2-HIGH' THEN 'rss' WHEN '3-MEDIUM' THEN 'podcast' WHEN '4-NOT SPECIFIED' THEN 'x' ELSE 'manual' END AS connector,
    o_orderdate AS fetched_at, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate - INTERVAL 2 DAY END AS published_at,
    CASE o_orderstatus WHEN 'F' THEN 'extracted' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
    CAST(o_orderkey % 4 AS INT) AS attempts, 'L' || (o_custkey % 97) AS lineage_id,
    CASE WHEN o_orderkey % 2 = 0 THEN '8-K' ELSE '10-K' END AS form,
    CASE o_orderkey % 5 WHEN 0 THEN '2.01,9.01' WHEN 1 THEN '5.02' WHEN 2 THEN '8.01' END AS items,
    CASE WHEN o_orderkey % 7 = 0 THEN 'Acquisition of plant ' || o_orderkey WHEN o_orderkey % 7 = 1 THEN 'Board resigns'
      WHEN o_orderkey % 7 < 6 THEN 'Daily note ' || (o_orderkey % 100) END AS title,
    'T' || (o_custkey % 100) AS ticker, o_totalprice AS cost
  FROM orders
),
entity AS (
  SELECT 'S' || s_suppkey AS entity_id, 'company' AS kind, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'T' || s_suppkey END AS ticker FROM supplier
  UNION ALL SELECT 'C' || c_custkey, 'company', c_name, NULL FROM customer
  UNION ALL SELECT 'P' || p_partkey, 'product', p_name, NULL FROM part
),
same_as AS (SELECT 'S' || s_suppkey AS a, 'S' || (s_suppkey - 9) AS b FROM supplier WHERE s_suppkey % 10 = 9),
predicate_map(version, predicate_raw, predicate_canon) AS (
  VALUES (1, 'supplies', 'provides'), (2, 'supplies', 'supplies'), (2, 'sources_from', 'supplies'), (2, 'partner_of', 'partners_with')
),
watchlist AS (SELECT 'T' || s_suppkey AS ticker, s_suppkey % 14 <> 0 AS active, 'sector ' || (s_nationkey % 3) AS sector FROM supplier WHERE s_suppkey % 7 = 0),
source AS (
  SELECT DISTINCT o_orderpriority AS source_id, CASE left(o_orderpriority, 1) WHEN '1' THEN 0.9 WHEN '2' THEN 0.6 WHEN '3' THEN 0.3 WHEN '4' THEN 0.35 END::DOUBLE AS reliability,
    CASE left(o_orderpriority, 1) WHEN '5' THEN 'demoted' ELSE 'active' END AS status FROM orders
),
mention AS (
  SELECT DISTINCT 'E' || l_orderkey AS event_id, 'Supplier ' || l_suppkey AS surface,
    CASE WHEN l_suppkey % 5 <> 0 THEN 'S' || l_suppkey END AS resolved_entity,
    CASE l_suppkey % 5 WHEN 0 THEN 'skipped-v0' WHEN 1 THEN 'alias:exact' WHEN 2 THEN 'ticker:guarded' ELSE 'name_exact:sec' END AS resolver
  FROM lineitem
),
pmap AS (SELECT predicate_raw AS raw, predicate_canon AS canon FROM predicate_map WHERE version = (SELECT max(version) FROM predicate_map)),
canon_claim AS (
  SELECT c.*, coalesce(p.canon, lower(c.predicate_raw)) AS predicate_canon,
    coalesce(ms.b, c.subject_entity) AS src, coalesce(mo.b, c.object_entity) AS dst
  FROM claim c LEFT JOIN pmap p ON p.raw = lower(c.predicate_raw)
  LEFT JOIN same_as ms ON ms.a = c.subject_entity LEFT JOIN same_as mo ON mo.a = c.object_entity
),
edge AS (
  SELECT src, dst, predicate_canon AS predicate, list_sort(list(claim_id)) AS claim_ids, min(valid_from) AS valid_from,
    CASE WHEN bool_or(valid_to IS NULL) THEN NULL ELSE max(valid_to) END AS valid_to, max(confidence) AS confidence, max(observed_at) AS last_evidence_at,
    CASE WHEN predicate_canon LIKE '%own%' OR predicate_canon LIKE '%ceo%' OR predicate_canon LIKE '%appointed%' THEN NULL
      WHEN predicate_canon LIKE '%partner%' THEN 180 WHEN predicate_canon LIKE '%suppl%' OR predicate_canon LIKE '%sources%' THEN 540 ELSE 365 END AS half_life_days
  FROM canon_claim WHERE status = 'asserted' AND dst IS NOT NULL GROUP BY 1, 2, 3
)"""
