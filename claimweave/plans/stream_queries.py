"""Streams drained over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.operators import ingest
from claimweave.plans.graph_queries import _DEP, hypotheses
from claimweave.plans.ingest_queries import LINEAGES, sketched
from claimweave.plans.registry import query
from claimweave.sources.claimgraph import ClaimGraph
from claimweave.streaming import stateful, streams


@query("stream_window_counts", "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(g: ClaimGraph) -> DataFrame:
    out = streams.drain(streams.window_counts(streams.table_stream(g.spark, g.sf_dir, "events")), g.spark, "complete")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_sliding_counts", "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT unnest([b, b - INTERVAL 6 HOUR]) AS s FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS b FROM events)) GROUP BY 1")
def _(g: ClaimGraph) -> DataFrame:
    out = streams.drain(streams.sliding_counts(streams.table_stream(g.spark, g.sf_dir, "events")), g.spark, "complete")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_sessions", "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, k")
def _(g: ClaimGraph) -> DataFrame:
    out = streams.drain(streams.sessions(streams.table_stream(g.spark, g.sf_dir, "events")), g.spark, "complete")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_first_seen", "SELECT DISTINCT sha256(coalesce(text, '')) AS hash FROM documents")
def _(g: ClaimGraph) -> DataFrame:
    return streams.drain(streams.first_seen(streams.table_stream(g.spark, g.sf_dir, "documents")), g.spark, "append")


@query("stream_triage", "SELECT event_id, CASE WHEN event_type = 'error' THEN 0.7 ELSE 0.3 END::DOUBLE AS materiality, event_type = 'error' AND 'T' || user_id IN (SELECT ticker FROM watchlist WHERE active) AS alert FROM events")
def _(g: ClaimGraph) -> DataFrame:
    """Events of a stream with titles by type, against the static watchlist."""
    arriving = streams.table_stream(g.spark, g.sf_dir, "events").select("event_id", F.lit("rss").alias("connector"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("string").alias("items"), F.when(F.col("event_type") == "error", "Plant investigation").otherwise("Note").alias("title"), F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("ticker"))
    return streams.drain(streams.triage(arriving, g.watchlist), g.spark, "append")


class Arriving(ClaimGraph):
    """The claim graph over order lines that arrive as a stream; the other tables are at rest."""

    def table(self, name: str) -> DataFrame:
        return streams.table_stream(self.spark, self.sf_dir, name) if name == "lineitem" else super().table(name)


@query("stream_near_dup", LINEAGES)
def _(g: ClaimGraph) -> DataFrame:
    """The lineages of ``near_dup_lineage``, as arrivals come in; the sketches are numbered by arrival first, as a log would."""
    numbered, root = ingest.arrival_ranks(sketched(g).filter("simhash != 0")), streams.fresh_folder(g.spark)
    numbered.write.parquet(f"{root}/in")
    arrivals = g.spark.readStream.schema(numbered.schema).parquet(f"{root}/in")
    out = stateful.near_copies(arrivals, root)
    return out.select(F.col("event_id").cast("long").alias("event_id"), F.col("lineage_id").cast("long").alias("lineage_id"))


@query("stream_wake", _DEP + """, last AS (SELECT e, max(t) AS t FROM (SELECT subject_entity AS e, observed_at AS t FROM asserted UNION ALL SELECT object_entity, observed_at FROM asserted) GROUP BY 1)
SELECT DISTINCT hypothesis_id FROM hypothesis h JOIN last ON e IN (a, b, via) WHERE t > TIMESTAMP '2001-07-15 00:00:00'""")
def _(g: ClaimGraph) -> DataFrame:
    """Claims arrive with their order lines and wake parked hypotheses, each once."""
    parked = hypotheses(g).select("hypothesis_id", F.lit("2001-07-15 00:00:00").cast("timestamp_ntz").alias("parked_at"), F.array("a", "b", "via").alias("entities"))
    return stateful.wake(Arriving(g.spark, g.sf_dir).claim, parked, streams.fresh_folder(g.spark))


@query("stream_first_day", "SELECT DISTINCT user_id, event_type FROM events")
def _(g: ClaimGraph) -> DataFrame:
    """First sightings of a user's kinds of event; the state is dropped behind the watermark."""
    rows = streams.table_stream(g.spark, g.sf_dir, "events").withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    return streams.drain(stateful.first_seen(rows, "key", "ts", keep="400 days").select("user_id", "event_type"), g.spark, "append")


@query("stream_leases")
def _(g: ClaimGraph) -> DataFrame:
    """Every user of ``events`` as a job whose actions their events are; tests compare with a plain run."""
    kinds = F.array(*map(F.lit, ("enqueue", "lease", "fail", "lease", "complete")))
    actions = streams.table_stream(g.spark, g.sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), F.get(kinds, (F.col("event_id") % 5).cast("int")).alias("kind"), F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string")).alias("worker"))
    return stateful.leases(actions, streams.fresh_folder(g.spark))
