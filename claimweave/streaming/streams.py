"""Structured Streaming counterparts of the polling loops.

Each function takes a streaming frame and returns one; ``drain`` runs it
over all that is available and leaves the result as Parquet in the
warehouse. Windows and sessions are dropped behind the watermark; ``first_seen``
keeps a hash for each distinct text (``stateful.first_seen`` forgets).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import score


def table_stream(spark: SparkSession, sf_dir: str, name: str, files: int = 8) -> DataFrame:
    """New files of a table's folder, or the one file that it is."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{name}.parquet*")


def window_counts(events: DataFrame, width: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Events and their mean value by tumbling window and type."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding_counts(events: DataFrame, width: str = "12 hours", step: str = "6 hours", late: str = "1 day") -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user: events less than ``gap`` apart."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(documents: DataFrame) -> DataFrame:
    """Exact duplicates of earlier documents go; the state holds a hash for each distinct text."""
    return documents.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["hash"]).select("hash")


def triage(events: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Scores arriving events; a static watchlist marks alerts."""
    scored = events.withColumn("materiality", score.materiality(F.col("connector"), F.col("form"), F.col("items"), F.col("title")))
    fast = F.col("materiality") >= score.FAST_FROM
    watched = watchlist.filter("active").select("ticker").distinct().withColumn("_w", F.lit(True))
    return scored.join(watched, "ticker", "left").select("event_id", "materiality", (fast & F.coalesce("_w", F.lit(False))).alias("alert"))


def fresh_folder(spark: SparkSession) -> str:
    """A new folder below the warehouse, which all executors share, for a stream's state and output."""
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_streams/{uuid.uuid4().hex}"


def drain(frame: DataFrame, spark: SparkSession, mode: str, each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what is there and return what it left.

    Batches are written idempotently: each to its own folder, named by its
    number, or as a whole in complete mode.
    """
    root = fresh_folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        rows = each(batch) if each else batch
        rows.write.mode("overwrite").parquet(f"{root}/out/{'batch=0' if mode == 'complete' else f'batch={number}'}")

    running = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(put).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{root}/out").drop("batch")
