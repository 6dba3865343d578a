"""Streams with state of their own: near copies, leases, first sightings and waking hypotheses.

State ends behind the watermark, by timers. What a batch leaves is written
to a folder named by its number, and only folders of earlier numbers are
read, so a batch that runs again after a failure leaves the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from claimweave.operators import discovery, ingest
from claimweave.session import cut, importable_by_workers

#: Minutes of a lease and of the pause after a failure, attempts of a job, and days that a finished job is kept.
LEASE_MINUTES, RETRY_MINUTES, ATTEMPTS, KEPT_DAYS = 30, 15, 3, 7
#: A stretch of arrivals is so many times those that count.
STRETCH = 4
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(frame: DataFrame, root: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Run ``frame`` over what is there, with its state in ``root``; ``each`` gets the batches."""
    spark = importable_by_workers(frame.sparkSession)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        running = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(each).trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return running


def left(spark: SparkSession, root: str, schema: str, before: int | None = None) -> DataFrame:
    """What batches have left in ``root``, those numbered below ``before`` alone if it is given."""
    out = spark.read.schema(f"{schema}, batch long").option("ignoreMissingFiles", "true").option("basePath", f"{root}/out")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/out")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    rows = out.parquet(f"{root}/out")
    return (rows if before is None else rows.filter(F.col("batch") < before)).drop("batch")


def _leave(rows: DataFrame, root: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{root}/out/batch={number}")


# --- Near copies among the last arrivals --------------------------------------------------------


class _Stretch(StatefulProcessor):
    """The last arrivals of a stretch of ``length`` positions and those just before it: a ring, from which arrivals too old to count are dropped."""

    def __init__(self, bits: int, recent: int, length: int):
        self.bits, self.recent, self.length = bits, recent, length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "position long, event_id string, simhash long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = list(self.ring.get())
        new = pd.concat(list(rows)).sort_values("position")
        positions = np.array([r[0] for r in held] + new["position"].tolist(), np.int64)
        sketches = np.array([r[2] for r in held] + new["simhash"].tolist(), np.int64).view(np.uint64)
        names = [r[1] for r in held] + new["event_id"].tolist()
        found, begin = [], key[0] * self.length
        for at in range(max(len(held), int(np.searchsorted(positions, begin))), len(names)):
            first = int(np.searchsorted(positions, positions[at] - self.recent))
            close = np.flatnonzero(np.bitwise_count(sketches[first:at] ^ sketches[at]) <= self.bits)
            if len(close):
                near = first + int(close[-1])
                found.append((names[at], int(positions[at]), int(positions[near]), names[near]))
            else:
                found.append((names[at], int(positions[at]), None, None))
        ended = int(positions[-1]) == begin + self.length - 1  # then no more comes
        self._keep([] if ended else list(zip(positions.tolist(), names, sketches.view(np.int64).tolist(), strict=True)), int(positions[-1]))
        yield pd.DataFrame(found, columns=["event_id", "position", "near_position", "near_id"]).astype({"near_position": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self._keep(list(self.ring.get()), timerValues.getCurrentWatermarkInMs() // 1000)
        yield pd.DataFrame(columns=["event_id", "position", "near_position", "near_id"])

    def _keep(self, rows: list[tuple], now: int) -> None:
        """Event time is a second a position, one ahead, as the first must be after the epoch; a timer drops the ring when all of it is too far behind."""
        rows = [tuple(r) for r in rows if r[0] >= now - self.recent]
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if rows:
            self.ring.put(rows)
            self.handle.registerTimer((rows[-1][0] + self.recent + 1) * 1000)
        else:
            self.ring.clear()


LINEAGE = "event_id string, near_id string, lineage_id string"


def near_copies(arrivals: DataFrame, root: str, bits: int = ingest.BITS, recent: int = ingest.RECENT) -> DataFrame:
    """(event_id, near_id, lineage_id) of arrivals (event_id, position, simhash): the latest near one of the last ``recent``, and where its chain began.

    ``position`` numbers the arrivals that have a sketch without gaps, as an
    ordered log does. They are cut into stretches, and the last ``recent`` of
    a stretch are dealt to the next one too, so every arrival meets all that
    count for it in the ring of its own stretch, however alike sketches are.
    The rings of a stretch and the next hold at most about twice ``recent``.
    """
    length = STRETCH * recent
    rows = arrivals.filter("simhash != 0").withColumn("at", F.timestamp_seconds(F.col("position") + 1)).withWatermark("at", "0 seconds")
    stretches = F.array_distinct(F.array(F.expr(f"position div {length}"), F.expr(f"(position + {recent}) div {length}")))
    dealt = rows.select("at", F.col("event_id").cast("string").alias("event_id"), "position", "simhash", F.explode(stretches).alias("stretch"))
    matched = dealt.groupBy("stretch").transformWithStateInPandas(_Stretch(bits, recent, length), "event_id string, position long, near_position long, near_id string", "append", "eventtime")

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # Written once: both uses below would run the rings.
        best = cut(batch.groupBy("event_id").agg(F.max(F.struct("near_position", "near_id"))["near_id"].alias("near_id")))
        chains = ingest.lineages(best).withColumnRenamed("lineage_id", "_end")
        known = left(spark, root, LINEAGE, number).select(F.col("event_id").alias("_end"), F.col("lineage_id").alias("_known"))
        _leave(best.join(chains, "event_id").join(known, "_end", "left").select("event_id", "near_id", F.coalesce("_known", "_end").alias("lineage_id")), root, number)

    start(matched, root, each)
    return left(arrivals.sparkSession, root, LINEAGE)


# --- Jobs under lease -----------------------------------------------------------------------------


class _Job(StatefulProcessor):
    """One job: pending, leased until a time, done, or an error after too many attempts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempts int, worker string, until long")

    def _set(self, out: list, now: int, status: str, attempts: int, worker: str | None, until: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.job.update((status, attempts, worker, until))
        if status in ("leased", "done", "error"):
            self.handle.registerTimer(until)
        out.append((now, status, attempts, worker))

    def _expire(self, out: list, until: int, attempts: int) -> None:
        self._set(out, until, "error" if attempts >= ATTEMPTS else "pending", attempts, None, until + (KEPT_DAYS * 86_400_000 if attempts >= ATTEMPTS else 0))

    def _step(self, out: list, now: int, kind: str, worker: str | None) -> None:
        held = self.job.get() if self.job.exists() else None
        if held is None:
            if kind == "enqueue":
                self._set(out, now, "pending", 0, None, now)
            return
        status, attempts, owner, until = held
        if status == "leased" and until < now:
            self._expire(out, until, attempts)
            status, attempts, owner, until = self.job.get()
        kept = now + KEPT_DAYS * 86_400_000
        if kind == "lease" and status == "pending" and until <= now:
            self._set(out, now, "leased", attempts + 1, worker, now + LEASE_MINUTES * 60_000)
        elif kind == "complete" and status != "done":
            self._set(out, now, "done", attempts, None, kept)
        elif kind == "fail" and status == "leased" and worker == owner:
            ended = attempts >= ATTEMPTS
            self._set(out, now, "error" if ended else "pending", attempts, None, kept if ended else now + RETRY_MINUTES * 60_000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        order = {"enqueue": 0, "complete": 1, "fail": 2, "lease": 3}
        out: list = []
        every = [(int(r.at.value // 1_000_000), order.get(r.kind, 9), r.kind, r.worker) for part in rows for r in part.itertuples()]
        for now, _, kind, worker in sorted(every, key=lambda r: (r[0], r[1], r[3] or "")):
            self._step(out, now, kind, worker)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        out: list = []
        if self.job.exists():
            status, attempts, _, until = self.job.get()
            if until <= expiredTimerInfo.getExpiryTimeInMs():
                if status == "leased":
                    self._expire(out, until, attempts)
                elif status in ("done", "error"):
                    self.job.clear()
                    out.append((until, "pruned", attempts, None))
        yield self._rows(key, out)

    def _rows(self, key: tuple, out: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in out], columns=["job_id", "at_ms", "status", "attempts", "worker"])


JOBS = "job_id string, at_ms long, status string, attempts int, worker string"


def leases(actions: DataFrame, root: str, late: str = "0 seconds") -> DataFrame:
    """Every change (job_id, at_ms, status, attempts, worker) that actions (job_id, at, kind, worker) and the passing of time make.

    ``enqueue`` of a known job does nothing. A ``lease`` counts an attempt. A
    lease that runs out returns the job to the queue, or ends it after the
    last attempt; so does ``fail`` by its worker, after a pause. ``complete``
    is taken at any time. A finished job is forgotten after some days.
    """
    timed = actions.select(F.col("job_id").cast("string").alias("job_id"), F.col("at").cast("timestamp").alias("at"), "kind", "worker").withWatermark("at", late)
    changes = timed.groupBy("job_id").transformWithStateInPandas(_Job(), JOBS, "append", "eventtime")
    start(changes, root, lambda batch, number: _leave(batch, root, number))
    return left(actions.sparkSession, root, JOBS)


# --- First sightings, and hypotheses that wake ----------------------------------------------------


def first_seen(rows: DataFrame, key: str, at: str, keep: str = "7 days") -> DataFrame:
    """The first row of each key; a key is forgotten ``keep`` after it was seen, so state follows the watermark."""
    return rows.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", keep).dropDuplicatesWithinWatermark([key]).drop("_at")


WOKEN = "hypothesis_id string"


def wake(claims: DataFrame, parked: DataFrame, root: str) -> DataFrame:
    """(hypothesis_id) of parked ones (hypothesis_id, parked_at, entities) that an arriving claim on their entities wakes, each once."""

    def each(batch: DataFrame, number: int) -> None:
        woken = discovery.wake(parked, batch.filter("status = 'asserted'"))
        _leave(woken.join(left(batch.sparkSession, root, WOKEN, number), "hypothesis_id", "left_anti"), root, number)

    start(claims, root, each)
    return left(claims.sparkSession, root, WOKEN)
