"""Health of runs that are still being recorded, kept as keyed streaming state.

Each scan partition of a micro-batch first sums its records into one row per run, so that a run with any
share of a batch reaches the state as a few rows. The state of a run is five values. It is dropped at
the run's end record, or once nothing has come for ``idle_ms``; ended runs keep none.

Idle time is told by event time, and the event time of a row is the start of its micro-batch. So no
row is ever late, whatever times its records hold, and a timer fires in the next batch after its time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tracemill.sources.commits import VersionedTable, path_exists

IDLE_MS = 15 * 60 * 1000
_PARTIAL = "run_id string, start_ns bigint, records bigint, last_ns bigint, lost bigint, ended boolean, bad boolean"
HEALTH = ("run_id string, records bigint, event_rate double, lost_events bigint, connected boolean,"
          " recording boolean, error string")
FIELDS = ("run_id", "records", "event_rate", "lost_events", "connected", "recording", "error")
STATE = "start_ns bigint, records bigint, last_ns bigint, lost bigint, error string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UNREADABLE = "a record breaks the contract"
SILENT = "no records arrived any more"


def partial_progress(records: DataFrame) -> DataFrame:
    """One row per run and scan partition of what a micro-batch holds.

    ``records`` are flat telemetry; a column ``bad`` may mark records that break the contract. Records
    without a run are left to the quarantine.
    """
    slim = records.filter("run_id IS NOT NULL").select(
        "run_id", F.coalesce("type", F.lit("")).alias("type"), "timestamp_ns", F.coalesce("lost_events", F.lit(0)).alias("lost"), "capture_start_ns",
        (F.coalesce("bad", F.lit(False)) if "bad" in records.columns else F.lit(False)).alias("bad"))
    marked = slim.select(
        "run_id", F.when(F.col("type") == "run_start", F.col("capture_start_ns")).alias("start_ns"),
        (F.col("type").isin("event", "heartbeat", "process_exit") & ~F.col("bad")).cast("bigint").alias("records"),
        F.when(~F.col("type").isin("run_start", "run_end") & ~F.col("bad"), F.col("timestamp_ns")).alias("last_ns"),
        "lost", ((F.col("type") == "run_end") & ~F.col("bad")).alias("ended"), "bad")

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            # Nullable integers keep 64-bit times exact beside missing ones.
            pdf = pdf.astype({"start_ns": "Int64", "last_ns": "Int64"})
            yield pdf.groupby("run_id", as_index=False, sort=False).agg(
                {"start_ns": "min", "records": "sum", "last_ns": "max", "lost": "sum", "ended": "max", "bad": "max"})

    return marked.mapInPandas(summed, _PARTIAL)


class OpenRun(StatefulProcessor):
    """Adds partial sums to a run's state and tells its health after every batch that brings news."""

    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        start, records, last, lost, error = self.progress.get() or (None, 0, None, 0, None)
        ended = False
        for r in rows:
            start = min((s for s in (start, r.start_ns) if s is not None), default=None)
            last = max((t for t in (last, r.last_ns) if t is not None), default=None)
            records, lost, ended = records + r.records, lost + r.lost, ended or r.ended
            error = error or (UNREADABLE if r.bad else None)
            arrived = r.arrived
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if ended:
            self.progress.clear()
            yield self._health(key, records, 0.0, lost, False, error)
            return
        self.progress.update((start, records, last, lost, error))
        self.handle.registerTimer(int(arrived.timestamp() * 1000) + self.idle_ms)
        rate = None if start is None else records * 1e9 / max(1, max(start, last or start) - start)
        yield self._health(key, records, rate, lost, True, error)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, records, _, lost, error = self.progress.get() or (None, 0, None, 0, None)
        self.progress.clear()
        yield self._health(key, records, 0.0, lost, False, error or SILENT)

    def _health(self, key, records, rate, lost, live, error) -> Row:
        return Row(run_id=key[0], records=records, event_rate=rate, lost_events=lost, connected=live,
                   recording=live, error=error)

    def close(self) -> None:
        pass


def open_run_health(records: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """A stream of health rows: one per run and micro-batch that brings news of it.

    While a run is open its rate is records per second since its start, null until its start record came.
    """
    news = partial_progress(records).withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "0 seconds")
    return news.groupBy("run_id").transformWithState(OpenRun(idle_ms), HEALTH, "Update", "EventTime")


@dataclass(frozen=True)
class OpenRuns:
    """Keeps a log of health rows below ``root``, a folder per micro-batch; a repeated batch replaces its own."""

    root: str
    idle_ms: int = IDLE_MS

    @property
    def _current(self) -> VersionedTable:
        return VersionedTable(f"{self.root}/current", ("run_id",))

    def _log(self, rows: DataFrame, batch_id: int) -> None:
        rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{self.root}/health")
        # Read back, because evaluating a stateful batch twice would count it twice.
        spark = rows.sparkSession
        if path_exists(spark, f"{self.root}/health/batch_id={batch_id}"):
            self._current.append(spark.read.schema(HEALTH).parquet(f"{self.root}/health/batch_id={batch_id}"), batch_id)

    def start(self, records: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        spark = records.sparkSession
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        # A batch without news would only move the time on; the next one with news does so, too.
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
        writer = open_run_health(records, self.idle_ms).writeStream.outputMode("update").foreachBatch(
            lambda batch, number: self._log(batch, number)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def log(self, spark: SparkSession) -> DataFrame:
        """Every logged health row with its batch."""
        return spark.read.schema(f"{HEALTH}, batch_id bigint").parquet(f"{self.root}/health")

    def current(self, spark: SparkSession) -> DataFrame:
        """The last health of every run, from a table of few files however many batches there were."""
        return self._current.read(spark)


def state_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The runs a checkpoint holds state of."""
    return spark.read.format("statestore").option("stateVarName", "progress").load(checkpoint)
