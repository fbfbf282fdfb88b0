"""Feature windows from a stream of telemetry, with replacements for late events and losses.

Each micro-batch is handled with the same operators as a whole recording. State lives in tables
below one folder: watermarked events, exits and losses, run bounds, and the log of window versions.
The first is partitioned by run and time slot, and a batch reads the slots it can change. A run may hold
any share of a batch, because no step gathers a run in one task. Everything a batch writes carries
its batch id and is replaced as a whole, so a repeated batch changes nothing.

The watermark has no delay, moves with every record and belongs to one run. Late events are never
dropped, which rules out the built-in event-time watermark.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tracemill.functions.ordered import BUCKET_ROWS, ranks
from tracemill.operators import windows as ops
from tracemill.schemas import SECOND_NS, TELEMETRY, WINDOW_KEY, WINDOW_NS
from tracemill.session import written
from tracemill.sources.commits import VersionedTable, delete, path_exists

_OPEN_END = 2**62
_TIMES = ("capture_start_ns", "capture_end_ns", "watermark_ns")
_RUNS = ("run_id string, capture_start_ns bigint, capture_end_ns bigint, watermark_ns bigint, news boolean,"
         " ended_in bigint, batch_id bigint")
_MARKED = T.StructType([*TELEMETRY.fields, *[
    T.StructField(name, T.LongType()) for name in ("watermark_ns", "slot", "batch_id")]])


@dataclass(frozen=True)
class WindowStream:
    """Micro-batch window maintenance below ``root``.

    Records are flat telemetry with run start and end records. ``pos`` must grow with arrival
    inside a run, over batches too; ``collector_sequence`` is such a position in a valid stream.
    ``slot_windows`` is the number of windows per partition of the stored telemetry.

    What grows with the number of batches is kept in versioned tables whose small folders are merged by
    key. ``keep_ended`` batches after a run's end its telemetry is deleted; records that come later are put
    aside and change nothing. ``keep_changes`` batches of the log of window versions stay. None keeps all.
    """

    root: str
    window_ns: int = WINDOW_NS
    bucket_ns: int = SECOND_NS
    bucket_rows: int = BUCKET_ROWS
    slot_windows: int = 360
    keep_ended: int | None = None
    keep_changes: int | None = None

    # The last two batches are never merged: a repeated batch must find what was there before it.
    @property
    def _runs_table(self) -> VersionedTable:
        return VersionedTable(f"{self.root}/runs", ("run_id",), unmerged=2)

    @property
    def _held_table(self) -> VersionedTable:
        return VersionedTable(f"{self.root}/held", unmerged=2)

    @property
    def _windows_table(self) -> VersionedTable:
        return VersionedTable(f"{self.root}/windows", ("window_id",))

    def _read(self, spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
        path = f"{self.root}/{name}"
        if path_exists(spark, path):
            return spark.read.schema(schema).parquet(path)
        return spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, *partitions: str) -> None:
        df.hint("rebalance", partitions[0]).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(f"{self.root}/{name}")

    def runs(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """Bounds and watermark of every run seen so far, or before a batch."""
        stored = self._runs_table.read(spark) if before is None else self._runs_table.before(spark, before)
        return spark.createDataFrame([], _RUNS) if stored is None else stored

    def apply(self, records: DataFrame, batch_id: int) -> None:
        """Take one micro-batch into the state and log new window versions."""
        spark = records.sparkSession
        earlier = self.runs(spark, before=batch_id)
        records = self._of_open_runs(records, earlier, batch_id)
        starts = records.filter("type = 'run_start'").select("run_id", "capture_start_ns")
        begun = earlier.filter("capture_start_ns IS NOT NULL").select("run_id", "capture_start_ns")
        bounds = begun.unionByName(starts).groupBy("run_id").agg(
            F.max("capture_start_ns").alias("capture_start_ns"))
        records = self._with_held(records, starts.join(begun, "run_id", "left_anti"), bounds, batch_id)
        marked = ops.running_watermark(ops.with_run_bounds(records, bounds), self.bucket_rows)
        carried = marked.join(
            earlier.select("run_id", F.col("watermark_ns").alias("_carried")), "run_id", "left"
        ).withColumn("watermark_ns", F.greatest("watermark_ns", "_carried"))
        carried = written(carried, "carried")
        self._write(
            self._stored_rows(carried).withColumn("batch_id", F.lit(batch_id)).select(*_MARKED.names),
            "marked", "run_id", "slot", "batch_id")
        seen = (
            starts.select("run_id", "capture_start_ns", F.lit(True).alias("news"))
            .unionByName(records.filter("type = 'run_end'").select(
                "run_id", F.col("timestamp_ns").alias("capture_end_ns"), F.lit(True).alias("news")), allowMissingColumns=True)
            .unionByName(carried.select("run_id", "watermark_ns"), allowMissingColumns=True)
            .groupBy("run_id").agg(*[F.max(c).alias(c) for c in _TIMES], F.coalesce(F.max("news"), F.lit(False)).alias("news")))
        before = earlier.select("run_id", *[F.col(c).alias(f"_{c}") for c in (*_TIMES, "ended_in")])
        # Rows hold all that is known of a run, so that the newest one is enough.
        known = seen.join(before, "run_id", "left").select(
            "run_id", *[F.greatest(c, f"_{c}").alias(c) for c in _TIMES], "news",
            F.coalesce("_ended_in", F.when(F.col("capture_end_ns").isNotNull(), batch_id).cast("bigint")).alias("ended_in"))
        self._runs_table.append(known, batch_id)
        if not carried.isEmpty() or not records.filter("type = 'run_end'").isEmpty():
            batch = self._read(spark, "marked", _MARKED).filter(F.col("batch_id") == batch_id)
            self._write(self._new_versions(spark, batch, batch_id), "changes", "batch_id")
            if path_exists(spark, f"{self.root}/changes/batch_id={batch_id}"):
                self._windows_table.append(
                    spark.read.parquet(f"{self.root}/changes").filter(F.col("batch_id") == batch_id).drop("batch_id"), batch_id)
        self._forget(spark, batch_id)

    def _of_open_runs(self, records: DataFrame, earlier: DataFrame, batch_id: int) -> DataFrame:
        """The records without those of runs whose telemetry is gone, which are put aside."""
        if self.keep_ended is None:
            return records
        gone = earlier.filter(F.col("ended_in") < batch_id - self.keep_ended).select("run_id")
        self._write(records.join(gone, "run_id", "left_semi").withColumn("batch_id", F.lit(batch_id)), "after_end", "batch_id")
        return records.join(gone, "run_id", "left_anti")

    def _forget(self, spark: SparkSession, batch_id: int) -> None:
        """Delete telemetry of runs that ended long ago, and old batches of the log."""
        if self.keep_ended is not None:
            # The runs that ended in one batch.
            for r in self.runs(spark).filter(F.col("ended_in") == batch_id - self.keep_ended).select("run_id").collect():
                name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(r.run_id)
                delete(spark, f"{self.root}/marked/run_id={name}")
        if self.keep_changes is not None:
            delete(spark, f"{self.root}/changes/batch_id={batch_id - self.keep_changes}")

    def _with_held(self, records: DataFrame, fresh: DataFrame, bounds: DataFrame, batch_id: int) -> DataFrame:
        """The batch together with what waited for run starts that it brings.

        Telemetry of runs without a start is stored until the start comes; nothing is dropped.
        """
        spark = records.sparkSession
        early = records.filter("type NOT IN ('run_start', 'run_end')").join(bounds, "run_id", "left_anti")
        if not early.isEmpty():
            begun = self.runs(spark, before=batch_id).filter("capture_start_ns IS NOT NULL").select("run_id")
            # What has been taken by a start is dropped when its folders are merged.
            self._held_table.append(early, batch_id, lambda rows: rows.join(begun, "run_id", "left_anti"))
        waiting = self._held_table.before(spark, batch_id)
        if waiting is None:
            return records
        return records.unionByName(waiting.join(fresh.select("run_id").distinct(), "run_id", "left_semi").drop("batch_id"))

    def _slot(self, start: Column) -> Column:
        return F.floor(start / F.lit(self.window_ns * self.slot_windows))

    def _stored_rows(self, carried: DataFrame) -> DataFrame:
        """What later batches need: successful events, exits, and losses as rows of their own."""
        events = carried.filter(F.col("type") == "event").filter(ops.succeeded()).withColumns({
            "lost_events": F.lit(0).cast("bigint"),
            "slot": self._slot(ops.window_start("timestamp_ns", self.window_ns))})
        exits = carried.filter("type = 'process_exit'").withColumn(
            "slot", self._slot(ops.window_start("watermark_ns", self.window_ns)))
        losses = carried.filter("lost_events > 0").withColumns({
            "type": F.lit("heartbeat"),
            "slot": self._slot(ops.loss_window_start("timestamp_ns", self.window_ns))})
        return events.unionByName(exits).unionByName(losses)

    def _needed_slots(self, runs: DataFrame, *starts: DataFrame) -> DataFrame:
        """Slots of changed windows, and of all windows the watermark passed in this batch."""
        first, last = (
            self._slot(ops.window_start(column, self.window_ns))
            for column in (F.coalesce("_from", "capture_start_ns"), F.col("watermark_ns")))
        needed = runs.filter("watermark_ns IS NOT NULL").select(
            "run_id", F.explode(F.sequence(first, last)).alias("slot"))
        for keys in starts:
            needed = needed.unionByName(keys.select("run_id", self._slot(F.col("start_ns")).alias("slot")))
        return needed.distinct()

    def _new_versions(self, spark: SparkSession, batch: DataFrame, batch_id: int) -> DataFrame:
        """Windows this batch closed or changed after closing."""
        before = self.runs(spark, before=batch_id).select("run_id", F.col("watermark_ns").alias("_from"))
        now = self.runs(spark).drop("ended_in")
        present = now.filter(F.col("batch_id") == batch_id).select("run_id", F.col("news").alias("_news"))
        now = now.select("run_id", *_TIMES)
        # A run ends in the batch of its end record, or of its start if that comes later.
        runs = written(now.join(present, "run_id").join(before, "run_id", "left").withColumn(
            "_ended", F.col("_news") & F.col("capture_end_ns").isNotNull()).drop("_news").filter(
            "capture_start_ns IS NOT NULL"), "runs")

        changed_keys = (
            ops.tumbling_assign(batch, self.window_ns).select(*WINDOW_KEY)
            .unionByName(batch.filter("type = 'process_exit'").select(
                *WINDOW_KEY[:-1], ops.window_start("watermark_ns", self.window_ns).alias("start_ns")))
            .distinct().withColumn("_changed", F.lit(True)))
        losses = ops.loss_by_window(batch, self.window_ns).select(
            "run_id", "start_ns", F.lit(True).alias("_lost"))
        stored = self._read(spark, "marked", _MARKED).filter(F.col("batch_id") <= batch_id).join(
            self._needed_slots(runs, changed_keys, losses), ["run_id", "slot"], "left_semi")
        events = ops.tumbling_assign(stored, self.window_ns)
        end = F.col("start_ns") + self.window_ns
        closed_now = (end > F.coalesce("_from", "capture_start_ns")) & (end <= F.col("watermark_ns"))
        touched = written(
            events.select(*WINDOW_KEY).distinct()
            .join(runs, "run_id")
            .join(changed_keys, list(WINDOW_KEY), "left").join(losses, ["run_id", "start_ns"], "left")
            .filter(F.coalesce("_changed", F.lit(False)) | F.coalesce("_lost", F.lit(False))
                    | closed_now | (F.col("_ended") & (end > F.col("watermark_ns"))))
            .select(*WINDOW_KEY), "touched")

        kept = written(
            events.join(touched, list(WINDOW_KEY), "left_semi").select(*stored.columns)
            .unionByName(stored.filter("type <> 'event'")), "kept")
        bounds = runs.select("run_id", "capture_start_ns",
                             F.coalesce("capture_end_ns", F.lit(_OPEN_END)).alias("capture_end_ns"))
        renewed = ops.windows_from_marked(
            kept, bounds, window_ns=self.window_ns, bucket_ns=self.bucket_ns, bucket_rows=self.bucket_rows)
        state = runs.select("run_id", F.col("watermark_ns").alias("_mark"),
                            F.col("capture_end_ns").isNotNull().alias("_over"))
        return (
            renewed.join(state, "run_id")
            .filter(F.col("partial") | F.col("_over") | (F.col("end_ns") <= F.col("_mark")))
            .drop("_mark", "_over").withColumn("batch_id", F.lit(batch_id)))

    def replay(self, records: DataFrame, sizes: Sequence[int], first_batch: int = 0) -> None:
        """Take records in chunks of the given numbers, in arrival order; what is left is the last chunk.

        A chunk may end anywhere inside a run, and may be empty. The windows do not depend on the cuts.
        """
        if any(type(n) is not int or n < 0 for n in sizes):
            raise ValueError("chunk sizes must be whole numbers from 0 up")
        numbered = written(ranks(records, [], ["pos", "run_id", "type"], "_place", self.bucket_rows), "chunks")
        total, done = numbered.count(), 0
        if sum(sizes) > total:
            raise ValueError(f"chunk sizes exceed the {total} records")
        for number, size in enumerate([*sizes, total - sum(sizes)]):
            if size:
                chunk = numbered.filter((F.col("_place") >= done) & (F.col("_place") < done + size)).drop("_place")
                self.apply(chunk, first_batch + number)
            done += size

    def changes(self, spark: SparkSession) -> DataFrame:
        """The logged window versions; later ones replace earlier ones by ``window_id``."""
        return spark.read.parquet(f"{self.root}/changes").withColumnRenamed("batch_id", "version").withColumn(
            "version", F.col("version").cast("bigint"))

    def windows(self, spark: SparkSession) -> DataFrame:
        """The current version of every closed window."""
        found = self._windows_table.read(spark)
        return self.changes(spark).drop("version") if found is None else found.drop("batch_id")

    def start(self, records: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """Run over a streaming DataFrame of telemetry."""
        writer = records.writeStream.foreachBatch(lambda batch, number: self.apply(batch, number)).option(
            "checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
