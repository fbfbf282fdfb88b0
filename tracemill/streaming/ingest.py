"""Recordings that arrive as files: bronze records, fail-closed publishing of finished runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tracemill.functions.ordered import BUCKET_ROWS
from tracemill.operators import health, score, validate, windows as ops
from tracemill.schemas import DEFAULT_THRESHOLD, SECOND_NS, TELEMETRY, WINDOW_NS
from tracemill.session import written
from tracemill.sources import recordings, sinks
from tracemill.streaming.open_runs import IDLE_MS, OpenRuns


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of recordings as they appear in a folder, with their file and block."""
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format("text").load(folder).selectExpr(
        "value", "_metadata.file_path AS recording", "_metadata.file_block_start AS block")


@dataclass(frozen=True)
class RunIngest:
    """Collect records per run; publish results once a run ended and passed validation."""

    root: str
    threshold: float = DEFAULT_THRESHOLD
    window_ns: int = WINDOW_NS
    bucket_ns: int = SECOND_NS
    bucket_rows: int = BUCKET_ROWS

    def apply(self, lines: DataFrame, batch_id: int) -> None:
        spark = lines.sparkSession
        # Row numbers are not allowed in a stream, but a micro-batch keeps the scan's partitions.
        placed = lines.withColumn("pos", F.expr(f"2 * block + {recordings.ROW_IN_PARTITION}"))
        parsed = recordings.parse_records(placed)
        self._append(recordings.quarantine(parsed).select("recording", "pos", "value", "type", "violations"),
                     "quarantine", batch_id)
        self._append(recordings.telemetry_records(parsed), "records", batch_id, "run_id")

        batch = self._records(spark).filter(F.col("batch_id") == batch_id)
        # Every ended run with news is judged, so a late file can reopen a verdict.
        finished = self._records(spark).filter("type = 'run_end'").select("run_id").join(
            batch.select("run_id"), "run_id", "left_semi").distinct()
        # Arrival order is (batch, file, line), however a run is cut into files.
        stored = self._records(spark).join(finished, "run_id", "left_semi")
        earlier = Window.partitionBy("run_id").orderBy("batch_id", "recording").rowsBetween(
            Window.unboundedPreceding, -1)
        files = stored.groupBy("run_id", "batch_id", "recording").agg((F.max("pos") + 1).alias("_rows")).select(
            "run_id", "batch_id", "recording", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
        whole = stored.join(files, ["run_id", "batch_id", "recording"]).withColumns({
            "recording": F.col("run_id"), "pos": F.col("pos") + F.col("_before")}).drop("_before", "batch_id")
        damaged = self._quarantined_runs(spark)
        verdicts = written(
            validate.validate_runs(whole, bucket_rows=self.bucket_rows)
            .join(damaged, "run_id", "left").withColumn("violations", F.when(
                F.col("_bad_lines") > 0, F.concat(F.array(F.lit("recording has lines that could not be read")), F.col("violations")))
                .otherwise(F.col("violations")))
            .withColumn("accepted", F.size("violations") == 0).drop("_bad_lines"), "verdicts")
        self._append(health.final_health(verdicts), "health", batch_id)

        accepted = validate.accepted_runs(verdicts)
        good = validate.keep_accepted(whole, verdicts)
        found = written(ops.extract_windows(
            good, accepted, window_ns=self.window_ns, bucket_ns=self.bucket_ns, bucket_rows=self.bucket_rows), "windows")
        runs = accepted.select(
            "run_id", "source", F.col("capture_start_ns").alias("started_ns"), F.lit("complete").alias("status"))
        sinks.publish_runs(runs, found, score.score_windows(found, self.threshold), f"{self.root}/results")
        sinks.withdraw_runs(verdicts.filter(~F.col("accepted")).select("run_id"), f"{self.root}/results")

    def _append(self, df: DataFrame, name: str, batch_id: int, *partitions: str) -> None:
        rows = df.withColumn("batch_id", F.lit(batch_id))
        rows = rows.hint("rebalance", *partitions) if partitions else rows.hint("rebalance")
        rows.write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(*partitions, "batch_id").parquet(f"{self.root}/{name}")

    def _records(self, spark: SparkSession) -> DataFrame:
        shape = T.StructType([*TELEMETRY.fields, T.StructField("batch_id", T.LongType())])
        return spark.read.schema(shape).parquet(f"{self.root}/records")

    def _quarantined_runs(self, spark: SparkSession) -> DataFrame:
        """Runs whose files held lines that could not be accepted."""
        # The schema is given, since no file exists while no line was refused.
        bad = spark.read.schema("recording string, pos bigint").parquet(f"{self.root}/quarantine").groupBy(
            "recording").agg(F.count("*").alias("_n"))
        return self._records(spark).select("recording", "run_id").distinct().join(bad, "recording").groupBy(
            "run_id").agg(F.sum("_n").alias("_bad_lines"))

    def open_runs(self, idle_ms: int = IDLE_MS) -> OpenRuns:
        """The log of runs that are still being recorded."""
        return OpenRuns(f"{self.root}/open", idle_ms)

    def watch(self, lines: DataFrame, checkpoint: str, available_now: bool = True,
              idle_ms: int = IDLE_MS) -> StreamingQuery:
        """Follow rate and loss of open runs, in a query beside that of ``start``.

        A line that breaks the contract shows as the error of its run from that batch on.
        """
        parsed = recordings.parse_records(lines.withColumn("pos", F.lit(0).cast("bigint")))
        return self.open_runs(idle_ms).start(recordings.progress_records(parsed), checkpoint, available_now)

    def start(self, lines: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        writer = lines.writeStream.foreachBatch(lambda batch, number: self.apply(batch, number)).option(
            "checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
