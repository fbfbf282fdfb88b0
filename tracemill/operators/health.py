"""Ingestion health after every record and at the end of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracemill.functions.ordered import BUCKET_ROWS, order_bucket, running


def health_running(bounded: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Event rate and cumulative loss after each telemetry record in arrival order.

    The terminal record is not counted; ``with_run_bounds`` has already left it out.
    """
    ranged = bounded.withColumn("_range", order_bucket("pos", bucket_rows))
    counted = running(
        ranged, ["run_id"], [F.col("pos")], ["_range"],
        {
            "records": ("count", F.lit(1)),
            "_last": ("max", F.col("timestamp_ns")),
            "lost": ("sum", F.coalesce("lost_events", F.lit(0))),
        },
    )
    elapsed = F.greatest(F.col("_last") - F.col("capture_start_ns"), F.lit(1))
    return counted.select(
        "run_id", "pos", "records",
        (F.col("records") * F.lit(1e9) / elapsed).alias("event_rate"),
        F.col("lost").alias("lost_events"),
        F.lit(True).alias("connected"), F.lit(True).alias("recording"),
    )


def final_health(verdicts: DataFrame) -> DataFrame:
    """State once a run ended: its loss total if accepted, else the first error."""
    return verdicts.select(
        "recording", "run_id",
        F.lit(False).alias("connected"), F.lit(0.0).alias("event_rate"),
        F.when(F.col("accepted"), F.col("total_lost_events"))
        .otherwise(F.col("observed_loss")).alias("lost_events"),
        F.lit(False).alias("recording_active"),
        F.get("violations", F.lit(0)).alias("error"),
    )


def run_summary(telemetry: DataFrame, windows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Records, windows and alerts per run."""
    records = telemetry.filter(F.col("type").isin("event", "heartbeat", "process_exit")).groupBy(
        "run_id").agg(F.count("*").alias("records"))
    counted = windows.groupBy("run_id").agg(F.count("*").alias("windows"))
    positive = predictions.groupBy("run_id").agg(F.count_if("suspicious").alias("alerts"))
    return (
        records.join(counted, "run_id", "left").join(positive, "run_id", "left")
        .select("run_id", "records",
                F.coalesce("windows", F.lit(0)).alias("windows"),
                F.coalesce("alerts", F.lit(0)).alias("alerts"))
    )
