"""Recordings to stored, scored windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracemill.functions.ordered import BUCKET_ROWS
from tracemill.operators import score, validate, windows
from tracemill.schemas import DEFAULT_THRESHOLD, SECOND_NS, WINDOW_NS
from tracemill.session import written
from tracemill.sources import recordings, sinks


def accepted_telemetry(spark: SparkSession, path: str | list[str], **rules) -> tuple[DataFrame, DataFrame]:
    """Telemetry and verdicts of recordings; any rejected line fails the read."""
    lines = recordings.read_lines(spark, path)
    parsed = written(recordings.parse_records(lines), "parsed")
    rejected = parsed.filter("size(violations) > 0")
    if not rejected.isEmpty():
        row = recordings.line_numbers(lines, rejected).orderBy("recording", "line_number").first()
        raise ValueError(f"{row['recording']}:{row['line_number']}: {row['violations'][0]}")
    telemetry = recordings.telemetry_records(parsed)
    return telemetry, validate.validate_runs(telemetry, **rules)


def replay(
    spark: SparkSession, path: str | list[str], *, threshold: float = DEFAULT_THRESHOLD,
    window_ns: int = WINDOW_NS, bucket_ns: int = SECOND_NS, bucket_rows: int = BUCKET_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, windows and predictions of accepted recordings; a broken recording fails the call.

    Watermarked telemetry is written once and read by every later branch.
    """
    telemetry, verdicts = accepted_telemetry(spark, path, bucket_rows=bucket_rows)
    verdicts = written(verdicts, "verdicts")
    broken = verdicts.filter(~F.col("accepted")).first()
    if broken is not None:
        raise ValueError(f"{broken['recording']}: {broken['violations'][0]}")
    runs = validate.accepted_runs(verdicts)
    found = written(windows.extract_windows(
        telemetry, runs, window_ns=window_ns, bucket_ns=bucket_ns, bucket_rows=bucket_rows), "windows")
    return runs, found, score.score_windows(found, threshold)


def replay_and_publish(spark: SparkSession, path: str | list[str], results: str, **options) -> None:
    runs, found, predictions = replay(spark, path, **options)
    stored = runs.select("run_id", "source", F.col("capture_start_ns").alias("started_ns"),
                         F.lit("complete").alias("status"))
    sinks.publish_runs(stored, found, predictions, results)
