"""Fail-closed validation of whole recordings: one verdict row per recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tracemill.functions.ordered import BUCKET_ROWS, order_bucket
from tracemill.operators.windows import STREAM_TYPES

BEGIN = "first record is not the only run start"
END = "last record is not the only run end"
ENVELOPE = "record of another kind between run start and run end"
STATUS = "run did not finish as complete"
RUN_ID = "records of several runs in one recording"
START_MATCH = "run starts at another time than expected"
END_MATCH = "run ends at another time than expected"
SEQUENCE = "sequence numbers are not 1, 2, 3 and so on"
BOUNDARY = "time lies before run start or after run end"
LOSS_TOTAL = "losses do not add up to the total at run end"
LOSSY = "events were lost"
DEGRADED = "some telemetry is degraded"
NO_RESULT = "an event has no result"


def sequence_order(records: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per recording: are sequences exactly 1..n in arrival order, terminal record included?

    Order is checked inside position ranges; the ranges are then chained by their end values.
    """
    sequenced = records.filter(F.col("type").isin(*STREAM_TYPES, "run_end")).select(
        "recording", "pos", F.col("collector_sequence").alias("_seq"),
        order_bucket("pos", bucket_rows).alias("_range"),
    )
    inside = Window.partitionBy("recording", "_range").orderBy("pos")
    steps = sequenced.select(
        "*", (F.col("_seq") - F.lag("_seq").over(inside)).alias("_step"))
    ranges = steps.groupBy("recording", "_range").agg(
        F.count_if((F.col("_step") != 1) | F.col("_seq").isNull()).alias("_breaks"),
        F.min_by("_seq", "pos").alias("_first"),
        F.max_by("_seq", "pos").alias("_last"),
    )
    along = Window.partitionBy("recording").orderBy("_range")
    chained = ranges.select(
        "recording", "_breaks",
        (F.col("_first") - F.coalesce(F.lag("_last").over(along), F.lit(0)) != 1).alias("_gap"),
    )
    return chained.groupBy("recording").agg(
        ((F.sum("_breaks") == 0) & (F.count_if("_gap") == 0)).alias("in_sequence")
    )


def duplicate_sequences(records: DataFrame) -> DataFrame:
    """Sequence numbers used by more than one stream record of a run."""
    return (
        records.filter(F.col("type").isin(*STREAM_TYPES))
        .groupBy("run_id", "collector_sequence").agg(F.count("*").alias("uses"))
        .filter("uses > 1")
    )


def engine_violations(bounded: DataFrame) -> DataFrame:
    """Records the window logic itself refuses: before the run start, or repeated sequences."""
    early = bounded.filter(F.col("timestamp_ns") < F.col("capture_start_ns")).select(
        "run_id", "collector_sequence", F.lit("time lies before run start").alias("violation"))
    repeated = duplicate_sequences(bounded).select(
        "run_id", "collector_sequence",
        F.lit("sequence number used twice").alias("violation"))
    return early.unionByName(repeated)


def validate_runs(
    records: DataFrame,
    *,
    expected: DataFrame | None = None,
    require_lossless: bool = True,
    require_results: bool = True,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Verdict per recording with every violated rule, in the order the rules are checked.

    ``expected`` may give ``recording``, ``capture_start_ns`` and ``capture_end_ns`` to match.
    """
    kind = F.col("type")
    is_stream = kind.isin(*STREAM_TYPES)
    is_event = kind == "event"
    start, end = kind == "run_start", kind == "run_end"
    totals = records.groupBy("recording").agg(
        F.count("*").alias("records"),
        F.min_by("type", "pos").alias("_first_type"),
        F.max_by("type", "pos").alias("_last_type"),
        F.count_if(start).alias("_starts"),
        F.count_if(end).alias("_ends"),
        F.count_if(~is_stream & ~start & ~end | kind.isNull()).alias("_foreign"),
        F.max(F.when(start, F.col("run_id"))).alias("run_id"),
        F.max(F.when(start, F.col("source"))).alias("source"),
        F.max(F.when(start, F.col("capture_start_ns"))).alias("capture_start_ns"),
        F.max(F.when(end, F.col("timestamp_ns"))).alias("capture_end_ns"),
        F.max(F.when(end, F.col("status"))).alias("_status"),
        F.max(F.when(end, F.col("total_lost_events"))).alias("total_lost_events"),
        F.min("run_id").alias("_run_low"),
        F.max("run_id").alias("_run_high"),
        F.min(F.when(is_stream, F.col("timestamp_ns"))).alias("_low"),
        F.max(F.when(is_stream, F.col("timestamp_ns"))).alias("_high"),
        F.coalesce(F.sum(F.when(is_stream, F.col("lost_events"))), F.lit(0)).alias("observed_loss"),
        F.count_if(is_event).alias("event_count"),
        F.count_if(kind == "heartbeat").alias("heartbeat_count"),
        F.count_if(kind == "process_exit").alias("process_exit_count"),
        F.count_if(is_event & (F.col("telemetry_quality") != "complete")).alias("_degraded"),
        F.count_if(is_event & F.col("result").isNull()).alias("_unfinished"),
    ).join(sequence_order(records, bucket_rows), "recording", "left")

    outside = (
        (F.col("capture_end_ns") < F.col("capture_start_ns"))
        | (F.col("_low") < F.col("capture_start_ns"))
        | (F.col("_high") > F.col("capture_end_ns"))
    )
    rules = [
        (BEGIN, (F.col("records") < 2) | (F.col("_first_type") != "run_start") | (F.col("_starts") != 1)),
        (END, (F.col("_last_type") != "run_end") | (F.col("_ends") != 1)),
        (ENVELOPE, F.col("_foreign") > 0),
        (STATUS, F.coalesce(F.col("_status"), F.lit("")) != "complete"),
        (RUN_ID, F.col("_run_low") != F.col("_run_high")),
    ]
    if expected is not None:
        wanted = expected.select(
            "recording",
            F.col("capture_start_ns").alias("_want_start"),
            F.col("capture_end_ns").alias("_want_end"),
        )
        totals = totals.join(wanted, "recording", "left")
        rules += [
            (START_MATCH, F.col("_want_start") != F.col("capture_start_ns")),
            (END_MATCH, F.col("_want_end") != F.col("capture_end_ns")),
        ]
    rules += [
        (SEQUENCE, ~F.coalesce("in_sequence", F.lit(False))),
        (BOUNDARY, outside),
        (LOSS_TOTAL, F.col("observed_loss") != F.col("total_lost_events")),
    ]
    if require_lossless:
        rules += [(LOSSY, F.col("observed_loss") > 0), (DEGRADED, F.col("_degraded") > 0)]
    if require_results:
        rules += [(NO_RESULT, F.col("_unfinished") > 0)]
    violations = F.array_compact(F.array(*[F.when(bad, F.lit(text)) for text, bad in rules]))
    return totals.withColumn("violations", violations).select(
        "recording", "run_id", "source", "capture_start_ns", "capture_end_ns",
        "records", "event_count", "heartbeat_count", "process_exit_count",
        "observed_loss", "total_lost_events", "violations",
        (F.size("violations") == 0).alias("accepted"),
    )


def accepted_runs(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter("accepted").select(
        "recording", "run_id", "source", "capture_start_ns", "capture_end_ns")


def keep_accepted(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Records of accepted recordings only."""
    return records.join(verdicts.filter("accepted").select("recording"), "recording", "left_semi")
