"""Fixed windows per process and their features.

Telemetry comes flattened (``schemas.TELEMETRY``). ``pos`` is the arrival position in the run and
``collector_sequence`` orders trigrams. Runs are described by one row each: ``run_id``,
``capture_start_ns``, ``capture_end_ns``.

All times are integers in nanoseconds. A timestamp type would lose precision, and an event-time
watermark of a streaming query would drop late events that have to replace earlier results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracemill.functions.json_text import window_id
from tracemill.functions.ordered import BUCKET_ROWS, order_bucket, running, trigram_profile
from tracemill.schemas import (
    FEATURE_VERSION, FEATURES, GRAMS, MAXIMA, OPERATIONS, PROCESS, SECOND_NS, SUMS, WINDOW_KEY,
    WINDOW_NS,
)
from tracemill.session import written

STREAM_TYPES = ("event", "heartbeat", "process_exit")
# What windows need of a record; names and other wide fields stay out of shuffles and tables.
NARROW = ("run_id", "type", *PROCESS, "operation", "result", "timestamp_ns", "pos", "collector_sequence",
          "lost_events")


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def succeeded(result: str | Column = "result") -> Column:
    """A missing result counts as success; a negative one is a failed attempt."""
    return _column(result).isNull() | (_column(result) >= 0)


def successful_events(telemetry: DataFrame) -> DataFrame:
    return telemetry.filter((F.col("type") == "event") & succeeded())


def window_start(timestamp: str | Column, window_ns: int = WINDOW_NS) -> Column:
    """Start of the containing window, counted from the run's ``capture_start_ns``."""
    column = _column(timestamp)
    return column - F.pmod(column - F.col("capture_start_ns"), F.lit(window_ns))


def loss_window_start(timestamp: str | Column, window_ns: int = WINDOW_NS) -> Column:
    """A loss report exactly on a boundary counts for the interval that just ended."""
    column = _column(timestamp)
    delta = column - F.col("capture_start_ns")
    on_boundary = (delta > 0) & (F.pmod(delta, F.lit(window_ns)) == 0)
    return window_start(F.when(on_boundary, column - 1).otherwise(column), window_ns)


def with_run_bounds(telemetry: DataFrame, runs: DataFrame) -> DataFrame:
    """Attach the run start that fixes window alignment; keeps stream records only."""
    return (
        telemetry.filter(F.col("type").isin(*STREAM_TYPES)).drop("capture_start_ns")
        .join(runs.select("run_id", "capture_start_ns"), "run_id")
    )


def tumbling_assign(bounded: DataFrame, window_ns: int = WINDOW_NS) -> DataFrame:
    start = window_start("timestamp_ns", window_ns)
    return successful_events(bounded).select("*", start.alias("start_ns"), (start + window_ns).alias("end_ns"))


def operation_counts(bounded: DataFrame, window_ns: int = WINDOW_NS) -> DataFrame:
    """``O_sum``, ``C_sum`` and ``D_sum`` per window."""
    return tumbling_assign(bounded, window_ns).groupBy(*WINDOW_KEY).agg(
        *[F.expr(f"count_if(operation = '{name}') AS {name}_sum") for name in OPERATIONS]
    )


def bucket_maxima(bounded: DataFrame, window_ns: int = WINDOW_NS, bucket_ns: int = SECOND_NS) -> DataFrame:
    """Most events of one operation in any short interval of the window."""
    return _maxima(_per_bucket(tumbling_assign(bounded, window_ns), bucket_ns))


def _per_bucket(assigned: DataFrame, bucket_ns: int, *extra: Column) -> DataFrame:
    offset = F.col("timestamp_ns") - F.col("start_ns")
    return assigned.groupBy(*WINDOW_KEY, (offset - F.pmod(offset, F.lit(bucket_ns))).alias("_second")).agg(
        *[F.expr(f"count_if(operation = '{name}') AS _{name}") for name in OPERATIONS], *extra
    )


def _maxima(per_bucket: DataFrame, *extra: Column) -> DataFrame:
    return per_bucket.groupBy(*WINDOW_KEY).agg(
        *[F.expr(f"max(_{name}) AS {name}_max_1s") for name in OPERATIONS], *extra
    )


def window_trigrams(
    bounded: DataFrame, window_ns: int = WINDOW_NS, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Operation sums and the 27 trigrams of each window, ordered by collector sequence."""
    assigned = tumbling_assign(bounded, window_ns).select(
        *WINDOW_KEY, "operation", "collector_sequence",
        order_bucket("collector_sequence", bucket_rows).alias("_range"),
    )
    return trigram_profile(
        assigned, WINDOW_KEY, [F.col("collector_sequence")], ["_range"], "operation", OPERATIONS
    )


def running_watermark(bounded: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``watermark_ns``: the greatest timestamp up to and including each record's arrival."""
    ranged = bounded.withColumn("_range", order_bucket("pos", bucket_rows))
    marked = running(
        ranged, ["run_id"], [F.col("pos")], ["_range"], {"_seen": ("max", F.col("timestamp_ns"))}
    )
    return (
        marked.withColumn("watermark_ns", F.greatest("_seen", "capture_start_ns"))
        .drop("_seen", "_range")
    )


def mark_telemetry(telemetry: DataFrame, runs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """What windows need of the stream records, with ``watermark_ns`` and ``run_last_ns``.

    ``run_last_ns`` is the greatest timestamp of the run. It comes from the range summaries of the
    watermark, and run bounds are joined once, after it.
    """
    ranged = telemetry.filter(F.col("type").isin(*STREAM_TYPES)).select(
        *NARROW, order_bucket("pos", bucket_rows).alias("_range"))
    seen = running(
        ranged, ["run_id"], [F.col("pos")], ["_range"], {"_seen": ("max", F.col("timestamp_ns"))}, ["_seen"])
    return seen.join(runs.select("run_id", "capture_start_ns"), "run_id").select(
        *NARROW, "capture_start_ns", F.greatest("_seen", "capture_start_ns").alias("watermark_ns"),
        F.col("_seen_total").alias("run_last_ns"))


def exit_positions(marked: DataFrame, window_ns: int = WINDOW_NS) -> DataFrame:
    """Where an exit closed a process window: ``exit_pos`` per window, if any.

    An exit closes the window that contains the watermark, provided the window had an event
    before the exit.
    """
    first = tumbling_assign(marked, window_ns).groupBy(*WINDOW_KEY).agg(F.min("pos").alias("_first"))
    exits = marked.filter(F.col("type") == "process_exit").select(
        "run_id", *PROCESS, window_start("watermark_ns", window_ns).alias("start_ns"), "pos"
    )
    return (
        exits.join(first, list(WINDOW_KEY)).filter(F.col("pos") > F.col("_first"))
        .groupBy(*WINDOW_KEY).agg(F.min("pos").alias("exit_pos"))
    )


def late_events(marked: DataFrame, window_ns: int = WINDOW_NS) -> DataFrame:
    """Successful events with ``late``: their window was closed before they arrived."""
    joined = tumbling_assign(marked, window_ns).join(
        exit_positions(marked, window_ns), list(WINDOW_KEY), "left"
    )
    late = (F.col("end_ns") <= F.col("watermark_ns")) | F.coalesce(
        F.col("pos") > F.col("exit_pos"), F.lit(False)
    )
    return joined.withColumn("late", late)


def loss_by_window(bounded: DataFrame, window_ns: int = WINDOW_NS) -> DataFrame:
    """Lost events per run interval; failed events report losses too."""
    return (
        bounded.filter(F.col("lost_events") > 0)
        .groupBy("run_id", loss_window_start("timestamp_ns", window_ns).alias("start_ns"))
        .agg(F.sum("lost_events").alias("loss_count"))
    )


def quality_flags() -> Column:
    flags = (
        "array_remove(array(IF(partial, 'partial', ''), IF(loss_count > 0, 'loss', ''),"
        " IF(late_event_count > 0, 'late', '')), '')"
    )
    return F.expr(f"CASE WHEN size({flags}) > 0 THEN {flags} ELSE array('complete') END")


def with_quality(windows: DataFrame) -> DataFrame:
    """Add quality flags, ``complete`` and ``classifiable``."""
    complete = ~F.col("partial") & (F.col("loss_count") == 0)
    return windows.withColumns({
        "quality": quality_flags(),
        "complete": complete,
        "classifiable": complete & (F.col("late_event_count") == 0),
    })


def window_closings(
    marked: DataFrame, runs: DataFrame, window_ns: int = WINDOW_NS, bucket_ns: int = SECOND_NS
) -> DataFrame:
    """Maxima, lateness and partial flags per window, from watermarked telemetry."""
    known = "run_last_ns" in marked.columns
    per_bucket = _per_bucket(
        late_events(marked, window_ns), bucket_ns,
        F.count_if("late").alias("_late"), F.max("exit_pos").alias("_exit"),
        *([F.max("run_last_ns").alias("_last")] if known else []),
    )
    closed = _maxima(
        per_bucket, F.sum("_late").alias("late_event_count"), F.max("_exit").alias("exit_pos"),
        *([F.max("_last").alias("_last")] if known else []),
    )
    ends = runs.select("run_id", "capture_end_ns")
    if not known:
        ends = ends.join(marked.groupBy("run_id").agg(F.max("timestamp_ns").alias("_last")), "run_id")
    by_exit = F.col("exit_pos").isNotNull()
    by_end = F.col("start_ns") + window_ns > F.greatest("_last", "capture_end_ns")
    return closed.join(ends, "run_id").select(
        *WINDOW_KEY, *MAXIMA, "late_event_count",
        by_exit.alias("partial_by_exit"), (by_exit | by_end).alias("partial"),
    )


def windows_from_marked(
    marked: DataFrame, runs: DataFrame, *, window_ns: int = WINDOW_NS,
    bucket_ns: int = SECOND_NS, bucket_rows: int = BUCKET_ROWS, trigrams: bool = True,
) -> DataFrame:
    """Feature windows from telemetry that already carries ``watermark_ns``.

    Without ``trigrams`` these columns are left out, and with them their sort: rule scores need sums and
    quality only.
    """
    profile = window_trigrams(marked, window_ns, bucket_rows) if trigrams else operation_counts(marked, window_ns)
    closings = window_closings(marked, runs, window_ns, bucket_ns).drop("partial_by_exit")
    losses = loss_by_window(marked, window_ns)
    joined = (
        profile.join(closings, list(WINDOW_KEY))
        .join(losses, ["run_id", "start_ns"], "left")
        .withColumn("loss_count", F.coalesce("loss_count", F.lit(0)))
        .withColumn("end_ns", F.col("start_ns") + window_ns)
    )
    return with_quality(joined).select(
        window_id().alias("window_id"), *WINDOW_KEY, "end_ns",
        F.lit(FEATURE_VERSION).alias("feature_version"),
        *SUMS, *MAXIMA, *(GRAMS if trigrams else ()),
        "partial", "loss_count", "late_event_count", "quality", "complete", "classifiable",
    )


def extract_windows(
    telemetry: DataFrame, runs: DataFrame, *, window_ns: int = WINDOW_NS,
    bucket_ns: int = SECOND_NS, bucket_rows: int = BUCKET_ROWS, trigrams: bool = True,
) -> DataFrame:
    """Telemetry and run bounds to one row per process window.

    Watermarked records are written once, with the columns windows need, and every later branch
    reads that table.
    """
    marked = written(mark_telemetry(telemetry, runs, bucket_rows), "marked")
    return windows_from_marked(
        marked, runs, window_ns=window_ns, bucket_ns=bucket_ns, bucket_rows=bucket_rows, trigrams=trigrams
    )


def in_window_order(windows: DataFrame) -> DataFrame:
    return windows.orderBy("start_ns", "boot_id", "tgid", "start_time_ns")


def feature_arrays(windows: DataFrame) -> DataFrame:
    """Replace the 33 feature columns by parallel name and value arrays."""
    return windows.withColumns({
        "feature_names": F.expr(f"array({', '.join(repr(name) for name in FEATURES)})"),
        "feature_values": F.array(*FEATURES),
    }).drop(*FEATURES)


def feature_map(windows: DataFrame) -> DataFrame:
    return feature_arrays(windows).withColumn(
        "features", F.map_from_arrays("feature_names", "feature_values")
    ).drop("feature_names", "feature_values")


def feature_long(windows: DataFrame) -> DataFrame:
    """One row per window and feature."""
    keep = [name for name in windows.columns if name not in FEATURES]
    return windows.unpivot(keep, list(FEATURES), "feature", "value")
