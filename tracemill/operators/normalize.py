"""Raw collector records to contract telemetry."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tracemill.functions.ordered import BUCKET_ROWS, order_bucket, previous
from tracemill.schemas import COUNTERS

# Fixed values of the collector protocol.
CREATE_FLAG = 64
OPEN_CALLS = ("open", "openat")
UNLINK_CALLS = ("unlink", "unlinkat")
RUN_ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}\z"
HIDDEN_CATEGORIES = ("Cc", "Cf", "Cs", "Zl", "Zp")

_UNUSUAL = re.compile(r"[^ -%'-;=?-\[\]-~]")


def create_intent(name: str | Column, flags: str | Column) -> Column:
    """Open-family calls with the create flag; never an unlink."""
    name = F.col(name) if isinstance(name, str) else name
    flags = F.col(flags) if isinstance(flags, str) else flags
    return name.isin(*OPEN_CALLS) & (flags.bitwiseAND(F.lit(CREATE_FLAG)) != 0)


def operation(name: str | Column, intent: str | Column) -> Column:
    """``C``, ``O`` or ``D``; null for a call the contract does not know."""
    name = F.col(name) if isinstance(name, str) else name
    intent = F.col(intent) if isinstance(intent, str) else intent
    return (
        F.when(name.isin(*OPEN_CALLS), F.when(intent, F.lit("C")).otherwise(F.lit("O")))
        .when(name.isin(*UNLINK_CALLS), F.lit("D"))
    )


def _visible(match: re.Match) -> str:
    letter = match.group()
    point = ord(letter)
    if letter == "\\":
        return "\\\\"
    if 0xDC80 <= point <= 0xDCFF:
        return f"\\x{point & 0xFF:02x}"
    if letter not in "<>&" and unicodedata.category(letter) not in HIDDEN_CATEGORIES:
        return letter
    return f"\\x{point:02x}" if point < 0x100 else f"\\u{point:04x}" if point < 0x10000 else f"\\U{point:08x}"


@F.pandas_udf(T.StringType())
def _escape_names(raw: pd.Series) -> pd.Series:
    return raw.map(
        lambda name: _UNUSUAL.sub(_visible, bytes(name).decode("utf-8", "surrogateescape")),
        na_action="ignore",
    )


def filename_display(raw: str | Column) -> Column:
    """Readable text of raw bytes; unsafe or undecodable characters are escaped.

    Printable ASCII without specials stays inside the JVM; the Python function sees null for it.
    """
    raw = F.col(raw) if isinstance(raw, str) else raw
    text = F.decode(raw, "ISO-8859-1")
    plain = text.rlike(r"^[ -%'-;=?-\[\]-~]*\z")
    return F.when(plain, text).otherwise(_escape_names(F.when(~plain, raw)))


def protocol_violations(raw: DataFrame, strict_run_id: bool = False) -> DataFrame:
    """Violated shape rules per raw record."""
    syscall = F.col("event_type") == "syscall"
    parts = [F.col(name).isNotNull() for name in ("attempt", "result", "filename")]
    rules = [
        ("run_id is blank", F.coalesce(F.col("run_id").rlike(r"\S"), F.lit(False))),
        ("event_type is neither syscall nor process_exit", F.coalesce(F.col("event_type").isin("syscall", "process_exit"), F.lit(False))),
        ("attempt, result or filename of a syscall is missing",
         ~F.coalesce(syscall, F.lit(False)) | (parts[0] & parts[1] & parts[2])),
        ("process_exit carries fields of a syscall",
         F.coalesce(F.col("event_type") != "process_exit", F.lit(True)) | ~(parts[0] | parts[1] | parts[2])),
        ("syscall is not one that is mapped",
         ~F.coalesce(syscall, F.lit(False)) | F.coalesce(
             F.col("attempt.name").isin(*OPEN_CALLS, *UNLINK_CALLS), F.lit(False))),
    ]
    if strict_run_id:
        rules.append(("run_id has characters that are not allowed", F.coalesce(F.col("run_id").rlike(RUN_ID_PATTERN), F.lit(False))))
    return raw.withColumn("violations", F.array_remove(F.array(
        *[F.when(good, F.lit("")).otherwise(F.lit(message)) for message, good in rules]), ""))


def contract_events(raw: DataFrame) -> DataFrame:
    """System calls as contract events."""
    return raw.filter("event_type = 'syscall'").select(
        "recording", "pos", F.lit("event").alias("type"), "run_id", "collector_sequence",
        F.col("monotonic_ns").alias("timestamp_ns"), "process.boot_id", "process.tgid",
        "process.start_time_ns", "tid",
        operation("attempt.name", "attempt.create_intent").alias("operation"),
        F.col("result.return_value").alias("result"),
        F.col("filename.display").alias("filename"),
        F.col("filename.raw_base64").alias("filename_bytes_b64"),
        F.lit("complete").alias("telemetry_quality"),
        F.lit(0).cast("bigint").alias("lost_events"),
    )


def contract_exits(raw: DataFrame) -> DataFrame:
    """Process exits as lifecycle records; they never count as an operation."""
    return raw.filter("event_type = 'process_exit'").select(
        "recording", "pos", F.lit("process_exit").alias("type"), "run_id", "collector_sequence",
        F.col("monotonic_ns").alias("timestamp_ns"), "process.boot_id", "process.tgid",
        "process.start_time_ns", "tid",
    )


def counter_health(snapshots: DataFrame) -> DataFrame:
    """Total loss of each cumulative snapshot and whether telemetry is complete."""
    total = sum((F.col(name) for name in COUNTERS[1:]), F.col(COUNTERS[0]))
    return snapshots.withColumn("loss_total", total).withColumn(
        "telemetry_complete", F.col("loss_total") == 0)


def loss_deltas(snapshots: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Cumulative snapshots to newly lost events per snapshot, in ``pos`` order per run.

    The first snapshot counts in full. ``regressed`` marks a falling counter.
    """
    ranged = snapshots.withColumn("_range", order_bucket("pos", bucket_rows))
    paired = previous(
        ranged, ["run_id"], [F.col("pos")], ["_range"],
        {f"_old_{name}": F.col(name) for name in COUNTERS},
    )
    steps = [F.col(name) - F.coalesce(F.col(f"_old_{name}"), F.lit(0)) for name in COUNTERS]
    falling = [step < 0 for step in steps]
    regressed = falling[0]
    for item in falling[1:]:
        regressed = regressed | item
    return paired.select(
        *[name for name in snapshots.columns if name not in COUNTERS],
        sum(steps[1:], steps[0]).alias("lost_events"), regressed.alias("regressed"),
    )


def heartbeats(snapshots: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Heartbeat records from cumulative health snapshots, for validation and windows.

    Snapshots carry ``run_id``, ``pos``, ``timestamp_ns`` and the counters. A snapshot whose counters
    fell gives no record; ``loss_deltas`` lists it as ``regressed``.
    """
    return loss_deltas(snapshots, bucket_rows).filter(~F.col("regressed")).select(
        "run_id", "pos", F.lit("heartbeat").alias("type"), F.col("pos").alias("collector_sequence"),
        "timestamp_ns", "lost_events")
