"""Record shapes and the fixed values of the telemetry contract."""

from __future__ import annotations

from itertools import product

from pyspark.sql import types as T

# Fixed values of the contract.
CONTRACT_VERSION = 1
FEATURE_VERSION = 2
SECOND_NS = 1_000_000_000
WINDOW_NS = 10_000_000_000
OPERATIONS = ("O", "C", "D")
QUALITIES = ("complete", "degraded")
RUN_SOURCES = ("live", "replay", "controlled-workload")
END_STATUSES = ("complete", "failed")
RULE_VERSION = "rule-success-count-rate-v2"
DEFAULT_THRESHOLD = 4.0

GRAMS = tuple("".join(letters) for letters in product(OPERATIONS, repeat=3))
SUMS = tuple(f"{name}_sum" for name in OPERATIONS)
MAXIMA = tuple(f"{name}_max_1s" for name in OPERATIONS)
FEATURES = SUMS + MAXIMA + GRAMS

PROCESS = ("boot_id", "tgid", "start_time_ns")
PROCESS_KEY = ("run_id", *PROCESS)
WINDOW_KEY = (*PROCESS_KEY, "start_ns")

U64 = T.DecimalType(20, 0)

# One row per telemetry record, flattened. ``pos`` is the arrival position inside its recording.
TELEMETRY = T.StructType([
    T.StructField("recording", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("collector_sequence", T.LongType()),
    T.StructField("timestamp_ns", T.LongType()),
    T.StructField("boot_id", T.StringType()),
    T.StructField("tgid", T.LongType()),
    T.StructField("start_time_ns", T.LongType()),
    T.StructField("tid", T.LongType()),
    T.StructField("operation", T.StringType()),
    T.StructField("result", T.LongType()),
    T.StructField("filename", T.StringType()),
    T.StructField("filename_bytes_b64", T.StringType()),
    T.StructField("telemetry_quality", T.StringType()),
    T.StructField("lost_events", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("total_lost_events", T.LongType()),
    T.StructField("capture_start_ns", T.LongType()),
    T.StructField("source", T.StringType()),
])

PROCESS_STRUCT = T.StructType([
    T.StructField("boot_id", T.StringType()),
    T.StructField("tgid", T.LongType()),
    T.StructField("start_time_ns", U64),
])

COUNTERS = (
    "ring_buffer_reservation_failures",
    "pending_map_update_failures",
    "filename_read_failures",
    "identity_read_failures",
    "consumer_decode_errors",
    "consumer_queue_drops",
)

RAW_SYSCALL = T.StructType([
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("collector_sequence", U64),
    T.StructField("monotonic_ns", U64),
    T.StructField("process", PROCESS_STRUCT),
    T.StructField("tid", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("attempt", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("create_intent", T.BooleanType()),
    ])),
    T.StructField("result", T.StructType([
        T.StructField("return_value", T.LongType()),
        T.StructField("succeeded", T.BooleanType()),
    ])),
    T.StructField("filename", T.StructType([
        T.StructField("raw_base64", T.StringType()),
        T.StructField("display", T.StringType()),
        T.StructField("truncated", T.BooleanType()),
    ])),
])

HEALTH = T.StructType([
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("monotonic_ns", U64),
    T.StructField("connected", T.BooleanType()),
    T.StructField("loss_counters", T.StructType([T.StructField(name, U64) for name in COUNTERS])),
    T.StructField("loss_total", T.DecimalType(38, 0)),
    T.StructField("telemetry_complete", T.BooleanType()),
])

LABELED_WINDOW = T.StructType([
    T.StructField("window_id", T.StringType()),
    T.StructField("capture_id", T.StringType()),
    T.StructField("capture_hash", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("feature_version", T.IntegerType()),
    T.StructField("feature_names", T.ArrayType(T.StringType())),
    T.StructField("features", T.ArrayType(T.DoubleType())),
    T.StructField("complete", T.BooleanType()),
    T.StructField("quality", T.StringType()),
])

RUN_MANIFEST = T.StructType([
    T.StructField("schema_version", T.LongType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("scenario", T.StringType()),
    T.StructField("seed", T.LongType()),
    T.StructField("split", T.StringType()),
    T.StructField("behavior_label", T.StringType()),
    T.StructField("plan_sha256", T.StringType()),
    T.StructField("label_provenance", T.StringType()),
    T.StructField("tracked_processes", T.ArrayType(PROCESS_STRUCT)),
    T.StructField("process_scope_policy", T.StringType()),
    T.StructField("background_activity", T.StringType()),
    T.StructField("workspace", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("workload_hold_seconds", T.DoubleType()),
    T.StructField("limits", T.StructType([
        T.StructField("max_seconds", T.DoubleType()),
        T.StructField("max_files", T.LongType()),
        T.StructField("max_bytes", T.LongType()),
    ])),
])

PLAN_RUN = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("scenario", T.StringType()),
    T.StructField("workload_identity", T.StringType()),
    T.StructField("seed", T.LongType()),
    T.StructField("split", T.StringType()),
    T.StructField("behavior_label", T.StringType()),
    T.StructField("label_provenance", T.StringType()),
    T.StructField("plan_sha256", T.StringType()),
    T.StructField("label_scope", T.StructType([
        T.StructField("kind", T.StringType()),
        T.StructField("root_identity", T.StringType()),
        T.StructField("include_descendants", T.BooleanType()),
        T.StructField("background_activity", T.StringType()),
    ])),
    T.StructField("capture_duration_seconds", T.DoubleType()),
    T.StructField("workload_hold_seconds", T.DoubleType()),
])

FILE_MANIFEST = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("sha256", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("capture_id", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("git_blob_sha256", T.StringType()),
    T.StructField("git_blob_size", T.LongType()),
])
