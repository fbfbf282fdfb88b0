"""JSON Lines recordings: scan, strict validation and typed projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracemill.functions.json_text import window_id
from tracemill.schemas import (
    CONTRACT_VERSION, END_STATUSES, FEATURE_VERSION, FEATURES, HEALTH, LABELED_WINDOW, OPERATIONS,
    QUALITIES, RAW_SYSCALL, RUN_SOURCES, TELEMETRY,
)

MAX_U64 = 2**64 - 1
MAX_U32 = 2**32 - 1
MAX_I63 = 2**63 - 1

# Rows below the 33rd bit of the generated id count the rows of one read partition. A partition
# holds at most as many rows as bytes, and at most one split size of bytes, so doubling the offset
# of the file block keeps positions of later blocks above those of earlier ones.
ROW_IN_PARTITION = "(monotonically_increasing_id() & 8589934591)"
POSITION = f"2 * _metadata.file_block_start + {ROW_IN_PARTITION}"


def read_lines(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """Every line of the files with ``recording`` (its file), ``block`` and ``pos``."""
    return spark.read.options(**options).text(path, lineSep="\n").selectExpr(
        "value", "_metadata.file_path AS recording", "_metadata.file_block_start AS block",
        f"{POSITION} AS pos",
    )


def line_numbers(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Add the one-based line number to ``wanted`` rows of ``lines``.

    Only one row per file block is ordered; lines inside a block are numbered by position.
    """
    along = Window.partitionBy("recording").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        lines.groupBy("recording", "block")
        .agg(F.count("*").alias("_n"), F.min("pos").alias("_low"))
        .select("recording", "block", "_low",
                F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    )
    return wanted.join(blocks, ["recording", "block"]).withColumn(
        "line_number", F.expr("_before + pos - _low + 1")).drop("_low", "_before")


# --- strict checks -------------------------------------------------------------------------------
#
# A line is parsed once into a map of variants. ``x_<field>`` holds a field, ``k_<field>`` the name
# of its JSON type; fields of the process object are called ``process_<field>``. The checks are SQL
# over these columns, so none of them parses again.


def _ref(path: str) -> str:
    return path.replace(".", "_")


def _kind(path: str) -> str:
    return f"k_{_ref(path)}"


def _text(path: str) -> str:
    return f"try_variant_get(x_{_ref(path)}, '$', 'string')"


def _number(path: str) -> str:
    return f"try_variant_get(x_{_ref(path)}, '$', 'decimal(38,0)')"


def _is_integer(path: str) -> str:
    kind = _kind(path)
    return f"({kind} = 'BIGINT' OR {kind} RLIKE '^DECIMAL[(](19|[23][0-9]),0[)]')"


def _good_integer(path: str, low: int, high: int) -> str:
    """The usual case compares 64-bit values; only wider numbers become decimals."""
    narrow = f"try_variant_get(x_{_ref(path)}, '$', 'bigint') BETWEEN {max(low, -MAX_I63)} AND {min(high, MAX_I63)}"
    wide = f"({_is_wide(path)} AND {_number(path)} BETWEEN {low}BD AND {high}BD)"
    return f"IF({_kind(path)} = 'BIGINT', {narrow}, {wide})"


def _is_wide(path: str) -> str:
    return f"{_kind(path)} RLIKE '^DECIMAL[(](19|[23][0-9]),0[)]'"


def _good_text(path: str) -> str:
    return f"({_kind(path)} = 'STRING' AND {_text(path)} RLIKE r'\\S')"


def _good_choice(path: str, allowed) -> str:
    return f"({_kind(path)} = 'STRING' AND {_text(path)} IN ({', '.join(map(repr, allowed))}))"


def _missing(path: str) -> str:
    return f"{_kind(path)} IS NULL"


def _optional(path: str, good: str) -> str:
    return f"({_missing(path)} OR {good})"


def _u64(path: str) -> tuple[str, str]:
    return f"{path} is no integer from 0 to 2^64 - 1", _good_integer(path, 0, MAX_U64)


def _optional_u64(path: str) -> tuple[str, str]:
    message, good = _u64(path)
    return message, _optional(path, good)


_VERSION = (
    "schema_version is not the known one",
    f"({_is_integer('schema_version')} AND {_number('schema_version')} = {CONTRACT_VERSION})",
)
_RUN_ID = ("run_id is no text or empty", _good_text("run_id"))
_SEQUENCE = _u64("collector_sequence")
_TIME = _u64("timestamp_ns")
_TID = ("tid is no integer from 1 to 2^32 - 1", _good_integer("tid", 1, MAX_U32))


def _identity(prefix: str) -> list[tuple[str, str]]:
    return [
        ("type of process is not process_identity", _good_choice(f"{prefix}type", ("process_identity",))),
        ("schema_version of process is not the known one",
         f"({_is_integer(f'{prefix}schema_version')} AND {_number(f'{prefix}schema_version')} = {CONTRACT_VERSION})"),
        ("boot_id is no text or empty", _good_text(f"{prefix}boot_id")),
        ("tgid is no integer from 1 to 2^32 - 1", _good_integer(f"{prefix}tgid", 1, MAX_U32)),
        ("start_time_ns is no integer from 0 to 2^64 - 1", _good_integer(f"{prefix}start_time_ns", 0, MAX_U64)),
    ]


_PROCESS_FIELDS = ("type", "schema_version", "boot_id", "tgid", "start_time_ns")
_PROCESS = [
    ("process is no JSON object", f"{_kind('process')} LIKE 'OBJECT%'"),
    *_identity("process."),
    ("process has a field that is not known",
     f"size(array_except(map_keys(process_fields), array({', '.join(map(repr, _PROCESS_FIELDS))}))) = 0"),
]

_LIST = "try_variant_get(x_{0}, '$', 'array<variant>')"
_NAMES = _LIST.format("feature_names")
_VALUES = _LIST.format("values")

# Per record kind: its fields and the conditions a valid record meets, in checking order.
KINDS: dict[str, tuple[tuple[str, ...], list[tuple[str, str]]]] = {
    "process_identity": (_PROCESS_FIELDS, _identity("")),
    "run_start": (
        ("type", "schema_version", "run_id", "capture_start_ns", "source"),
        [_VERSION, _RUN_ID, _u64("capture_start_ns"),
         ("source is not a known one", _good_choice("source", RUN_SOURCES))],
    ),
    "run_end": (
        ("type", "schema_version", "run_id", "collector_sequence", "timestamp_ns", "status",
         "total_lost_events"),
        [_VERSION, _RUN_ID, _SEQUENCE, _TIME,
         ("status is neither complete nor failed", _optional("status", _good_choice("status", END_STATUSES))),
         _optional_u64("total_lost_events")],
    ),
    "event": (
        ("type", "schema_version", "run_id", "collector_sequence", "timestamp_ns", "process", "tid",
         "operation", "result", "filename", "filename_bytes_b64", "telemetry_quality", "lost_events"),
        [_VERSION, _RUN_ID, _SEQUENCE, _TIME, *_PROCESS, _TID,
         ("operation is none of O, C, D", _good_choice("operation", OPERATIONS)),
         ("result is neither null nor a 64-bit integer",
          f"({_missing('result')} OR {_kind('result')} = 'VOID' OR "
          f"{_kind('result')} = 'BIGINT' OR ({_is_wide('result')} AND {_number('result')} BETWEEN {-2**63}BD AND {MAX_I63}BD))"),
         ("filename is no text", _optional("filename", f"{_kind('filename')} = 'STRING'")),
         ("filename_bytes_b64 is not base64",
          f"({_missing('filename_bytes_b64')} OR {_kind('filename_bytes_b64')} = 'VOID' OR "
          f"({_kind('filename_bytes_b64')} = 'STRING' AND {_text('filename_bytes_b64')} RLIKE "
          "'^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$'))"),
         ("telemetry_quality is neither complete nor degraded",
          _optional("telemetry_quality", _good_choice("telemetry_quality", QUALITIES))),
         _optional_u64("lost_events")],
    ),
    "heartbeat": (
        ("type", "schema_version", "run_id", "collector_sequence", "timestamp_ns", "lost_events"),
        [_VERSION, _RUN_ID, _SEQUENCE, _TIME, _optional_u64("lost_events")],
    ),
    "process_exit": (
        ("type", "schema_version", "run_id", "collector_sequence", "timestamp_ns", "process", "tid"),
        [_VERSION, _RUN_ID, _SEQUENCE, _TIME, *_PROCESS, _TID],
    ),
    "feature_window": (
        ("type", "schema_version", "feature_version", "window_id", "run_id", "process", "start_ns",
         "end_ns", "feature_names", "values", "partial", "loss_count", "late_event_count", "quality",
         "complete", "classifiable"),
        [_VERSION,
         ("feature_version is not the known one", _optional("feature_version",
          f"({_is_integer('feature_version')} AND {_number('feature_version')} = {FEATURE_VERSION})")),
         _RUN_ID, *_PROCESS, _u64("start_ns"), _u64("end_ns"),
         ("end_ns is not above start_ns", f"{_number('end_ns')} > {_number('start_ns')}"),
         ("partial is neither true nor false", _optional("partial", f"{_kind('partial')} = 'BOOLEAN'")),
         ("feature_names holds empty or other than text",
          "(k_feature_names IN ('ARRAY<STRING>', 'ARRAY<VOID>') AND NOT array_contains("
          "try_variant_get(x_feature_names, '$', 'array<string>'), ''))"),
         ("feature_names holds a name twice",
          "size(array_distinct(try_variant_get(x_feature_names, '$', 'array<string>'))) = "
          "size(try_variant_get(x_feature_names, '$', 'array<string>'))"),
         ("numbers of feature names and values differ", f"size({_NAMES}) = size({_VALUES})"),
         ("a feature value is no integer from 0 up",
          "(k_values IN ('ARRAY<BIGINT>', 'ARRAY<VOID>') AND "
          "size(array_compact(try_variant_get(x_values, '$', 'array<bigint>'))) = size(try_variant_get("
          "x_values, '$', 'array<bigint>')) AND "
          "coalesce(array_min(try_variant_get(x_values, '$', 'array<bigint>')), 0) >= 0)"),
         _optional_u64("loss_count"), _optional_u64("late_event_count")],
    ),
}

# Values a valid record may hold although a BIGINT column cannot.
_WIDE = ("collector_sequence", "timestamp_ns", "process.start_time_ns", "lost_events",
         "total_lost_events", "capture_start_ns", "start_time_ns", "start_ns", "end_ns")


_FIELDS = sorted({name for fields, _ in KINDS.values() for name in fields})


def _evaluated(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add columns that are computed once per row, however often later steps mention them.

    The optimizer copies an aliased expression into every filter above it, and these are large. It
    does not copy through a generator, so the values pass through one that emits a single row.
    """
    fields = ", ".join(f"'{name}', {text}" for name, text in columns.items())
    return df.selectExpr("*", f"inline(array(named_struct({fields})))")


def _fields(lines: DataFrame, names: list[str]) -> DataFrame:
    """Parse ``value`` and give every field its ``x_`` and ``k_`` column."""
    parsed = _evaluated(lines, {"v": "try_parse_json(value)"})
    opened = _evaluated(parsed, {"fields": "try_variant_get(v, '$', 'map<string,variant>')"})
    found = {f"x_{name}": f"try_element_at(fields, '{name}')" for name in names}
    if "process" in names:
        opened = _evaluated(opened, {
            "process_fields": "try_variant_get(try_element_at(fields, 'process'), '$', 'map<string,variant>')"})
        found |= {f"x_process_{name}": f"try_element_at(process_fields, '{name}')" for name in _PROCESS_FIELDS}
    taken = _evaluated(opened, found)
    return _evaluated(taken, {f"k_{name[2:]}": f"schema_of_variant({name})" for name in found})


def parse_records(lines: DataFrame) -> DataFrame:
    """Parse each line once and list every violated rule in ``violations``."""
    branches = "".join(
        f" WHEN '{kind}' THEN array_remove(array("
        + f"IF(size(array_except(map_keys(fields), array({', '.join(map(repr, fields))}))) > 0,"
        + " 'record has a field that is not known', ''), "
        + ", ".join(f"IF(coalesce({good}, false), '', '{message}')" for message, good in rules)
        + "), '')"
        for kind, (fields, rules) in KINDS.items()
    )
    wide = " OR ".join(f"coalesce({_is_wide(path)} AND {_number(path)} BETWEEN {MAX_I63 + 1}BD AND {MAX_U64}BD, false)" for path in _WIDE)
    too_wide = f"IF({wide}, array('integer needs more than 63 bits'), CAST(array() AS ARRAY<STRING>))"
    violations = (
        "CASE WHEN NOT is_valid_utf8(value) THEN array('invalid UTF-8')"
        r" WHEN NOT value RLIKE r'\S' THEN array('blank JSONL record')"
        " WHEN v IS NULL THEN array('invalid JSON')"
        " WHEN fields IS NULL THEN array('line is no JSON object')"
        f" ELSE concat(coalesce(CASE type{branches} END, array('unknown record type')), {too_wide}) END"
    )
    typed = _evaluated(
        _fields(lines, _FIELDS), {"type": f"IF({_kind('type')} = 'STRING', {_text('type')}, NULL)"})
    return (
        _evaluated(typed, {"violations": violations})
        .drop("v", "fields", "process_fields", *[f"k_{name}" for name in _FIELDS],
              *[f"k_process_{name}" for name in _PROCESS_FIELDS])
    )


def quarantine(parsed: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Rejected lines with file, line number and reasons."""
    rejected = parsed.filter("size(violations) > 0")
    if lines is not None:
        rejected = line_numbers(lines, rejected)
    return rejected.drop(*[name for name in rejected.columns if name.startswith("x_")])


def telemetry_records(parsed: DataFrame) -> DataFrame:
    """Valid run, event, heartbeat and exit records in the flat telemetry shape."""
    def integer(path: str) -> str:
        return f"try_variant_get(x_{_ref(path)}, '$', 'bigint')"

    sources = {
        "recording": "recording", "pos": "pos", "type": "type",
        "boot_id": _text("process.boot_id"), "tgid": integer("process.tgid"),
        "start_time_ns": integer("process.start_time_ns"),
        "filename": f"IF(type = 'event', coalesce({_text('filename')}, ''), NULL)",
        "telemetry_quality": f"IF(type = 'event', coalesce({_text('telemetry_quality')}, 'complete'), NULL)",
        "lost_events": f"IF(type IN ('event', 'heartbeat'), coalesce({integer('lost_events')}, 0L), NULL)",
        "status": f"IF(type = 'run_end', coalesce({_text('status')}, 'complete'), NULL)",
        "total_lost_events": f"IF(type = 'run_end', coalesce({integer('total_lost_events')}, 0L), NULL)",
    }
    numeric = {"bigint": integer, "string": _text}
    valid = parsed.filter("size(violations) = 0 AND type NOT IN ('process_identity', 'feature_window')")
    return valid.selectExpr(*[
        f"{sources.get(field.name) or numeric[field.dataType.simpleString()](field.name)} AS {field.name}"
        for field in TELEMETRY
    ])


def progress_records(parsed: DataFrame) -> DataFrame:
    """What the health of an open run needs of every record; ``bad`` marks records that break the contract."""
    bad = "size(violations) > 0"

    def integer(name: str) -> str:
        return f"IF({bad}, NULL, try_variant_get(x_{name}, '$', 'bigint')) AS {name}"

    return parsed.filter("type IS NULL OR type NOT IN ('process_identity', 'feature_window')").selectExpr(
        f"{_text('run_id')} AS run_id", "type", *[
            integer(n) for n in ("timestamp_ns", "lost_events", "capture_start_ns")], f"{bad} AS bad")


def feature_windows(parsed: DataFrame) -> DataFrame:
    """Feature windows only; ``violations`` also names foreign records and wrong window ids."""
    flat = parsed.selectExpr(
        "recording", "pos", "type", "violations",
        f"{_text('window_id')} AS supplied_id",
        f"{_text('run_id')} AS run_id", f"{_text('process.boot_id')} AS boot_id",
        *[f"try_variant_get(x_{_ref(path)}, '$', 'bigint') AS {path.split('.')[-1]}"
          for path in ("process.tgid", "process.start_time_ns", "start_ns", "end_ns")],
        f"coalesce(try_variant_get(x_feature_version, '$', 'int'), {FEATURE_VERSION}) AS feature_version",
        "try_variant_get(x_feature_names, '$', 'array<string>') AS feature_names",
        "try_variant_get(x_values, '$', 'array<bigint>') AS feature_values",
        "coalesce(try_variant_get(x_partial, '$', 'boolean'), false) AS partial",
        *[f"coalesce(try_variant_get(x_{name}, '$', 'bigint'), 0L) AS {name}"
          for name in ("loss_count", "late_event_count")],
    ).withColumn("window_id", window_id())
    return flat.withColumn("violations", F.expr(
        "CASE WHEN size(violations) > 0 THEN violations"
        " WHEN type <> 'feature_window' THEN array('record is no feature window')"
        " WHEN supplied_id <> window_id THEN array('feature window_id does not match its identity fields')"
        " ELSE violations END"))


def spread_features(windows: DataFrame) -> DataFrame:
    """Name and value arrays in contract order to the 33 feature columns."""
    return windows.filter(F.expr(f"feature_names = array({', '.join(map(repr, FEATURES))})")).selectExpr(
        *[name for name in windows.columns if name not in ("feature_names", "feature_values")],
        *[f"feature_values[{index}] AS {name}" for index, name in enumerate(FEATURES)],
    )


def labeled_rows(lines: DataFrame) -> DataFrame:
    """Labelled rows with ``violations``; blank lines are skipped, fields must match exactly."""
    names = sorted(field.name for field in LABELED_WINDOW)
    number = "(schema_of_variant(x) = 'BIGINT' OR schema_of_variant(x) = 'DOUBLE' OR schema_of_variant(x) LIKE 'DECIMAL%')"
    rules = [
        ("fields are not those of a labelled window",
         f"array_sort(map_keys(fields)) = array({', '.join(map(repr, names))})"),
        ("invalid window ID", f"({_kind('window_id')} = 'STRING' AND length({_text('window_id')}) > 0)"),
        ("invalid capture ID", f"({_kind('capture_id')} = 'STRING' AND length({_text('capture_id')}) > 0)"),
        ("invalid capture hash", f"{_kind('capture_hash')} = 'STRING'"),
        ("invalid split", f"{_kind('split')} = 'STRING'"),
        ("invalid label", _is_integer("label")),
        ("feature_version is no integer", _is_integer("feature_version")),
        ("feature_names holds other than text", f"forall({_NAMES}, x -> schema_of_variant(x) = 'STRING')"),
        ("features holds other than numbers", f"forall({_LIST.format('features')}, x -> {number})"),
        ("invalid row quality", f"({_kind('complete')} = 'BOOLEAN' AND {_kind('quality')} = 'STRING')"),
    ]
    parsed = _fields(lines.filter(r"value RLIKE r'\S'"), names)
    checks = ", ".join(f"IF(coalesce({good}, false), '', '{message}')" for message, good in rules)
    return parsed.selectExpr(
        *lines.columns,
        "CASE WHEN v IS NULL THEN array('invalid JSON')"
        " WHEN fields IS NULL THEN array('row is no JSON object')"
        f" ELSE array_remove(array({checks}), '') END AS violations",
        *[f"try_variant_get(x_{field.name}, '$', '{field.dataType.simpleString()}') AS {field.name}"
          for field in LABELED_WINDOW],
    )


def _object(path: str) -> str:
    return f"{_kind(path)} LIKE 'OBJECT%'"


def _object_or_null(path: str) -> tuple[str, str]:
    return f"{path} is neither an object nor null", f"({_missing(path)} OR {_kind(path)} = 'VOID' OR {_object(path)})"


_COLLECTOR_SHARED = [_VERSION, _RUN_ID, _u64("monotonic_ns")]
# Per record type of a collector: its fields and the conditions a valid line meets.
COLLECTOR_KINDS: dict[str, tuple[tuple[str, ...], list[tuple[str, str]]]] = {
    "event": (
        ("schema_version", "record_type", "run_id", "collector_sequence", "monotonic_ns", "process", "tid", "event_type",
         "attempt", "result", "filename"),
        [*_COLLECTOR_SHARED, _SEQUENCE, ("process is no JSON object", _object("process")), _TID,
         ("event_type is neither syscall nor process_exit", _good_choice("event_type", ("syscall", "process_exit"))),
         *map(_object_or_null, ("attempt", "result", "filename"))],
    ),
    "collector_health": (
        ("schema_version", "record_type", "run_id", "monotonic_ns", "connected", "loss_counters", "loss_total", "telemetry_complete"),
        [*_COLLECTOR_SHARED, ("connected is neither true nor false", f"{_kind('connected')} = 'BOOLEAN'"),
         ("loss_counters is no JSON object", _object("loss_counters")),
         ("telemetry_complete is neither true nor false", f"{_kind('telemetry_complete')} = 'BOOLEAN'")],
    ),
}


def collector_violations(lines: DataFrame) -> DataFrame:
    """Raw collector lines that break their shape, with every violated rule; good lines are left out."""
    names = sorted({name for fields, _ in COLLECTOR_KINDS.values() for name in fields})
    branches = "".join(
        f" WHEN '{kind}' THEN array_remove(array("
        + f"IF(size(array_except(map_keys(fields), array({', '.join(map(repr, fields))}))) > 0, 'record has a field that is not known', ''), "
        + ", ".join(f"IF(coalesce({good}, false), '', '{message}')" for message, good in rules) + "), '')"
        for kind, (fields, rules) in COLLECTOR_KINDS.items())
    violations = (
        r"CASE WHEN NOT is_valid_utf8(value) THEN array('invalid UTF-8') WHEN NOT value RLIKE r'\S' THEN array('blank JSONL record')"
        " WHEN v IS NULL THEN array('invalid JSON') WHEN fields IS NULL THEN array('line is no JSON object')"
        f" ELSE coalesce(CASE {_text('record_type')}{branches} END, array('unknown record type')) END")
    return _evaluated(_fields(lines, names), {"violations": violations}).filter("size(violations) > 0").select(
        "recording", "pos", "violations")


def raw_syscalls(lines: DataFrame) -> DataFrame:
    """Collector event lines; ``collector_violations`` tells of lines of another shape, which give nulls."""
    return lines.select("recording", "pos", F.from_json("value", RAW_SYSCALL).alias("r")).filter(
        "r.record_type = 'event'").select("recording", "pos", "r.*")


def collector_health(lines: DataFrame) -> DataFrame:
    return lines.select("recording", "pos", F.from_json("value", HEALTH).alias("r")).filter(
        "r.record_type = 'collector_health'").select("recording", "pos", "r.*")


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Parsed recordings with violations; see ``telemetry_records`` and ``quarantine``."""
    return parse_records(read_lines(spark, path))
