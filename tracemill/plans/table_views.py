"""Telemetry, capture and labelled-row views over the given benchmark tables.

The tables hold no system calls, so each view maps whole tables onto a record shape of the
engine: a user becomes a process, an event type an operation, a document a labelled window.
Windows are one day and burst buckets one hour, because the tables cover thirty days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tracemill.operators import labelled
from tracemill.schemas import TELEMETRY
from tracemill.sources.tables import CAPTURE_COLUMNS

DAY_NS = 86_400_000_000_000
HOUR_NS = 3_600_000_000_000
RUNS = 20


# Rows of a narrow table that one task reads; a file of a few megabytes may hold millions.
TASK_ROWS = 1 << 17
_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its file footer is read for the schema once per path."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores is dealt to all cores, where work per row is dear; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < min(cores, 8) else df


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows in tasks of about TASK_ROWS, placed by the hash of ``keys``; a small table stays as it is."""
    tasks = -(-df.count() // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > 1 else df


def micros_since_2024(column: str = "ts") -> Column:
    """Microseconds since the start of 2024, independent of the session time zone."""
    return F.expr(
        f"(unix_date(CAST({column} AS DATE)) - unix_date(DATE'2024-01-01')) * 86400000000L"
        f" + (hour({column}) * 3600 + minute({column}) * 60) * 1000000L"
        f" + CAST(extract(SECOND FROM {column}) * 1000000 AS BIGINT)"
    )


def _fill(df: DataFrame) -> DataFrame:
    """Complete the telemetry schema with nulls and order its columns."""
    present = set(df.columns)
    return df.selectExpr(*[
        f"CAST({field.name if field.name in present else 'NULL'} AS {field.dataType.simpleString()}) AS {field.name}"
        for field in TELEMETRY
    ])


def _operation() -> Column:
    kind = F.col("event_type")
    return F.when(kind == "purchase", "C").when(kind == "signup", "D").otherwise("O")


def telemetry(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """All events as five runs, the first with six tenths of the users. Every 17th record arrives 400 records late; every 97th is an exit.

    Every 211th record reports a loss on every fifth day.
    """
    number = F.col("event_id")
    moved = number % 17 == 0
    is_exit = number % 97 == 0
    run = F.expr("CAST(IF(user_id % 10 < 6, 0, user_id % 10 - 5) AS STRING)")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    events = _dealt(table(spark, sf_dir, "events"), "event_id", "user_id", "ts") if events is None else events
    return _fill(events.select(
        F.concat(F.lit("rec-"), run).alias("recording"),
        F.concat(F.lit("run-"), run).alias("run_id"),
        (2 * (number + F.when(moved, 400).otherwise(0)) + F.when(moved, 0).otherwise(1)).alias("pos"),
        F.when(is_exit, "process_exit").otherwise("event").alias("type"),
        number.alias("collector_sequence"),
        (micros_since_2024() * 1000).alias("timestamp_ns"),
        F.lit("b0").alias("boot_id"),
        F.col("user_id").alias("tgid"),
        F.lit(0).alias("start_time_ns"),
        (F.col("user_id") + 1).alias("tid"),
        F.when(~is_exit, _operation()).alias("operation"),
        F.when(~is_exit, F.when(F.col("event_type") == "error", -1).otherwise(0)).alias("result"),
        F.when(~is_exit, F.when((number % 211 == 0) & (day % 5 == 0), 3).otherwise(0)).alias("lost_events"),
        F.when(~is_exit, F.lit("complete")).alias("telemetry_quality"),
    ))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    shape = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def envelope_records(bounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Run start and run end records of given run bounds."""
    return (
        _fill(bounds.select("run_id", "capture_start_ns", F.lit("run_start").alias("type"))),
        _fill(bounds.select("run_id", F.col("capture_end_ns").alias("timestamp_ns"), F.lit("run_end").alias("type"))),
    )


def run_bounds(records: DataFrame) -> DataFrame:
    return records.groupBy("run_id").agg(
        F.lit(0).cast("bigint").alias("capture_start_ns"),
        F.max("timestamp_ns").alias("capture_end_ns"),
    )


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty recordings with start and end records; most break one rule of the stream contract."""
    number = F.col("event_id")
    slot = number % RUNS
    sequence = F.floor(number / RUNS) + 1
    is_beat = F.floor(number / RUNS) % 10 == 3
    is_exit = ~is_beat & (number % 97 == 0)
    is_event = ~is_beat & ~is_exit
    wrong_run = (slot == 4) & (sequence == 5)
    body = table(spark, sf_dir, "events").select(
        F.concat(F.lit("rec-"), slot).alias("recording"),
        F.when(wrong_run, "run-other").otherwise(F.concat(F.lit("run-"), slot)).alias("run_id"),
        sequence.alias("pos"),
        F.when(is_beat, "heartbeat").when(is_exit, "process_exit").otherwise("event").alias("type"),
        (sequence + F.when((slot == 1) & (sequence > 7), 1).otherwise(0)).alias("collector_sequence"),
        (micros_since_2024() * 1000).alias("timestamp_ns"),
        F.when(~is_beat, "b0").alias("boot_id"),
        F.when(~is_beat, F.col("user_id")).alias("tgid"),
        F.when(~is_beat, 0).alias("start_time_ns"),
        F.when(~is_beat, F.col("user_id") + 1).alias("tid"),
        F.when(is_event, _operation()).alias("operation"),
        F.when(is_event, F.concat(F.lit("f"), sequence)).alias("filename"),
        F.when(is_event & ~((slot == 2) & (number % 5 == 2) & (sequence % 3 == 0)),
               F.when(F.col("event_type") == "error", -1).otherwise(0)).alias("result"),
        F.when(is_event, F.when((slot == 3) & (sequence % 11 == 0), "degraded")
               .otherwise("complete")).alias("telemetry_quality"),
        F.when(is_exit, None).otherwise(F.when((slot == 5) & (sequence == 4), 2).otherwise(0)).alias("lost_events"),
    )
    ends = body.groupBy("recording").agg(
        F.max("pos").alias("_n"), F.max("timestamp_ns").alias("_end"), F.sum("lost_events").alias("_lost"))
    index = F.regexp_replace("recording", "rec-", "").cast("int")
    starts = ends.filter(index != 6).select(
        "recording", F.regexp_replace("recording", "rec", "run").alias("run_id"),
        F.lit(0).alias("pos"), F.lit("run_start").alias("type"),
        F.lit(0).alias("capture_start_ns"),
        F.when(index == 7, "replay").otherwise("live").alias("source"),
    )
    closes = ends.filter(index != 8).select(
        "recording", F.regexp_replace("recording", "rec", "run").alias("run_id"),
        (F.col("_n") + 1).alias("pos"), F.lit("run_end").alias("type"),
        (F.col("_n") + F.when(index == 1, 2).otherwise(1)).alias("collector_sequence"),
        (F.col("_end") - F.when(index == 9, 1).otherwise(0)).alias("timestamp_ns"),
        F.when(index == 10, "failed").otherwise("complete").alias("status"),
        (F.col("_lost") + F.when(index == 11, 1).otherwise(0)).alias("total_lost_events"),
    )
    return _fill(body).unionByName(_fill(starts)).unionByName(_fill(closes))


def contract_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON text lines; multiples of some primes carry one defect each."""
    pieces = [
        """'{"type":"event","schema_version":1,"run_id":"run-'""", "event_id % 5",
        """'","collector_sequence":'""", "event_id", """',"timestamp_ns":'""", "us * 1000",
        """',"process":{"type":"process_identity","schema_version":1,"boot_id":"'""",
        "IF(event_id % 31 = 0, ' ', 'b0')",
        """'","tgid":'""", "IF(event_id % 37 = 0, 'true', CAST(user_id + 1 AS STRING))",
        """',"start_time_ns":'""", "IF(event_id % 41 = 0, '18446744073709551616', '0')",
        """'},"tid":'""", "IF(event_id % 43 = 0, '4294967296', '7')",
        """',"operation":"'""", "IF(event_id % 47 = 0, 'X', 'O')",
        """'","result":'""", "CASE WHEN event_id % 53 = 0 THEN '1.5' WHEN event_id % 3 = 0 THEN 'null' ELSE '0' END",
        """',"filename":"f'""", "event_id",
        """'","filename_bytes_b64":'""",
        """CASE WHEN event_id % 59 = 0 THEN '"!!"' WHEN event_id % 2 = 0 THEN '"YWI="' ELSE 'null' END""",
        """',"telemetry_quality":"complete","lost_events":'""", "IF(event_id % 61 = 0, '-1', '0')",
        """IF(event_id % 67 = 0, ',"extra":1', '')""", "'}'",
    ]
    whole = f"concat({', '.join(pieces)})"
    return _spread(table(spark, sf_dir, "events")).withColumn("us", micros_since_2024()).selectExpr(
        "concat('file-', event_id % 3) AS recording", "CAST(0 AS BIGINT) AS block", "event_id AS pos",
        f"CASE WHEN event_id % 73 = 0 THEN '  ' WHEN event_id % 71 = 0 THEN substring({whole}, 1, 40)"
        f" ELSE {whole} END AS value")


def captures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Capture manifest and events: seven captures in two splits, one manifest row without events."""
    number = F.col("event_id")
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("cap-0"), F.when(number % 8 == 2, 3).otherwise(number % 8)).alias("capture_id"),
        number.alias("row"),
        (micros_since_2024() * 1000).alias("ts"),
        (F.col("user_id") + F.when(number % 11 == 0, 10_000).otherwise(0)).alias("pid"),
        F.when(F.col("event_type") == "view", "O").when(F.col("event_type") == "click", "C")
        .when(F.col("event_type") == "purchase", "D").otherwise("E").alias("kind"),
        F.expr("CAST(get_json_object(props, '$.k') AS BIGINT) - 30").alias("pattern"),
    )
    names = table(spark, sf_dir, "events").select((number % 8).alias("_slot")).distinct().select(
        F.concat(F.lit("cap-0"), "_slot").alias("capture_id"),
        F.concat(F.lit("logs/cap-0"), "_slot", F.lit(".csv")).alias("path"),
        F.when(F.col("_slot") < 4, "training").otherwise("testing").alias("split"))
    return names, events


def numbered_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from tracemill.operators.audit import number_captures

    manifest, events = captures(spark, sf_dir)
    numbered = number_captures(manifest)
    return numbered, events.join(numbered.select("capture_id", "split", "capture_index"), "capture_id")


def labelled_rows(spark: SparkSession, sf_dir: str, clean: bool = False) -> DataFrame:
    """Labelled documents as training rows.

    The clean form keeps one label, split and hash per capture. The other form breaks every
    dependency somewhere.
    """
    features = (
        "transform(sequence(0, 32), i -> CAST(CASE i WHEN 1 THEN n_chars % 60 + 30 * quality"
        " WHEN 2 THEN doc_id % 17 ELSE (n_chars * (i + 1) + doc_id) % 50 END AS DOUBLE))"
    )
    capture = "concat('cap-', quality, '-', doc_id % 20)" if clean else "concat('cap-', doc_id % 40)"
    slot = "doc_id % 20 * 2" if clean else "doc_id % 40"
    split = f"CASE WHEN {slot} < 24 THEN 'training' WHEN {slot} < 32 THEN 'validation' ELSE 'test' END"
    digest = f"sha2({capture}, 256)"
    window = "sha2(CAST(doc_id AS STRING), 256)"
    if not clean:
        split = f"IF(doc_id % 70 = 3, 'test', {split})"
        digest = f"CASE WHEN doc_id % 50 = 7 THEN sha2('cap-1', 256) WHEN doc_id % 90 = 4 THEN 'short' ELSE {digest} END"
        window = "sha2(CAST(IF(doc_id % 9 = 1, doc_id - 1, doc_id) AS STRING), 256)"
    from tracemill.schemas import FEATURES

    return table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id"
    ).selectExpr(
        "doc_id", f"{window} AS window_id", f"{capture} AS capture_id", f"{digest} AS capture_hash",
        f"{split} AS split", "CAST(quality AS INT) AS label", "2 AS feature_version",
        f"array({', '.join(map(repr, FEATURES))}) AS feature_names", f"{features} AS features",
        "true AS complete", f"{'' if clean else 'IF(doc_id % 33 = 5, ' + repr('bad') + ', '}'good'{'' if clean else ')'} AS quality",
    )


def document_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files: a manifest with recorded hashes and the inventory found on disk."""
    digest = "sha2(text, 256)"
    documents = table(spark, sf_dir, "documents")
    manifest = documents.filter("doc_id % 19 <> 3").selectExpr(
        "concat('logs/', doc_id, '.csv') AS path",
        f"IF(doc_id % 13 = 0, sha2('changed', 256), {digest}) AS sha256",
        "CAST(octet_length(text) + IF(doc_id % 29 = 0, 1, 0) AS BIGINT) AS size",
        "'capture' AS kind", "concat('doc-', doc_id) AS capture_id",
        "IF(doc_id % 2 = 0, 'training', 'testing') AS split",
        f"IF(doc_id % 26 = 0, {digest}, NULL) AS git_blob_sha256",
        "CAST(octet_length(text) AS BIGINT) AS git_blob_size")
    inventory = documents.filter("doc_id % 17 <> 5").selectExpr(
        "concat('logs/', doc_id, '.csv') AS path", "CAST(octet_length(text) AS BIGINT) AS actual_size",
        f"{digest} AS actual_sha256")
    return manifest, inventory


def raw_syscalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw collector records; some break the shape rules."""
    return table(spark, sf_dir, "events").withColumn("us", micros_since_2024()).selectExpr(
        "concat('rec-', user_id % 5) AS recording", "event_id AS pos",
        "CASE WHEN event_id % 83 = 0 THEN '' WHEN event_id % 79 = 0 THEN '-bad' ELSE concat('run-', user_id % 5) END AS run_id",
        "event_id + 1 AS collector_sequence", "us * 1000 AS monotonic_ns",
        "named_struct('boot_id', 'b0', 'tgid', user_id + 1, 'start_time_ns', 0L) AS process", "user_id + 1 AS tid",
        "IF(event_id % 97 = 0, 'process_exit', 'syscall') AS event_type",
        "CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'openat' WHEN 'purchase' THEN 'openat'"
        " WHEN 'signup' THEN IF(event_id % 2 = 0, 'unlink', 'unlinkat') ELSE IF(event_id % 5 = 0, 'rename', 'open') END AS name",
        "CAST((event_id * 37) % 256 AS BIGINT) AS flags",
        "IF(event_type = 'error', -2L, event_id % 10) AS return_value", "event_id", "props",
    ).withColumn("attempt", F.expr(
        "IF(event_type = 'syscall' OR event_id % 194 = 0, named_struct('name', name, 'create_intent',"
        " name IN ('open', 'openat') AND (flags & 64) <> 0), NULL)")
    ).withColumn("result", F.expr(
        "IF(event_type = 'syscall' AND event_id % 89 <> 0, named_struct('return_value', return_value,"
        " 'succeeded', return_value >= 0), NULL)")
    ).withColumn("filename", F.expr(
        "IF(event_type = 'syscall', named_struct('raw_base64', base64(CAST(props AS BINARY)), 'display', props,"
        " 'truncated', false), NULL)"))


def loss_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative loss snapshots per user run; one counter sometimes falls."""
    from tracemill.schemas import COUNTERS

    return table(spark, sf_dir, "events").selectExpr(
        "concat('run-', user_id % 5) AS run_id", "event_id AS pos",
        *[f"CAST(IF(event_id % 501 = 0 AND {index} = 2, 0, event_id div {7 + 4 * index}) AS BIGINT) AS {name}"
          for index, name in enumerate(COUNTERS)])


def capture_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Manifests and plan rows for the twenty recordings; some disagree on purpose."""
    slots = table(spark, sf_dir, "events").groupBy(F.expr(f"event_id % {RUNS}").alias("slot")).agg(
        F.min(F.expr(f"IF((event_id div {RUNS}) % 10 <> 3 AND event_id % 97 = 0, user_id, NULL)")).alias("_exiting"),
        F.max("user_id").alias("_last"), F.max(micros_since_2024()).alias("_us"))
    tracked = "named_struct('boot_id', 'b0', 'tgid', IF(slot = 12, -5, coalesce(_exiting, _last)), 'start_time_ns', 0L)"
    manifests = slots.selectExpr(
        "concat('run-', slot) AS run_id", "'copying' AS scenario", "11L AS seed",
        "IF(slot = 13, 'test', 'training') AS split", "'benign' AS behavior_label", f"array({tracked}) AS tracked_processes")
    plan = slots.filter("slot <> 14").selectExpr(
        "concat('run-', slot) AS run_id", "'copying' AS scenario", "11L AS seed", "'training' AS split",
        "'benign' AS behavior_label", "IF(slot = 15, 60D, CAST(_us div 1000000 - 1 AS DOUBLE)) AS capture_duration_seconds")
    return manifests, plan


def workload_manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A run manifest per document and the plan's digests; every rule is broken by some of them."""
    names = ", ".join(repr(name) for name in labelled.SCENARIOS)
    limits = ", ".join(f"'{name}', {value}" for name, value in labelled.LIMITS.items())
    tracked = ("named_struct('boot_id', IF(doc_id % 89 = 15, ' ', 'b0'), 'tgid', IF(doc_id % 83 = 14, 0L, doc_id + 1),"
               " 'start_time_ns', 0L)")
    manifests = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"element_at(array({names}, 'unplanned'), CAST(doc_id % 9 AS INT) + 1) AS scenario",
        "IF(doc_id % 37 = 2, NULL, element_at(array(11, 23, 37, 41, 53, 77), CAST(doc_id % 6 AS INT) + 1)) AS seed",
    ).selectExpr(
        "*", "IF(doc_id % 31 = 1, 2, 1) AS schema_version",
        "CASE WHEN doc_id % 29 = 3 THEN 'other' WHEN doc_id % 43 = 4 THEN ''"
        " ELSE concat('controlled-', scenario, '-seed-', seed) END AS run_id",
        "CASE WHEN doc_id % 41 = 5 THEN 'test' ELSE element_at(array('training', 'training', 'training',"
        " 'validation', 'test', 'later'), CAST(doc_id % 6 AS INT) + 1) END AS split",
        "CASE WHEN doc_id % 47 = 6 THEN 'odd' WHEN doc_id % 9 BETWEEN 5 AND 7 THEN 'suspicious' ELSE 'benign' END"
        " AS behavior_label",
        "IF(doc_id % 53 = 7, 'guess', 'controlled_workload') AS label_provenance",
        "IF(doc_id % 59 = 8, 'failed', 'completed') AS status",
        "IF(doc_id % 61 = 9, 49D, 50D) AS workload_hold_seconds",
        "IF(doc_id % 67 = 10, NULL, 'unlabeled') AS background_activity",
        "IF(doc_id % 71 = 11, 'tree', 'root_process_only') AS process_scope_policy",
        f"IF(doc_id % 73 = 12, NULL, named_struct({limits})) AS limits",
        f"IF(doc_id % 79 = 13, array({tracked}, {tracked}), array({tracked})) AS tracked_processes",
    ).withColumn("plan_sha256", F.expr("IF(doc_id % 97 = 16, sha2('changed', 256), sha2(run_id, 256))"))
    plan = manifests.filter("run_id <> 'other'").select("run_id").distinct().select(
        "run_id", F.sha2("run_id", 256).alias("plan_sha256"))
    return manifests, plan


def timed_loss_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss snapshots with the time they were taken at."""
    times = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pos"), (micros_since_2024() * 1000).alias("timestamp_ns"))
    return loss_counters(spark, sf_dir).join(times, "pos")


def _csv_lines(rows: DataFrame, header: Column, broken_header: Column, number: str) -> DataFrame:
    """Physical lines of CSV files from ``(path, text)`` rows numbered by ``number``; the header is line 0."""
    body = rows.select(F.col("path").alias("recording"), F.col(number), F.posexplode(F.split("text", "\n")).alias("k", "value")).select(
        "recording", (F.lit(8) * (F.col(number) + 1) + F.col("k")).alias("pos"), "value")
    heads = rows.select("path").distinct().select(
        F.col("path").alias("recording"), F.lit(0).cast("bigint").alias("pos"),
        F.when(F.col("path").endswith("last.csv"), broken_header).otherwise(header).alias("value"))
    return heads.unionByName(body)


def capture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six capture files of all events; half of the names need quotes, a quarter hold a line break, some rows are broken."""
    n = F.col("event_id")
    kind = F.expr("CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 3 ELSE 0 END")
    name = F.expr("CASE event_id % 4 WHEN 0 THEN concat('f', event_id) WHEN 1 THEN concat('\"a,', event_id, '\"')"
                  " WHEN 2 THEN concat('\"say \"\"x\"\" ', event_id, '\"') ELSE concat('\"two\\nlines ', event_id, '\"') END")
    zero = F.lit("0")
    cells = [(micros_since_2024() * 1000).cast("string"), F.when(n % 107 == 0, "x").otherwise(F.col("user_id").cast("string")),
             F.when(n % 103 == 0, "7").otherwise(kind.cast("string")), zero, (n % 5).cast("string"), zero, zero, zero, zero]
    text = (F.when(n % 109 == 0, "").when(n % 113 == 0, F.concat_ws(",", *cells, F.lit('"a"b')))
            .when(n % 101 == 0, F.concat_ws(",", *cells)).otherwise(F.concat_ws(",", *cells, name)))
    path = F.concat(F.lit("capture-"), F.when(n % 6 == 5, "last").otherwise((n % 6).cast("string")), F.lit(".csv"))
    header = ",".join(CAPTURE_COLUMNS)
    return _csv_lines(table(spark, sf_dir, "events").select("event_id", path.alias("path"), text.alias("text")),
                      F.lit(header), F.lit(header.lower()), "event_id")


def feature_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four wide feature files of all customers, with fractions, rows too wide, blank rows and repeated ids."""
    n = F.col("c_custkey")
    pid = F.when(n % 17 == 0, "17").otherwise(n.cast("string"))
    cells = [pid, (n % 7).cast("string"), F.when(n % 11 == 0, "1.5").otherwise((n % 5).cast("string")), F.lit("2.0")]
    text = F.when(n % 19 == 0, "").when(n % 13 == 0, F.concat_ws(",", *cells, F.lit("9"))).otherwise(F.concat_ws(",", *cells))
    path = F.concat(F.lit("features-"), F.when(n % 4 == 3, "last").otherwise((n % 4).cast("string")), F.lit(".csv"))
    return _csv_lines(table(spark, sf_dir, "customer").select(n, path.alias("path"), text.alias("text")),
                      F.lit("PID,C_max,C_sum,OOO"), F.lit("PID,C_max,C_sum,oox"), "c_custkey")


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three label files of all suppliers, with words for numbers, blank rows and repeated ids."""
    n = F.col("s_suppkey")
    text = (F.when(n % 13 == 0, "").when(n % 7 == 0, "abc").when(n % 11 == 0, "11")
            .when(n % 5 == 0, F.concat(F.lit('"'), n, F.lit('"'))).otherwise(F.concat(n, F.lit(".0"))))
    path = F.concat(F.lit("labels-"), F.when(n % 3 == 2, "last").otherwise((n % 3).cast("string")), F.lit(".csv"))
    return _csv_lines(table(spark, sf_dir, "supplier").select(n, path.alias("path"), text.alias("text")),
                      F.lit("PID"), F.lit("PID,PID"), "s_suppkey")


def collector_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as raw collector lines, some of them damaged."""
    raw = raw_syscalls(spark, sf_dir).withColumns({"schema_version": F.lit(1), "record_type": F.expr("IF(event_id % 41 = 0, 'other', 'event')")})
    names = ["schema_version", "record_type", "run_id", "collector_sequence", "monotonic_ns", "process", "tid", "event_type",
             "attempt", "result", "filename"]
    text = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    n = F.col("event_id")
    damaged = (F.when(n % 31 == 0, F.substring(text, 1, 40)).when(n % 37 == 0, "[]").when(n % 53 == 0, " ")
               .when(n % 43 == 0, F.concat(F.expr("substring(text, 1, length(text) - 1)"), F.lit(',"extra":1}')))
               .when(n % 47 == 0, F.regexp_replace("text", '"tid":[0-9]+', '"tid":"x"')).otherwise(F.col("text")))
    return raw.withColumn("text", text).select("recording", "pos", damaged.alias("value"))
