"""Writers: canonical recordings, labelled rows, audit tables and stored results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracemill.functions.json_text import json_string
from tracemill.functions.ordered import BUCKET_ROWS, order_bucket, running
from tracemill.operators import labelled, serving
from tracemill.schemas import CONTRACT_VERSION, FEATURE_VERSION, FEATURES
from tracemill.session import shared_folder, written
from tracemill.sources.commits import VersionedTable, delete, path_exists

RESULT_TABLES = ("windows", "predictions", "alerts")


class ByteBudgetExceeded(RuntimeError):
    """At least one recording does not fit its byte budget."""


def _text(name: str) -> str:
    return json_string(name, ascii_only=False)


def _process() -> str:
    return (
        f"""concat('{{"boot_id":', {_text('boot_id')}, ',"schema_version":{CONTRACT_VERSION},"start_time_ns":',"""
        """ start_time_ns, ',"tgid":', tgid, ',"type":"process_identity"}')"""
    )


def canonical_lines(telemetry: DataFrame) -> DataFrame:
    """Telemetry as compact JSON with sorted keys; adds ``value``."""
    fields = {
        "run_start": {"capture_start_ns": "capture_start_ns", "run_id": _text("run_id"), "source": _text("source")},
        "run_end": {"collector_sequence": "collector_sequence", "run_id": _text("run_id"), "status": _text("status"),
                    "timestamp_ns": "timestamp_ns", "total_lost_events": "total_lost_events"},
        "heartbeat": {"collector_sequence": "collector_sequence", "lost_events": "lost_events",
                      "run_id": _text("run_id"), "timestamp_ns": "timestamp_ns"},
        "process_exit": {"collector_sequence": "collector_sequence", "process": _process(),
                         "run_id": _text("run_id"), "tid": "tid", "timestamp_ns": "timestamp_ns"},
        "event": {"collector_sequence": "collector_sequence", "filename": _text("filename"),
                  "filename_bytes_b64": f"coalesce({_text('filename_bytes_b64')}, 'null')",
                  "lost_events": "lost_events", "operation": _text("operation"), "process": _process(),
                  "result": "coalesce(CAST(result AS STRING), 'null')", "run_id": _text("run_id"),
                  "telemetry_quality": _text("telemetry_quality"), "tid": "tid", "timestamp_ns": "timestamp_ns"},
    }
    branches = []
    for kind, parts in fields.items():
        parts = {**parts, "schema_version": f"'{CONTRACT_VERSION}'", "type": f"'\"{kind}\"'"}
        body = ", ',', ".join(f"'\"{name}\":', {parts[name]}" for name in sorted(parts))
        branches.append(f"WHEN '{kind}' THEN concat('{{', {body}, '}}')")
    return telemetry.withColumn("value", F.expr(f"CASE type {' '.join(branches)} END"))


def byte_budget(
    lines: DataFrame, keys: list[str], max_bytes: int, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Add ``written_bytes`` and ``kept``: whether a line still fits the budget of its recording.

    Whole lines are written until the first that would exceed the budget.
    """
    if type(max_bytes) is not int or max_bytes < 0:
        raise ValueError("max_bytes must be a non-negative integer")
    ranged = lines.withColumn("_range", order_bucket("pos", bucket_rows))
    summed = running(ranged, keys, [F.col("pos")], ["_range"],
                     {"written_bytes": ("sum", F.octet_length("value") + 1)})
    return summed.drop("_range").withColumn("kept", F.col("written_bytes") <= max_bytes)


def write_recordings(
    telemetry: DataFrame, path: str, *, max_bytes: int | None = None, mode: str = "errorifexists"
) -> None:
    """One folder of JSON Lines per recording, rows in arrival order inside each file.

    Range partitioning by (recording, position) splits a large recording over several ordered
    files. With a budget the complete lines that fit are written, then an error is raised.
    """
    lines = canonical_lines(telemetry).select("recording", "pos", "value")
    cut = False
    if max_bytes is not None:
        lines = byte_budget(lines, ["recording"], max_bytes)
        cut = not lines.filter(~F.col("kept")).isEmpty()
        lines = lines.filter("kept")
    ordered = lines.repartitionByRange("recording", "pos").sortWithinPartitions("recording", "pos")
    ordered.select("recording", "value").write.partitionBy("recording").mode(mode).text(path)
    if cut:
        raise ByteBudgetExceeded(f"recording byte budget exceeded: limit={max_bytes}")


def write_labelled_rows(rows: DataFrame, path: str) -> None:
    """Canonical JSON Lines; refuses to overwrite."""
    rows.select(labelled.row_json().alias("value")).write.mode("errorifexists").text(path)


def assemble_dataset(rows: DataFrame, plan: DataFrame, path: str) -> None:
    """Write all roles and the manifest to a new folder, check what was written, publish it once.

    The input is read once; rows that break a rule leave nothing behind. Of several writers one publishes.
    """
    spark = rows.sparkSession
    table = VersionedTable(path)

    def write(folder: str) -> None:
        labelled.role_projection(rows).write.partitionBy("role").parquet(f"{folder}/rows")
        stored = spark.read.parquet(f"{folder}/rows").filter("role = 'all'").drop("role")
        for check in (labelled.row_violations(stored), labelled.capture_consistency(stored, plan),
                      labelled.leakage_violations(stored),
                      labelled.set_completeness(plan, stored.select(F.col("capture_id").alias("run_id")))):
            problem = check.first()
            if problem is not None:
                delete(spark, folder)
                raise ValueError(f"dataset is not acceptable: {problem.asDict()}")
        captures = labelled.capture_summary(stored).join(
            labelled.content_digest(stored, ["capture_id"]).select(F.col("capture_id").alias("run_id"), "content_digest"),
            "run_id")
        captures.write.parquet(f"{folder}/captures")
        labelled.role_totals(stored).write.parquet(f"{folder}/roles")
        labelled.digest_tree(stored, ["capture_id"]).write.parquet(f"{folder}/tree")
        plan.write.parquet(f"{folder}/plan")
        labelled.plan_digest(spark.read.parquet(f"{folder}/plan")).withColumns({
            "feature_version": F.lit(FEATURE_VERSION), "feature_names": F.array(*map(F.lit, FEATURES)),
            "n_captures": F.lit(spark.read.parquet(f"{folder}/captures").count()).cast("bigint")}).write.parquet(f"{folder}/bound")

    table.publish_once(spark, write)


def load_dataset(spark: SparkSession, path: str, role: str) -> DataFrame:
    """Rows of one role, only if they match the manifest written beside them."""
    if role not in labelled.ROLES:
        raise ValueError("role is none of all, selection, test")
    folder = VersionedTable(path).published(spark)
    rows = spark.read.schema(
        spark.read.parquet(f"{folder}/rows").schema).parquet(f"{folder}/rows").filter(F.col("role") == role).drop("role")
    parts = {name: spark.read.parquet(f"{folder}/{name}") for name in ("captures", "roles", "plan", "bound")}
    if role == "all":
        problem = labelled.dataset_contract(rows, **parts).first()
    else:
        problem = labelled.manifest_differences(rows, labelled.role_rows(parts["captures"], role)).first()
    if problem is not None:
        raise ValueError(f"dataset does not match its manifest: {problem.asDict()}")
    return rows


def dataset_changes(spark: SparkSession, before: str, after: str) -> DataFrame:
    """Where two published datasets differ, from their digest trees alone; no rows are read."""
    trees = [spark.read.parquet(f"{VersionedTable(p).published(spark)}/tree") for p in (before, after)]
    return labelled.tree_differences(*trees, ["capture_id"])


def write_capture_acceptance(acceptance: DataFrame, path: str) -> None:
    """Add accepted captures; a run that is stored already is an error, also with several writers at once."""
    VersionedTable(path).append_unique(acceptance.filter("status = 'accepted'"), "run_id", "capture acceptance")


def read_capture_acceptance(spark: SparkSession, path: str) -> DataFrame | None:
    return VersionedTable(path).read(spark)


def write_differences(differences: DataFrame, path: str) -> None:
    """Differences as CSV, sorted over all files so that equal inputs give equal rows."""
    order = ["split", "kind", "pid", "feature"]
    differences.select(*order, "supplied", "reconstructed").orderBy(*order).write.mode(
        "errorifexists").csv(path, header=True, nullValue="", emptyValue="")


def write_audit_report(verdict: DataFrame, path: str) -> None:
    verdict.write.mode("errorifexists").json(path)


def publish_runs(
    runs: DataFrame, windows: DataFrame, predictions: DataFrame, path: str
) -> None:
    """Replace everything derived from the given runs and leave other runs alone.

    Windows, predictions and alerts are checked before anything is written. They go to folders of
    a new version; the run row, written last, names the version that readers follow. Whatever an
    older version held (alerts below a raised threshold, windows that are gone) is out of sight.
    """
    spark = runs.sparkSession
    alerts = alert_rows(windows, predictions)
    problem = serving.integrity_violations(runs, windows, predictions, alerts).first()
    if problem is not None:
        raise ValueError(f"results are inconsistent: {problem.asDict()}")
    version = uuid.uuid4().hex
    for name, table in (("windows", windows), ("predictions", predictions), ("alerts", alerts)):
        named = table.withColumn("version", F.lit(version))
        # An empty table has no files to tell its columns.
        named.limit(0).write.mode("overwrite").parquet(f"{path}/_schemas/{name}")
        named.hint("rebalance", "run_id").write.mode("append").partitionBy("run_id", "version").parquet(f"{path}/{name}")
    _replace(runs.withColumn("version", F.lit(version)), f"{path}/runs")
    for name in RESULT_TABLES:
        spark.catalog.refreshByPath(f"{path}/{name}")


def withdraw_runs(refused: DataFrame, path: str) -> None:
    """Take published runs out of sight of readers; runs that were never published stay unknown."""
    spark = refused.sparkSession
    if not path_exists(spark, f"{path}/runs"):
        return
    # The schema is given, since a first publication may have been empty.
    shape = "source string, started_ns bigint, status string, version string, run_id string"
    stored = spark.read.schema(shape).parquet(f"{path}/runs").filter("status = 'complete'").join(
        refused.select("run_id").distinct(), "run_id", "left_semi")
    # A partition cannot be replaced while it is read; there is one row per run.
    _replace(written(stored.withColumn("status", F.lit("withdrawn")), "withdrawn"), f"{path}/runs")
    spark.catalog.refreshByPath(f"{path}/runs")


def _replace(table: DataFrame, path: str) -> None:
    """Replace the run partitions a table holds; a large run is spread over several tasks."""
    table.hint("rebalance", "run_id").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def alert_rows(windows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Alerts of positive predictions. The id grows with window order inside a run."""
    positive = predictions.filter("suspicious").select("window_id", "score", "supporting_features")
    return windows.join(positive, "window_id").select(
        F.expr("concat(lpad(CAST(start_ns AS STRING), 20, '0'), '-', boot_id, '-', lpad(CAST(tgid AS STRING), 10, '0'),"
               " '-', lpad(CAST(start_time_ns AS STRING), 20, '0'))").alias("alert_id"),
        "window_id", "run_id", "boot_id", "tgid", "start_time_ns", "score", "supporting_features",
        F.lit(True).alias("valid"))


def read_results(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table, limited to runs whose publication completed."""
    complete = spark.read.parquet(f"{path}/runs").filter("status = 'complete'")
    if name == "runs":
        return complete.drop("version")
    shape = spark.read.parquet(f"{path}/_schemas/{name}").schema
    return spark.read.schema(shape).parquet(f"{path}/{name}").join(
        complete.select("run_id", "version"), ["run_id", "version"], "left_semi").drop("version")


def upsert(changes: DataFrame, path: str, keys: list[str]) -> None:
    """Merge newer versions into a stored table partitioned by ``run_id``.

    Only the touched run partitions are read and replaced, through a written table, because a
    partition cannot be overwritten while it is read.
    """
    spark = changes.sparkSession
    newest = changes
    if path_exists(spark, path):
        touched = changes.select("run_id").distinct()
        newest = changes.unionByName(
            spark.read.parquet(path).join(touched, "run_id", "left_semi"), allowMissingColumns=True)
    keyed = ["run_id", *[key for key in keys if key != "run_id"]]
    merged = shared_folder(spark, "merge")
    serving.latest(newest, keyed).write.parquet(merged)
    _replace(spark.read.parquet(merged), path)
    spark.catalog.refreshByPath(path)
