"""Acceptance of controlled captures against their manifest and plan row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracemill.operators.labelled import tracked_processes
from tracemill.schemas import PROCESS, SECOND_NS

OVERRUN_NS = 2_000_000_000


def tracked_activity(telemetry: DataFrame, manifests: DataFrame) -> DataFrame:
    """Events (failed ones count) and exits of each tracked process."""
    tracked = tracked_processes(manifests)
    seen = telemetry.filter(F.col("type").isin("event", "process_exit")).groupBy("run_id", *PROCESS).agg(
        F.count_if(F.col("type") == "event").alias("_events"),
        F.count_if(F.col("type") == "process_exit").alias("_exits"),
    )
    return tracked.join(seen, ["run_id", *PROCESS], "left").groupBy("run_id").agg(
        F.sum(F.coalesce("_events", F.lit(0))).alias("tracked_event_count"),
        F.count_if(F.coalesce("_exits", F.lit(0)) == 0).alias("missing_exits"),
    )


def accept_captures(
    telemetry: DataFrame, verdicts: DataFrame, manifests: DataFrame, plan: DataFrame,
) -> DataFrame:
    """One row per manifest: counts, times and every broken rule.

    Where both tables have ``plan_sha256``, the digest of a run's own plan, it has to agree like the names do.
    """
    names = ["scenario", "seed", "split", "behavior_label"]
    names += [name for name in ("plan_sha256",) if name in manifests.columns and name in plan.columns]
    planned = plan.select(
        "run_id", "capture_duration_seconds", *[F.col(name).alias(f"_plan_{name}") for name in names])
    joined = (
        manifests.select("run_id", *names)
        .join(planned, "run_id", "left")
        .join(verdicts, "run_id", "left")
        .join(tracked_activity(telemetry, manifests), "run_id", "left")
    )
    agrees = F.lit(True)
    for name in names:
        agrees = agrees & F.col(name).eqNullSafe(F.col(f"_plan_{name}"))
    duration = F.col("capture_end_ns") - F.col("capture_start_ns")
    wanted = (F.col("capture_duration_seconds") * SECOND_NS).cast("bigint")
    rules = [
        ("run is not planned", F.col("capture_duration_seconds").isNotNull()),
        ("manifest and plan differ for this run", agrees),
        ("no recording for this run", F.col("recording").isNotNull()),
        ("recording holds no valid telemetry",
         F.col("event_count") + F.col("heartbeat_count") + F.col("process_exit_count") > 0),
        ("run was not recorded live", F.col("source") == "live"),
        ("recording is shorter or longer than planned",
         (duration >= wanted) & (duration <= wanted + OVERRUN_NS)),
        ("no event of any tracked process", F.col("tracked_event_count") >= 1),
        ("a tracked process has no exit", F.col("missing_exits") == 0),
    ]
    own = F.array_compact(F.array(*[
        F.when(~F.coalesce(good, F.lit(False)), F.lit(message)) for message, good in rules]))
    stream = F.coalesce(F.col("violations"), F.array().cast("array<string>"))
    return joined.select(
        "run_id", "capture_start_ns", "capture_end_ns", duration.alias("duration_ns"),
        F.col("records").alias("record_count"), "event_count", "heartbeat_count", "process_exit_count",
        "tracked_event_count", "total_lost_events", F.concat(own, stream).alias("violations"),
    ).withColumn("status", F.when(F.size("violations") == 0, "accepted").otherwise("rejected"))


def with_file_evidence(
    acceptance: DataFrame, inventory: DataFrame, manifest_files: DataFrame | None = None,
    plan_digest: DataFrame | None = None,
) -> DataFrame:
    """Add size and hash of the raw file, the hash of the run's manifest file and the digest of the plan.

    ``inventory`` and ``manifest_files`` have ``run_id``, ``actual_size``, ``actual_sha256``; ``plan_digest`` is the one
    row of ``labelled.plan_digest``. A file that is missing leaves its columns null.
    """
    evidence = inventory.select(
        "run_id", F.col("actual_sha256").alias("raw_sha256"), F.col("actual_size").alias("raw_bytes"))
    found = acceptance.join(evidence, "run_id", "left")
    if manifest_files is not None:
        found = found.join(manifest_files.select(
            "run_id", F.col("actual_sha256").alias("runtime_manifest_sha256")), "run_id", "left")
    if plan_digest is not None:
        # One row.
        found = found.withColumn("experiment_plan_sha256", F.lit(plan_digest.first()["plan_digest"]))
    return found
