"""Audit of a published corpus: inventory, rebuilt features and their differences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracemill.operators import audit
from tracemill.session import written
from tracemill.sources import sinks, tables
from tracemill.sources.split_csv import empty_files, read_csv_tree

# Label matches and listed labels of the published corpus.
EXPECTED_MATCHES = {"training": (14, 32), "testing": (21, 21)}


MISSING = "file is not available"


@dataclass(frozen=True)
class AuditReport:
    verdict: DataFrame
    captures: DataFrame
    differences: DataFrame
    inventory: DataFrame
    splits: DataFrame
    problems: DataFrame


def _input_kind(expected: dict) -> Column:
    """What the audit reads a file as, by its relative path and the manifest's kind."""
    data = [f"data/{split}_data.csv" for split in expected]
    labels = [f"data/{split}_labels.csv" for split in expected]
    return F.when(F.col("kind") == "capture", "capture").when(F.col("path").isin(data), "feature").when(
        F.col("path").isin(labels), "label")


def _problems(rows: DataFrame, inputs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(split, path, row, violation)`` of all input files; files that are not there have row null."""
    named = inputs.select("path", "split", "input")
    found = None
    for kind in ("capture", "feature", "label"):
        own = rows.filter(F.col("input") == kind).drop("input", "split")
        bad = tables.file_violations(own, kind).drop("part")
        found = bad if found is None else found.unionByName(bad)
    missing = wanted.join(inputs.filter("present").select("path"), "path", "left_anti").select(
        "split", "path", F.lit(None).cast("bigint").alias("row"), F.lit(MISSING).alias("violation"))
    return found.join(named.select("path", "split"), "path").select("split", "path", "row", "violation").unionByName(missing)


def _wanted(spark: SparkSession, inputs: DataFrame, expected: dict) -> DataFrame:
    """Every file the audit needs: the listed captures, and two tables per split."""
    fixed = spark.createDataFrame(
        [(f"data/{split}_{name}.csv", split) for split in expected for name in ("data", "labels")], "path string, split string")
    return inputs.filter("input = 'capture'").select("path", "split").unionByName(fixed).distinct()


def run_audit(
    spark: SparkSession, checkout: str, manifest: DataFrame,
    expected: dict[str, tuple[int, int]] = EXPECTED_MATCHES,
) -> AuditReport:
    """Compare a checkout with its manifest and its feature tables with rebuilt ones.

    A split with an unreadable or missing file is invalid: it is reported with its first problem and takes
    no part in the comparisons, and the others are audited. All files are read in one distributed scan;
    no list of paths goes through the driver.
    """
    root = checkout.rstrip("/")
    relative = F.substring_index("path", f"{root}/", -1)
    inventory = written(audit.inventory_status(manifest, tables.file_inventory(spark, root)), "inventory")
    unlisted = tables.unlisted_files(tables.file_listing(spark, root), manifest)
    captures = audit.number_captures(inventory.filter("kind = 'capture'"))
    inputs = written(inventory.withColumns({
        "input": _input_kind(expected), "present": F.col("actual_size").isNotNull()}).filter("input IS NOT NULL").select(
        "path", "split", "input", "present", "actual_size"), "inputs")
    found = read_csv_tree(spark, root).withColumn("path", relative).unionByName(
        empty_files(inputs.filter("actual_size = 0").select("path")))
    rows = written(found.join(inputs.select("path", "split", "input"), "path"), "rows")
    problems = written(_problems(rows, inputs, _wanted(spark, inputs, expected)), "problems")
    first = problems.groupBy("split").agg(F.min(F.struct("path", "row", "violation")).alias("p")).select(
        "split", F.concat_ws(": ", "p.path", "p.violation").alias("reason"))
    wanted = spark.createDataFrame(
        [(split, *pair) for split, pair in expected.items()],
        "split string, expected_matches bigint, expected_labels bigint")
    # One row per split.
    splits = written(wanted.select("split").join(first, "split", "left").select(
        "split", F.when(F.col("reason").isNull(), "audited").otherwise("invalid").alias("status"), "reason"), "splits")
    audited = splits.filter("status = 'audited'").select("split")
    good = rows.join(audited, "split", "left_semi")

    def read_as(kind: str) -> DataFrame:
        return good.filter(F.col("input") == kind).drop("input", "split")

    with_split = inputs.select("path", "split")
    numbered = captures.select("path", "split", "capture_id", "capture_index").join(audited, "split", "left_semi")
    events = tables.capture_events(read_as("capture")).withColumn(
        "row", F.col("row") * (1 << 20) + F.col("part")).drop("part", "violations").join(numbered, "path")
    rebuilt = written(audit.rebuild_features(events), "rebuilt")
    features = written(audit.long_features(rebuilt), "features")
    published = tables.feature_cells(read_as("feature")).join(with_split, "path").select(
        "split", "pid", "position", "feature", "value")
    listed_labels = tables.label_ids(read_as("label")).join(with_split, "path").select("split", "pid")
    differences = written(audit.feature_differences(published, features), "differences")
    joined = audit.label_join(published, listed_labels)
    verdict = audit.audit_verdict(
        inventory, unlisted, audit.label_regression(joined, listed_labels, wanted.join(audited, "split", "left_semi")),
        differences, audit.content_overlap(inventory), audit.id_collisions(events), splits)
    return AuditReport(verdict, audit.capture_summary(numbered, events), differences, inventory, splits, problems)


def write_report(report: AuditReport, path: str) -> None:
    sinks.write_audit_report(report.verdict, f"{path}/verdict")
    sinks.write_differences(report.differences, f"{path}/differences")
    for name in ("splits", "problems", "captures", "inventory"):
        getattr(report, name).write.mode("errorifexists").json(f"{path}/{name}")
