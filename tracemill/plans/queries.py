"""The registered queries: each runs operators over whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracemill.operators import (
    acceptance, audit, health, kernel_machine, labelled, models, normalize, score, selection, serving, validate, windows,
)
from tracemill.plans import table_views as views
from tracemill.plans.table_views import DAY_NS, HOUR_NS
from tracemill.sources import recordings, sinks, split_csv, tables
from tracemill.sources.sorted_store import SortedStore
from tracemill.streaming import open_runs
from tracemill.streaming.ingest import RunIngest, stream_lines
from tracemill.streaming.windows import WindowStream
from tracemill.schemas import FEATURES, WINDOW_KEY
from tracemill.session import shared_folder, written

# Small ranges, so that the bucketed paths are taken on the test tables as well.
RANGE_ROWS = 4096


def _longs(df: DataFrame) -> DataFrame:
    """Integers of any width as BIGINT."""
    return df.select(*[
        F.col(name).cast("bigint").alias(name) if kind in ("int", "smallint", "tinyint") else F.col(name)
        for name, kind in df.dtypes
    ])


def _bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry with run starts. Bounds are written, so that their real size decides the join: where it is
    not known, all records are shuffled to one task per run."""
    records = views.telemetry(spark, sf_dir)
    return windows.with_run_bounds(records, written(views.run_bounds(records), "bounds"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.running_watermark(_bounded(spark, sf_dir), RANGE_ROWS)


def _windows(spark: SparkSession, sf_dir: str, trigrams: bool = True) -> DataFrame:
    records = views.telemetry(spark, sf_dir)
    runs = written(views.run_bounds(records), "bounds")
    return windows.extract_windows(
        records, runs, window_ns=DAY_NS, bucket_ns=HOUR_NS, bucket_rows=RANGE_ROWS, trigrams=trigrams)


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.score_counts(_windows(spark, sf_dir, trigrams=False), threshold=0.2)


def successful_events(spark, sf_dir):
    return windows.successful_events(views.telemetry(spark, sf_dir)).select(
        "collector_sequence", "tgid", "timestamp_ns", "operation", "result")


def tumbling_assign(spark, sf_dir):
    return windows.tumbling_assign(_bounded(spark, sf_dir), DAY_NS).select(
        "collector_sequence", "tgid", "start_ns", "end_ns")


def window_counts(spark, sf_dir):
    return windows.operation_counts(_bounded(spark, sf_dir), DAY_NS)


def window_max_bucket(spark, sf_dir):
    return windows.bucket_maxima(_bounded(spark, sf_dir), DAY_NS, HOUR_NS)


def window_trigrams(spark, sf_dir):
    return windows.window_trigrams(_bounded(spark, sf_dir), DAY_NS, RANGE_ROWS).drop("O_sum", "C_sum", "D_sum")


def running_watermark(spark, sf_dir):
    return _marked(spark, sf_dir).select("run_id", "pos", "timestamp_ns", "watermark_ns")


def _closings(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = views.telemetry(spark, sf_dir)
    runs = written(views.run_bounds(records), "bounds")
    marked = written(windows.mark_telemetry(records, runs, RANGE_ROWS), "marked")
    return windows.window_closings(marked, runs, DAY_NS, HOUR_NS)


def late_counts(spark, sf_dir):
    return _closings(spark, sf_dir).filter("late_event_count > 0").select(*WINDOW_KEY, "late_event_count")


def exit_partial(spark, sf_dir):
    return _closings(spark, sf_dir).select(*WINDOW_KEY, "partial_by_exit", "partial")


def loss_attribution(spark, sf_dir):
    return windows.loss_by_window(_bounded(spark, sf_dir), DAY_NS)


def window_quality(spark, sf_dir):
    return _windows(spark, sf_dir).select(
        *WINDOW_KEY, F.array_join("quality", ",").alias("quality"), "complete", "classifiable")


def window_ids(spark, sf_dir):
    return windows.tumbling_assign(_bounded(spark, sf_dir), DAY_NS).select(
        *WINDOW_KEY, "end_ns").distinct().select(windows.window_id().alias("window_id"), "tgid", "start_ns")


def feature_windows_full(spark, sf_dir):
    return _longs(_windows(spark, sf_dir).withColumn(
        "quality", F.array_join("quality", ",")))


def feature_values_long(spark, sf_dir):
    return windows.feature_long(_windows(spark, sf_dir)).filter("value > 0").select(
        "window_id", "feature", "value")


def rule_scores(spark, sf_dir):
    return _predictions(spark, sf_dir).withColumn("supporting_features", score.supporting_text())


def alerts(spark, sf_dir):
    return score.alerts(_predictions(spark, sf_dir)).select("window_id", "run_id", "score")


def run_verdicts(spark, sf_dir):
    return validate.validate_runs(views.recordings(spark, sf_dir), bucket_rows=RANGE_ROWS).select(
        "recording", "run_id", "records", "event_count", "heartbeat_count", "process_exit_count",
        "observed_loss", "accepted", F.array_join("violations", "; ").alias("violations"))


def expected_bounds(spark, sf_dir):
    """Recordings against announced bounds, and a foreign record inside one envelope."""
    records = views.recordings(spark, sf_dir).withColumn(
        "type", F.expr("IF(recording = 'rec-16' AND pos = 3, 'process_identity', type)"))
    expected = records.filter("type NOT IN ('run_start', 'run_end')").groupBy("recording").agg(
        F.max("timestamp_ns").alias("_last")).selectExpr(
        "recording", "IF(recording = 'rec-17', 1L, 0L) AS capture_start_ns",
        "_last + IF(recording = 'rec-18', 1, 0) AS capture_end_ns")
    found = validate.validate_runs(records, expected=expected, bucket_rows=RANGE_ROWS)
    wanted = (validate.ENVELOPE, validate.START_MATCH, validate.END_MATCH)
    return found.select("recording", "records", F.array_join(
        F.filter("violations", lambda text: text.isin(*wanted)), "; ").alias("violations"))


def engine_violations(spark, sf_dir):
    records = views.telemetry(spark, sf_dir).withColumn(
        "collector_sequence", F.when(F.col("pos") % 101 == 0, F.col("collector_sequence") + 1)
        .otherwise(F.col("collector_sequence")))
    runs = written(views.run_bounds(records).withColumn("capture_start_ns", F.lit(3_600_000_000_000)), "bounds")
    return validate.engine_violations(windows.with_run_bounds(records, runs))


def health_running(spark, sf_dir):
    return health.health_running(_bounded(spark, sf_dir), RANGE_ROWS).select(
        "run_id", "pos", "records", "event_rate", "lost_events")


def run_summary(spark, sf_dir):
    found = written(_windows(spark, sf_dir), "windows")
    return health.run_summary(views.telemetry(spark, sf_dir), found, score.score_windows(found, 0.2))


# --- recordings, normalization --------------------------------------------------------------------


def contract_violations(spark, sf_dir):
    parsed = recordings.parse_records(views.contract_lines(spark, sf_dir))
    return parsed.select("recording", "pos", F.array_join("violations", "; ").alias("violations"))


def parsed_events(spark, sf_dir):
    parsed = recordings.parse_records(views.contract_lines(spark, sf_dir))
    return recordings.telemetry_records(parsed).select(
        "recording", "collector_sequence", "run_id", "timestamp_ns", "tgid", "operation", "result", "filename_bytes_b64")


def rejected_line_numbers(spark, sf_dir):
    lines = views.contract_lines(spark, sf_dir)
    parsed = recordings.parse_records(lines.select(
        "recording", "value", "pos", F.floor(F.col("pos") / 1000).alias("block")))
    return recordings.line_numbers(
        lines.select("recording", "pos", F.floor(F.col("pos") / 1000).alias("block"))
        .withColumn("pos", F.floor(F.col("pos") / 3)),
        parsed.filter("size(violations) > 0").withColumn("pos", F.floor(F.col("pos") / 3)),
    ).select("recording", "line_number", F.get("violations", F.lit(0)).alias("violation"))


def byte_budget(spark, sf_dir):
    lines = sinks.canonical_lines(views.recordings(spark, sf_dir)).select("recording", "pos", "value")
    return sinks.byte_budget(lines, ["recording"], 100_000, RANGE_ROWS).select(
        "recording", "pos", "written_bytes", "kept")


def canonical_records(spark, sf_dir):
    return sinks.canonical_lines(views.recordings(spark, sf_dir)).select(
        "recording", "pos", F.sha2("value", 256).alias("line_digest"))


def op_mapping(spark, sf_dir):
    raw = views.raw_syscalls(spark, sf_dir)
    intent = normalize.create_intent("name", "flags")
    return raw.select(
        "event_id", intent.alias("create_intent"), normalize.operation(F.col("name"), intent).alias("operation"),
        (F.col("return_value") >= 0).alias("succeeded"))


def protocol_violations(spark, sf_dir):
    return normalize.protocol_violations(views.raw_syscalls(spark, sf_dir), strict_run_id=True).select(
        "event_id", F.array_join("violations", "; ").alias("violations"))


def contract_events(spark, sf_dir):
    raw = normalize.protocol_violations(views.raw_syscalls(spark, sf_dir)).filter("size(violations) = 0")
    return normalize.contract_events(raw).select(
        "run_id", "collector_sequence", "timestamp_ns", "tgid", "tid", "operation", "result", "filename_bytes_b64"
    ).withColumn("type", F.lit("event")).unionByName(
        normalize.contract_exits(raw).select("run_id", "collector_sequence", "timestamp_ns", "tgid", "tid", "type"),
        allowMissingColumns=True)


def filename_display(spark, sf_dir):
    """Whole document texts and page markup as raw names."""
    documents = views.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), "doc_id").alias("id"), F.encode("text", "UTF-8").alias("raw"))
    pages = views.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page-"), "page_id").alias("id"), F.encode("html", "UTF-8").alias("raw"))
    shown = documents.unionByName(pages).select("id", normalize.filename_display("raw").alias("display"))
    return shown.select("id", F.length("display").cast("bigint").alias("shown_length"), F.md5("display").alias("shown_digest"))


def loss_deltas(spark, sf_dir):
    return normalize.loss_deltas(views.loss_counters(spark, sf_dir), RANGE_ROWS)


def heartbeat_losses(spark, sf_dir):
    """Health snapshots as heartbeats that feed the loss of windows."""
    beats = normalize.heartbeats(views.timed_loss_counters(spark, sf_dir), RANGE_ROWS)
    return windows.loss_by_window(windows.with_run_bounds(beats, written(views.run_bounds(beats), "bounds")), DAY_NS)


def counter_health(spark, sf_dir):
    return normalize.counter_health(views.loss_counters(spark, sf_dir)).select(
        "run_id", "pos", "loss_total", "telemetry_complete")


# --- labelled data --------------------------------------------------------------------------------


def experiment_plan(spark, sf_dir):
    """Labelled rows per planned run, documents being dealt to the runs in plan order."""
    dealt = views.labelled_rows(spark, sf_dir).groupBy((F.col("doc_id") % 40).cast("int").alias("plan_order")).agg(
        F.count("*").alias("row_count"))
    return labelled.experiment_plan(spark).join(dealt, "plan_order", "left").select(
        "run_id", F.col("seed").cast("bigint").alias("seed"), "split", "behavior_label", "workload_identity",
        F.coalesce("row_count", F.lit(0)).alias("row_count"))


def _experiment_manifests(spark, sf_dir):
    """One tracked process per run, taken from the telemetry."""
    return views.telemetry(spark, sf_dir).filter("type = 'event'").groupBy("run_id").agg(
        F.max("tgid").alias("_tgid")).selectExpr(
        "run_id", "'training' AS split", "IF(run_id = 'run-0', 'suspicious', 'benign') AS behavior_label",
        "array(named_struct('boot_id', 'b0', 'tgid', _tgid, 'start_time_ns', 0L),"
        " named_struct('boot_id', 'b0', 'tgid', _tgid - 10, 'start_time_ns', 0L)) AS tracked_processes")


def manifest_violations(spark, sf_dir):
    manifests, plan = views.workload_manifests(spark, sf_dir)
    return labelled.manifest_violations(manifests, plan).select(
        "doc_id", F.array_join("violations", "; ").alias("violations"))


def foreign_windows(spark, sf_dir):
    """Windows of the one run that has no manifest."""
    manifests = _experiment_manifests(spark, sf_dir).filter("run_id <> 'run-1'")
    return labelled.foreign_windows(_windows(spark, sf_dir), manifests).select("window_id", "run_id")


def tracked_windows(spark, sf_dir):
    manifests = _experiment_manifests(spark, sf_dir)
    hashes = manifests.select("run_id", F.sha2("run_id", 256).alias("capture_hash"))
    rows = labelled.build_labelled_rows(_windows(spark, sf_dir), manifests, hashes)
    return rows.select("window_id", "capture_id", "capture_hash", "split", F.col("label").cast("bigint").alias("label"),
                       F.array_join("features", ",").alias("features"), "complete", "quality")


def recomputation_differences(spark, sf_dir):
    """Window counts against themselves with some values changed."""
    computed = window_counts(spark, sf_dir)
    changed = computed.withColumn("C_sum", F.col("C_sum") + F.when(F.col("tgid") % 31 == 0, 1).otherwise(0))
    return labelled.recomputation_differences(changed, computed)


def set_completeness(spark, sf_dir):
    planned = views.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("run_id"))
    actual = views.table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), F.col("doc_id") + 2).alias("run_id"))
    return labelled.set_completeness(planned, actual)


def capture_consistency(spark, sf_dir):
    rows = views.labelled_rows(spark, sf_dir)
    plan = rows.select("capture_id").distinct().selectExpr(
        "capture_id AS run_id", "'training' AS split", "'suspicious' AS behavior_label")
    return labelled.capture_consistency(rows, plan)


def row_violations(spark, sf_dir):
    return labelled.row_violations(views.labelled_rows(spark, sf_dir))


def leakage_violations(spark, sf_dir):
    return labelled.leakage_violations(views.labelled_rows(spark, sf_dir))


def capture_summary(spark, sf_dir):
    return _longs(labelled.capture_summary(views.labelled_rows(spark, sf_dir, clean=True)))


def labelled_row_json(spark, sf_dir):
    return views.labelled_rows(spark, sf_dir, clean=True).select("doc_id", labelled.row_json().alias("text"))


def capture_content_hash(spark, sf_dir):
    return labelled.sequential_digest(views.labelled_rows(spark, sf_dir, clean=True))


def content_digest(spark, sf_dir):
    return labelled.content_digest(views.labelled_rows(spark, sf_dir), ["capture_id"])


def role_projection(spark, sf_dir):
    return labelled.role_projection(views.labelled_rows(spark, sf_dir, clean=True)).select("role", "doc_id", "split")


def role_totals(spark, sf_dir):
    return labelled.role_totals(views.labelled_rows(spark, sf_dir, clean=True))


def manifest_diff(spark, sf_dir):
    rows = views.labelled_rows(spark, sf_dir, clean=True)
    digests = labelled.content_digest(rows, ["capture_id"]).select(F.col("capture_id").alias("run_id"), "content_digest")
    manifest = labelled.capture_summary(rows).join(digests, "run_id").selectExpr(
        "IF(run_id = 'cap-1-3', 'cap-new', run_id) AS run_id",
        "row_count + IF(run_id LIKE '%-7', 1, 0) AS row_count", "capture_sha256",
        "IF(run_id LIKE '%-9', 'other', split) AS split", "label",
        "IF(run_id LIKE '%-1_', 'changed', content_digest) AS content_digest")
    return labelled.manifest_differences(rows, manifest)


def manifest_consistency(spark, sf_dir):
    rows = views.labelled_rows(spark, sf_dir, clean=True)
    captures = labelled.capture_summary(rows).withColumn(
        "capture_sha256", F.expr("CASE WHEN run_id LIKE '%-4' THEN 'zz' ELSE capture_sha256 END"))
    roles = rows.groupBy(F.when(F.col("split") == "test", "test").otherwise("selection").alias("role")).agg(
        (F.count("*") + 1).alias("row_count"))
    plan = captures.filter("run_id NOT LIKE '%-5'").selectExpr(
        "run_id", "IF(run_id LIKE '%-6', 'test', split) AS split", "IF(label = 1, 'suspicious', 'benign') AS behavior_label")
    return labelled.manifest_consistency(captures, roles, plan)


def dataset_changes(spark, sf_dir):
    """Parts of a dataset that differ after one row of some captures was changed, from digest trees alone."""
    rows = views.labelled_rows(spark, sf_dir, clean=True)
    changed = rows.withColumn("quality", F.when(F.col("doc_id") % 97 == 5, "other").otherwise(F.col("quality")))
    trees = [written(labelled.digest_tree(r, ["capture_id"]), "tree") for r in (rows, changed)]
    return labelled.tree_differences(*trees, ["capture_id"])


def dataset_contract(spark, sf_dir):
    """A dataset whose stored rows, manifest, roles and plan were changed in places."""
    rows = written(views.labelled_rows(spark, sf_dir, clean=True).drop("doc_id"), "rows")
    digests = labelled.content_digest(rows, ["capture_id"]).select(F.col("capture_id").alias("run_id"), "content_digest")
    captures = written(labelled.capture_summary(rows).join(digests, "run_id"), "captures")
    plan = captures.select("run_id", "split")
    bound = labelled.plan_digest(plan).withColumns({
        "feature_version": F.lit(1), "feature_names": F.array(*map(F.lit, FEATURES[::-1])), "n_captures": F.lit(3)})
    roles = labelled.role_totals(rows).filter("role <> 'test'").withColumn("splits", F.lit("none"))
    return labelled.dataset_contract(rows, captures.filter("run_id <> 'cap-1-3'"), roles, plan.filter("run_id <> 'cap-0-2'"), bound)


def plan_digest(spark, sf_dir):
    """Digest of the capture list of the labelled rows, as a plan document."""
    plan = views.labelled_rows(spark, sf_dir, clean=True).groupBy("capture_id").agg(F.max("split").alias("split")).select(
        F.col("capture_id").alias("run_id"), "split")
    return labelled.plan_digest(plan)


def capture_acceptance(spark, sf_dir):
    records = views.recordings(spark, sf_dir)
    manifests, plan = views.capture_plan(spark, sf_dir)
    verdicts = validate.validate_runs(records, bucket_rows=RANGE_ROWS)
    return acceptance.accept_captures(records, verdicts, manifests, plan).select(
        "run_id", "duration_ns", "record_count", "event_count", "heartbeat_count", "process_exit_count",
        "tracked_event_count", "status", F.array_join("violations", "; ").alias("violations"))


# --- model selection ------------------------------------------------------------------------------


def _scored(spark, sf_dir):
    """Three stand-in score columns of every labelled row, one row per model."""
    rows = views.labelled_rows(spark, sf_dir, clean=True)
    return rows.selectExpr(
        "doc_id", "label", "capture_id",
        "stack(3, 'rule', (features[1] + features[2]) / 10.0D, 'rbf_svm', features[5] / 7.0D - 3.0D,"
        " 'random_forest', (doc_id % 101 + label * 30) / 131.0D) AS (model, score)")


def selection_guard(spark, sf_dir):
    return selection.selection_guard(views.labelled_rows(spark, sf_dir, clean=True))


def fold_assignment(spark, sf_dir):
    return _longs(selection.assign_folds(views.labelled_rows(spark, sf_dir, clean=True)))


def threshold_sweep(spark, sf_dir):
    return selection.threshold_sweep(_scored(spark, sf_dir), ["model"], 16)


def best_threshold(spark, sf_dir):
    return selection.best_threshold(threshold_sweep(spark, sf_dir), ["model"])


def confusion_metrics(spark, sf_dir):
    return selection.rates(selection.confusion(_scored(spark, sf_dir), ["model"], F.col("score") >= 0.5))


def finalist(spark, sf_dir):
    return _longs(selection.finalist(best_threshold(spark, sf_dir)))


def metric_disagreements(spark, sf_dir):
    stored = selection.rates(selection.confusion(_scored(spark, sf_dir), ["capture_id", "model"], F.col("score") >= 0.5))
    changed = stored.withColumn("recall", F.expr("IF(capture_id LIKE '%-2', recall + 0.25, recall)")).withColumn(
        "mcc", F.expr("IF(model = 'rule' AND capture_id LIKE '%-2', mcc - 0.125, mcc)"))
    return selection.metric_disagreements(changed).select(
        "capture_id", "model", F.array_join("disagrees", ",").alias("disagrees"))


def unequal_totals(spark, sf_dir):
    """Captures for which one model was measured on more rows than the others, or with a negative count."""
    counts = selection.confusion(_scored(spark, sf_dir), ["capture_id", "model"], F.col("score") >= 0.5).withColumns({
        "true_positives": F.expr("true_positives + IF(capture_id LIKE '%-2' AND model = 'rule', 2, 0)"),
        "true_negatives": F.expr("IF(capture_id LIKE '%-3', -1 - true_negatives, true_negatives)"),
        "false_positives": F.expr("IF(capture_id LIKE '%-3', false_positives + 1 + 2 * true_negatives, false_positives)")})
    return _longs(selection.unequal_totals(counts, ["capture_id"]))


# --- audit ----------------------------------------------------------------------------------------


def _rebuilt(spark, sf_dir):
    return written(audit.rebuild_features(views.numbered_events(spark, sf_dir)[1], HOUR_NS, RANGE_ROWS), "rebuilt")


def legacy_adjusted(spark, sf_dir):
    return audit.adjust_ids(views.numbered_events(spark, sf_dir)[1]).selectExpr(
        "split", "CAST(capture_index AS BIGINT) AS capture_index", "row", "adjusted_id")


def legacy_periods(spark, sf_dir):
    return audit.with_periods(audit.adjust_ids(views.numbered_events(spark, sf_dir)[1]), HOUR_NS).select(
        "split", "row", "adjusted_id", "period")


def legacy_statistics(spark, sf_dir):
    return audit.period_statistics(audit.with_periods(audit.adjust_ids(
        views.numbered_events(spark, sf_dir)[1]), HOUR_NS))


def legacy_trigrams(spark, sf_dir):
    return audit.row_trigrams(audit.adjust_ids(views.numbered_events(spark, sf_dir)[1]), RANGE_ROWS)


def legacy_long(spark, sf_dir):
    return _longs(audit.long_features(_rebuilt(spark, sf_dir)).select("split", "pid", "feature", "value"))


def legacy_wide(spark, sf_dir):
    return audit.wide_features(_rebuilt(spark, sf_dir), "training")


def legacy_wide_testing(spark, sf_dir):
    return audit.wide_features(_rebuilt(spark, sf_dir), "testing")


def legacy_captures(spark, sf_dir):
    numbered, events = views.numbered_events(spark, sf_dir)
    return _longs(audit.capture_summary(numbered, events, RANGE_ROWS))


def id_collisions(spark, sf_dir):
    return audit.id_collisions(views.numbered_events(spark, sf_dir)[1]).select(
        "split", "adjusted_id", "capture_id", F.col("pid").alias("recorded_id"), "identities")


def _label_ids(spark, sf_dir):
    return views.table(spark, sf_dir, "labels").selectExpr(
        "IF(doc_id % 2 = 0, 'training', 'testing') AS split", "doc_id * 2 AS pid")


def label_join(spark, sf_dir):
    features = audit.adjust_ids(views.numbered_events(spark, sf_dir)[1]).select(
        "split", F.col("adjusted_id").alias("pid")).distinct()
    return audit.label_join(features, _label_ids(spark, sf_dir))


def label_regression(spark, sf_dir):
    labels = _label_ids(spark, sf_dir)
    expected = labels.groupBy("split").agg(F.count("*").alias("expected_labels")).selectExpr(
        "split", "IF(split = 'training', 1L, 0L) AS expected_matches", "expected_labels")
    return audit.label_regression(label_join(spark, sf_dir), labels, expected)


def feature_diff(spark, sf_dir):
    rebuilt = written(audit.long_features(_rebuilt(spark, sf_dir)), "features")
    supplied = rebuilt.filter("pid % 53 <> 7 AND feature <> 'EEE'").selectExpr(
        "split", "IF(pid % 41 = 3, pid + 1000000, pid) AS pid",
        "IF(split = 'training' AND feature IN ('C_max', 'C_sum'), 1 - position, position) AS position", "feature",
        "value + IF(pid % 29 = 1 AND feature IN ('O_sum', 'OOO'), 1, 0) AS value")
    return audit.feature_differences(supplied, rebuilt)


def inventory_status(spark, sf_dir):
    return audit.inventory_status(*views.document_files(spark, sf_dir)).select("path", "status", "byte_representation")


def verification_status(spark, sf_dir):
    return audit.verification_status(*views.document_files(spark, sf_dir))


def file_manifest_violations(spark, sf_dir):
    """Manifests of all documents, one per language, some of them broken."""
    listed = views.table(spark, sf_dir, "documents").selectExpr(
        "IF(lang = 'de', 2L, 1L) AS schema_version", "concat(IF(lang = 'fr', 'http', 'https'), '://example.invalid/', lang) AS repository",
        "IF(lang = 'es', 'short', upper(sha1(lang))) AS commit",
        "concat(CASE WHEN doc_id % 11 = 0 THEN '../' WHEN doc_id % 13 = 0 THEN '/' WHEN doc_id % 17 = 0 THEN 'a/../' ELSE 'a..b/' END, doc_id) AS path",
        "IF(doc_id % 23 = 0, 'zz', upper(sha2(CAST(doc_id AS STRING), 256))) AS sha256",
        "CASE WHEN doc_id % 29 = 0 THEN -1L WHEN doc_id % 31 <> 0 THEN n_chars END AS size")
    return tables.file_manifest_violations(listed)


def unlisted_files(spark, sf_dir):
    manifest, inventory = views.document_files(spark, sf_dir)
    return tables.unlisted_files(inventory, manifest).select("path")


def overlap(spark, sf_dir):
    return audit.content_overlap(audit.inventory_status(*views.document_files(spark, sf_dir)))


def audit_verdict(spark, sf_dir):
    manifest, inventory = views.document_files(spark, sf_dir)
    status = audit.inventory_status(manifest, inventory)
    return audit.audit_verdict(
        status, tables.unlisted_files(inventory, manifest), label_regression(spark, sf_dir),
        feature_diff(spark, sf_dir), audit.content_overlap(status), id_collisions(spark, sf_dir))


def file_inventory(spark, sf_dir):
    return tables.file_inventory(spark, sf_dir, "*.parquet")


# --- serving --------------------------------------------------------------------------------------


def list_runs(spark, sf_dir):
    runs = views.recordings(spark, sf_dir).groupBy("recording").agg(
        F.max("run_id").alias("run_id"), F.min("timestamp_ns").alias("started_ns"),
        F.max("source").alias("source"), F.max("status").alias("status"))
    return serving.list_runs(runs, limit=10, offset=3)


def process_windows(spark, sf_dir):
    return serving.processes(window_counts(spark, sf_dir))


def list_processes(spark, sf_dir):
    return serving.list_processes(window_counts(spark, sf_dir), limit=100, offset=5)


def list_windows(spark, sf_dir):
    stored = written(_windows(spark, sf_dir), "windows")
    listed = serving.list_windows(stored, score.score_windows(stored, 0.2), limit=100, offset=20)
    return listed.withColumn("features", F.expr(
        "array_join(transform(array_sort(map_keys(features)), k -> concat(k, '=', features[k])), ',')"))


def deep_pages(spark, sf_dir):
    """Pages of stored windows far behind the first, by offset and from a key on."""
    store = SortedStore(f"{shared_folder(spark, 'sorted')}/windows", (("start_ns", True), ("window_id", False)), rows_per_part=512)
    store.write(_windows(spark, sf_dir, trigrams=False).select("window_id", "run_id", "tgid", "start_ns", "O_sum", "C_sum", "D_sum"))
    total = store.rows(spark)
    found = None
    for number, offset in enumerate((0, total // 2, max(0, total - 30), total)):
        page = store.page(spark, limit=100, offset=offset).withColumn("page", F.lit(number))
        last = page.orderBy(F.desc("position")).first()
        both = page if last is None else page.unionByName(
            store.after(spark, {"start_ns": last.start_ns, "window_id": last.window_id}, limit=20).withColumn("page", F.lit(10 + number)))
        found = both if found is None else found.unionByName(both)
    return _longs(found)


def _changes(spark, sf_dir):
    """Three prediction versions per window: two thresholds, then a partial replacement."""
    scored = windows.tumbling_assign(_bounded(spark, sf_dir), DAY_NS).groupBy(*WINDOW_KEY, "end_ns").agg(
        (F.count_if(F.col("operation") != "O") / F.lit(10.0)).alias("_score"), F.min("collector_sequence").alias("alert_id"))
    return scored.select(
        windows.window_id().alias("window_id"), *WINDOW_KEY, "alert_id", "_score",
        F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("version"),
    ).selectExpr(
        "window_id", *WINDOW_KEY, "alert_id", "CAST(version AS BIGINT) AS version",
        "IF(version = 3 AND tgid % 3 = 0, NULL, _score + version / 100.0D) AS score",
        "IF(version = 3 AND tgid % 3 = 0, NULL, _score >= IF(version = 2, 0.2D, 0.1D)) AS suspicious")


def alert_lifecycle(spark, sf_dir):
    return serving.alert_lifecycle(_changes(spark, sf_dir))


def latest_predictions(spark, sf_dir):
    return serving.latest(_changes(spark, sf_dir).select("window_id", "version", "score", "suspicious"), ["window_id"])


def list_alerts(spark, sf_dir):
    changes = _changes(spark, sf_dir)
    windows_once = changes.filter("version = 1").select(
        "window_id", "run_id", "tgid", "start_time_ns", "alert_id")
    stored = serving.alert_lifecycle(changes).join(windows_once, "window_id").withColumn(
        "supporting_features", F.lit(None).cast("string"))
    return serving.list_alerts(stored, limit=100, offset=10).drop("supporting_features")


def current_predictions(spark, sf_dir):
    """Stored verdicts after their window was replaced."""
    found = written(_windows(spark, sf_dir), "windows")
    replaced = found.withColumn("classifiable", F.col("classifiable") & (F.col("tgid") % 4 != 0))
    return serving.current_predictions(replaced, score.score_windows(found, 0.2)).select(
        "window_id", "score", "suspicious", "quality")


def metrics(spark, sf_dir):
    changes = _changes(spark, sf_dir)
    now = serving.latest(changes.select("window_id", "version", "score", "suspicious"), ["window_id"])
    return serving.metrics(now, now, serving.alert_lifecycle(changes))


def integrity_violations(spark, sf_dir):
    changes = _changes(spark, sf_dir).select("window_id", "run_id", "tgid", "version", "suspicious")
    now = written(serving.latest(changes, ["window_id"]), "now")
    runs = now.select("run_id").distinct().filter("run_id <> 'run-1'")
    predicted = now.filter("tgid % 13 <> 1")
    return serving.integrity_violations(
        runs, now.filter("tgid % 17 <> 2"), predicted.unionByName(predicted.filter("tgid % 19 = 3")),
        now.filter("suspicious"))


def final_health(spark, sf_dir):
    verdicts = validate.validate_runs(views.recordings(spark, sf_dir), bucket_rows=RANGE_ROWS)
    return health.final_health(verdicts).select("recording", "connected", "event_rate", "lost_events", "error")


def health_snapshot(spark, sf_dir):
    return serving.health(health.health_running(_bounded(spark, sf_dir), RANGE_ROWS))


def forest_scores(spark, sf_dir):
    """A forest fitted on training captures; it scores all rows."""
    rows = views.labelled_rows(spark, sf_dir, clean=True)
    candidate = models.Candidate("random_forest", (40, 4), 37)
    return candidate.score(candidate.fit(rows.filter("split = 'training'")), rows).select("doc_id", "label", "score")


def svm_scores(spark, sf_dir):
    rows = views.labelled_rows(spark, sf_dir, clean=True)
    candidate = models.Candidate("rbf_svm", (1.0, "scale"), 37, exact_rows=0)
    return candidate.score(candidate.fit(rows.filter("split = 'training'")), rows).select("doc_id", "label", "score")


def kernel_scores(spark, sf_dir):
    """Scores of the exact kernel machine."""
    rows = views.labelled_rows(spark, sf_dir, clean=True)
    machine = kernel_machine.fit(rows.filter("split = 'training'"))
    return machine.score(rows).select("doc_id", "label", "score")


def stream_windows(spark, sf_dir):
    """The events table as a stream: windows, late replacements and losses through micro-batches."""
    folder = shared_folder(spark, "stream")
    stream = WindowStream(f"{folder}/state", window_ns=DAY_NS, bucket_ns=HOUR_NS, bucket_rows=RANGE_ROWS)
    bounds = views.run_bounds(views.telemetry(spark, sf_dir))
    starts, ends = views.envelope_records(bounds)
    stream.apply(starts, -1)
    records = views.telemetry(spark, sf_dir, views.event_stream(spark, sf_dir))
    stream.start(records, f"{folder}/checkpoint").awaitTermination()
    stream.apply(ends, 1 << 40)
    return _longs(stream.windows(spark).withColumn("quality", F.array_join("quality", ",")))


def stream_windows_batches(spark, sf_dir):
    """The telemetry in five micro-batches; run starts come with the second, run ends after the last.

    Records before their run start are held, and windows are replaced across batches.
    """
    folder = shared_folder(spark, "batches")
    stream = WindowStream(f"{folder}/state", window_ns=DAY_NS, bucket_ns=HOUR_NS, bucket_rows=RANGE_ROWS)
    records = views.telemetry(spark, sf_dir)
    starts, ends = views.envelope_records(views.run_bounds(records))
    last = records.agg(F.max("pos")).first()[0] or 0
    for number in range(5):
        low, high = number * (last + 1) // 5, (number + 1) * (last + 1) // 5
        part = records.filter((F.col("pos") >= low) & (F.col("pos") < high))
        stream.apply(part.unionByName(starts, allowMissingColumns=True) if number == 1 else part, number)
    stream.apply(ends, 5)
    return _longs(stream.windows(spark).withColumn("quality", F.array_join("quality", ",")))


def capture_rows(spark, sf_dir):
    """Events of CSV captures whose quoted names may hold line breaks."""
    rows = split_csv.csv_rows(views.capture_lines(spark, sf_dir), RANGE_ROWS)
    return tables.capture_events(rows).filter("size(violations) = 0").select(
        "path", "row", F.col("ts").cast("bigint"), F.col("pid").cast("bigint"), "kind", F.col("pattern").cast("bigint"))


def capture_file_violations(spark, sf_dir):
    return tables.file_violations(split_csv.csv_rows(views.capture_lines(spark, sf_dir), RANGE_ROWS), "capture").drop("part")


def feature_file_violations(spark, sf_dir):
    return tables.file_violations(split_csv.csv_rows(views.feature_lines(spark, sf_dir), RANGE_ROWS), "feature").drop("part")


def feature_file_cells(spark, sf_dir):
    rows = split_csv.csv_rows(views.feature_lines(spark, sf_dir), RANGE_ROWS)
    return tables.feature_cells(rows).select(
        "path", "feature", *[F.col(c).cast("bigint") for c in ("pid", "position", "value")])


def label_file_violations(spark, sf_dir):
    return tables.file_violations(split_csv.csv_rows(views.label_lines(spark, sf_dir), RANGE_ROWS), "label").drop("part")


def collector_violations(spark, sf_dir):
    return recordings.collector_violations(views.collector_lines(spark, sf_dir)).select(
        "recording", "pos", F.array_join("violations", "; ").alias("violations"))


def ingest_runs(spark, sf_dir):
    """Health of open runs after each of six arrivals of JSON lines; run starts come with the second, ends last."""
    folder = shared_folder(spark, "open-runs")
    records = views.telemetry(spark, sf_dir).withColumn("filename", F.when(F.col("type") == "event", ""))
    starts, ends = views.envelope_records(views.run_bounds(records))
    starts = starts.withColumn("source", F.lit("live"))
    ends = ends.withColumns({"collector_sequence": F.lit(1 << 40), "status": F.lit("complete"),
                             "total_lost_events": F.lit(0).cast("bigint")})
    last = records.agg(F.max("pos")).first()[0] or 0
    live = RunIngest(f"{folder}/state")
    for number in range(6):
        low, high = number * (last + 1) // 5, (number + 1) * (last + 1) // 5
        part = records.filter((F.col("pos") >= low) & (F.col("pos") < high))
        part = ends if number == 5 else part.unionByName(starts) if number == 1 else part
        sinks.canonical_lines(part).select("value").write.mode("append").text(f"{folder}/lines")
        live.watch(stream_lines(spark, f"{folder}/lines"), f"{folder}/checkpoint").awaitTermination()
    return live.open_runs().log(spark).select("batch_id", *open_runs.FIELDS)


def republished_state(spark, sf_dir):
    """Predictions and alerts after all runs but one were published again, at a higher threshold and
    with fewer windows."""
    path = f"{shared_folder(spark, 'republished')}/results"
    found = written(_windows(spark, sf_dir), "windows")
    runs = written(views.run_bounds(views.telemetry(spark, sf_dir)).select(
        "run_id", F.lit("live").alias("source"), F.col("capture_start_ns").alias("started_ns"),
        F.lit("complete").alias("status")), "runs")
    sinks.publish_runs(runs, found, score.score_windows(found, 0.1), path)
    others = "run_id <> 'run-1'"
    fewer = found.filter(others).filter("tgid % 3 <> 0")
    sinks.publish_runs(runs.filter(others), fewer, score.score_windows(fewer, 0.3), path)
    alerted = sinks.read_results(spark, path, "alerts").select("window_id", F.lit(True).alias("alert"))
    return sinks.read_results(spark, path, "predictions").join(alerted, "window_id", "left").select(
        "window_id", "run_id", "threshold", "score", "suspicious", F.coalesce("alert", F.lit(False)).alias("alert"))


REGISTERED = {
    name: value for name, value in list(globals().items())
    if callable(value) and getattr(value, "__module__", None) == __name__ and not name.startswith("_")
}
