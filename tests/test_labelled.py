import hashlib
import json
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.builders import LENGTH, beat, bounds, event, frame, gone, row
from tracemill.operators import acceptance, kernel_machine, labelled, models, selection, serving, validate, windows
from tracemill.schemas import FEATURES, LABELED_WINDOW, RUN_MANIFEST
from tracemill.sources import recordings, sinks, tables
from tracemill.sources.commits import VersionedTable


def manifest(run="controlled-copying-seed-11", **changes):
    value = {
        "schema_version": 1, "run_id": run, "scenario": "copying", "seed": 11, "split": "training",
        "behavior_label": "benign", "plan_sha256": "0" * 64, "label_provenance": "controlled_workload",
        "tracked_processes": [{"boot_id": "b", "tgid": 1, "start_time_ns": 7}],
        "process_scope_policy": "root_process_only", "background_activity": "unlabeled", "workspace": "/w",
        "status": "completed", "workload_hold_seconds": 50.0,
        "limits": {"max_seconds": 15.0, "max_files": 256, "max_bytes": 16777216},
    }
    return {**value, **changes}


def manifests(spark, tmp_path, *values):
    for index, value in enumerate(values):
        (tmp_path / f"m{index}.json").write_text(json.dumps(value, indent=1))
    return tables.read_run_manifests(spark, [str(tmp_path / f"m{i}.json") for i in range(len(values))])


def test_plan_has_forty_runs(spark):
    plan = labelled.experiment_plan(spark)
    counts = {r["split"]: r["count"] for r in plan.groupBy("split").count().collect()}
    assert counts == {"training": 24, "validation": 8, "test": 8}
    assert plan.filter("run_id = 'controlled-paced-replacement-seed-53' AND behavior_label = 'suspicious'").count() == 1
    assert plan.select("plan_order").distinct().count() == 40
    assert tables.plan_differences(plan, plan).isEmpty()


def test_manifest_rules(spark, tmp_path):
    got = labelled.manifest_violations(manifests(
        spark, tmp_path, manifest(), manifest(split="test"), manifest(status="failed", seed=12),
        manifest(tracked_processes=[]), manifest(limits={"max_seconds": 1.0, "max_files": 256, "max_bytes": 16777216})))
    found = sorted(r["violations"] for r in got.collect())
    assert [] in found
    assert ["seed belongs to another split"] in found
    assert ["number of tracked processes is not one"] in found
    assert ["limits differ from the planned ones"] in found
    assert any("seed is not one of the planned ones" in reasons for reasons in found)


def test_only_tracked_classifiable_windows_become_rows(spark, tmp_path):
    run = "controlled-copying-seed-11"
    records = [{**r, "run_id": run} for r in (
        event(1, 0, "C"), event(2, 1, process=2), event(3, LENGTH, "D"), beat(4, 2 * LENGTH), event(5, 2 * LENGTH))]
    spans = spark.createDataFrame([(run, 0, 2 * LENGTH)], "run_id string, capture_start_ns bigint, capture_end_ns bigint")
    found = windows.extract_windows(frame(spark, records), spans)
    hashes = spark.createDataFrame([(run, "a" * 64)], "run_id string, capture_hash string")
    known = manifests(spark, tmp_path, manifest())
    rows = labelled.build_labelled_rows(found, known, hashes)
    assert [(r["label"], r["features"][:3]) for r in rows.orderBy("window_id").collect()].count((0, [0.0, 1.0, 0.0])) == 1
    assert rows.count() == 2
    assert labelled.row_violations(rows).isEmpty() and labelled.leakage_violations(rows).isEmpty()
    assert labelled.foreign_windows(found.withColumn("run_id", F.lit("x")), known).count() == found.count()
    assert labelled.recomputation_differences(found, found).isEmpty()


def rows(spark, per_capture=2, captures=12, extra=()):
    """Captures with one label, split and hash each."""
    out = []
    for c in range(captures):
        split = "training" if c < captures - 4 else "validation" if c < captures - 2 else "test"
        for n in range(per_capture):
            features = [float(n)] + [float(60 * (c % 2) + n)] * (len(FEATURES) - 1)
            out.append((f"w-{c}-{n}", f"c{c}", hashlib.sha256(str(c).encode()).hexdigest(), split, c % 2, 2,
                        list(FEATURES), features, True, "good"))
    return spark.createDataFrame([*out, *extra], LABELED_WINDOW)


def python_digest(values):
    ordered = sorted((r.asDict() for r in values), key=lambda r: (r["capture_id"], r["window_id"]))
    return hashlib.sha256(json.dumps(ordered, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_digests(spark):
    data = rows(spark)
    exact = {r["capture_id"]: r["row_content_sha256"] for r in labelled.sequential_digest(data.repartition(5)).collect()}
    for capture in ("c0", "c7"):
        assert exact[capture] == python_digest(data.filter(F.col("capture_id") == capture).collect())
    once = labelled.content_digest(data, ["capture_id"]).orderBy("capture_id").collect()
    again = labelled.content_digest(data.repartition(7), ["capture_id"]).orderBy("capture_id").collect()
    assert once == again
    doubled = labelled.content_digest(data.union(data), ["capture_id"]).orderBy("capture_id").collect()
    assert all(a["content_digest"] != b["content_digest"] and b["row_count"] == 2 * a["row_count"]
               for a, b in zip(once, doubled))


def test_changed_rows_are_found_by_their_tree(spark, tmp_path):
    data = rows(spark)
    plan = data.groupBy("capture_id").agg(F.max("split").alias("split"), F.max("label").alias("label")).select(
        F.col("capture_id").alias("run_id"), "split", F.when(F.col("label") == 1, "suspicious").otherwise("benign").alias("behavior_label"))
    changed = data.withColumn("features", F.when(F.col("window_id") == "w-3-0", F.array_repeat(F.lit(1.0), 33)).otherwise(F.col("features")))
    for name, content in (("a", data), ("b", data.repartition(5)), ("c", changed)):
        sinks.assemble_dataset(content, plan, str(tmp_path / name))
    assert sinks.dataset_changes(spark, str(tmp_path / "a"), str(tmp_path / "b")).count() == 0
    found = sinks.dataset_changes(spark, str(tmp_path / "a"), str(tmp_path / "c")).collect()
    texts = {r["window_id"]: hashlib.sha256(r["t"].encode()).hexdigest()[:6] for df in (data, changed) for r in
             df.filter("capture_id = 'c3'").select("window_id", labelled.row_json().alias("t")).collect()}
    old = hashlib.sha256(data.filter("window_id = 'w-3-0'").select(labelled.row_json().alias("t")).first().t.encode()).hexdigest()[:6]
    assert {(r["capture_id"], r["prefix"], r["rows_before"], r["rows_after"]) for r in found} == {
        ("c3", old, 1, None), ("c3", texts["w-3-0"], None, 1)}


def test_dataset_is_published_once_and_bound_to_its_manifest(spark, tmp_path):
    data = rows(spark)
    plan = data.groupBy("capture_id").agg(F.max("split").alias("split"), F.max("label").alias("label")).select(
        F.col("capture_id").alias("run_id"), "split", F.when(F.col("label") == 1, "suspicious").otherwise("benign").alias("behavior_label"))
    path = str(tmp_path / "dataset")
    sinks.assemble_dataset(data, plan, path)
    counts = {role: sinks.load_dataset(spark, path, role).count() for role in labelled.ROLES}
    assert counts == {"all": 24, "selection": 20, "test": 4}
    with pytest.raises(FileExistsError):
        sinks.assemble_dataset(data, plan, path)
    with pytest.raises(ValueError, match="label or split"):
        sinks.assemble_dataset(data.withColumn("split", F.lit("test")), plan, str(tmp_path / "other"))
    captures = spark.read.parquet(f"{VersionedTable(path).published(spark)}/captures")
    tampered = data.withColumn("features", F.when(F.col("window_id") == "w-3-0", F.array_repeat(F.lit(1.0), 33)).otherwise(F.col("features")))
    assert [tuple(r) for r in labelled.manifest_differences(tampered, captures).collect()] == [("c3", "differs in content_digest")]
    sinks.write_labelled_rows(data, str(tmp_path / "lines"))
    back = recordings.labeled_rows(recordings.read_lines(spark, str(tmp_path / "lines"))).filter("size(violations) = 0")
    assert back.select(*data.columns).exceptAll(data).isEmpty() and back.count() == 24


def test_acceptance_needs_tracked_activity_and_exit(spark, tmp_path):
    def capture(run, *body, end=60 * 1_000_000_000):
        n = len(body)
        records = [row("run_start", None, None, capture_start_ns=0, source="live"), *body,
                   row("run_end", n + 1, end, status="complete", total_lost_events=0)]
        return [{**r, "pos": i, "run_id": run, "recording": run} for i, r in enumerate(records)]

    names = [f"controlled-copying-seed-{seed}" for seed in (11, 23, 37)]
    telemetry = frame(spark, capture(names[0], event(1, 1, result=-1), gone(2, 5))
                      + capture(names[1], event(1, 1), beat(2, 5))
                      + capture(names[2], gone(1, 5), end=63 * 1_000_000_000))
    values = [manifest(name, seed=seed) for name, seed in zip(names, (11, 23, 37))]
    plan = labelled.experiment_plan(spark).withColumn("seed", F.col("seed").cast("bigint"))
    got = {r["run_id"]: r for r in acceptance.accept_captures(
        telemetry, validate.validate_runs(telemetry), manifests(spark, tmp_path, *values), plan).collect()}
    assert got[names[0]]["status"] == "accepted" and got[names[0]]["tracked_event_count"] == 1
    assert got[names[1]]["violations"] == ["a tracked process has no exit"]
    assert got[names[2]]["violations"] == ["recording is shorter or longer than planned",
                                           "no event of any tracked process"]
    # A run's own plan digest has to agree, too.
    for digest, status in (("0" * 64, "accepted"), ("1" * 64, "rejected")):
        digested = plan.withColumn("plan_sha256", F.lit(digest))
        judged = acceptance.accept_captures(
            telemetry, validate.validate_runs(telemetry), manifests(spark, tmp_path, values[0]), digested)
        assert judged.first()["status"] == status
    evidence = spark.createDataFrame([(names[0], 10, "a" * 64)], "run_id string, actual_size bigint, actual_sha256 string")
    full = acceptance.with_file_evidence(judged, evidence, evidence, labelled.plan_digest(plan.select("run_id", "seed"))).first()
    assert full["raw_sha256"] == full["runtime_manifest_sha256"] == "a" * 64 and len(full["experiment_plan_sha256"]) == 64
    accepted = spark.createDataFrame([("r1", "accepted")], "run_id string, status string")
    path = str(tmp_path / "accepted")
    sinks.write_capture_acceptance(accepted, path)
    with pytest.raises(FileExistsError):
        sinks.write_capture_acceptance(accepted, path)


def test_number_of_score_ranges_follows_the_data(spark, monkeypatch):
    monkeypatch.setattr(selection, "RANGE_SCORES", 2)
    monkeypatch.setattr(selection, "SCORE_RANGES", 2)
    df = spark.createDataFrame([("m", float(i % 50), i % 3 // 2) for i in range(200)], "model string, score double, label int")
    seen = []
    cut = selection.score_ranges
    monkeypatch.setattr(selection, "score_ranges", lambda scores, ranges: seen.append(ranges) or cut(scores, ranges))
    found = {r["threshold"]: r["true_positives"] for r in selection.threshold_sweep(df, ["model"]).collect()}
    assert seen == [25]
    assert all(found[t] == sum(1 for i in range(200) if i % 3 // 2 and i % 50 >= t) for t in map(float, range(50)))


def test_threshold_sweep_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    scored = [("m", round(rng.gauss(0, 1), 1), rng.randint(0, 1)) for _ in range(200)] + [("n", 0.5, 0), ("n", 5.0, 1)]
    df = spark.createDataFrame(scored, "model string, score double, label int")
    for ranges in (1, 4, 50):
        sweep = selection.threshold_sweep(df, ["model"], ranges)
        got = {(r["model"], r["threshold"]): (r["true_positives"], r["false_positives"]) for r in sweep.collect()}
        for model in "mn":
            part = [(s, y) for m, s, y in scored if m == model]
            top = max(s for s, _ in part)
            for t in {s for s, _ in part} | {top + selection.EPSILON}:
                want = (sum(s >= t and y == 1 for s, y in part), sum(s >= t and y == 0 for s, y in part))
                assert got.pop((model, t)) == want
        assert not got
    best = {r["model"]: r for r in selection.best_threshold(sweep, ["model"]).collect()}
    assert (best["n"]["threshold"], best["n"]["f1"], best["n"]["false_positives"]) == (5.0, 1.0, 0)


def test_metric_rates_and_disagreements(spark):
    counts = spark.createDataFrame([(0, 0, 3, 0), (5, 1, 2, 4)],
                                   "true_negatives bigint, false_positives bigint, false_negatives bigint, true_positives bigint")
    rated = selection.rates(counts)
    low = rated.filter("true_positives = 0").first()
    assert (low["precision"], low["recall"], low["f1"], low["mcc"]) == (0.0, 0.0, 0.0, 0.0)
    assert selection.metric_disagreements(rated).isEmpty()
    assert selection.metric_disagreements(rated.withColumn("f1", F.col("f1") + 1e-9)).count() == 2


def test_guards(spark):
    reasons = {r[0] for r in selection.selection_guard(rows(spark)).collect()}
    assert reasons == {"rows of the test split are present"}
    few = rows(spark, captures=6).filter("split <> 'test'")
    assert {r[0] for r in selection.selection_guard(few).collect()} == {
        "a label has fewer than 3 training captures"}
    folds = selection.assign_folds(rows(spark))
    assert {(r["label"], r["fold"]): r["count"] for r in folds.groupBy("label", "fold").count().collect()} == {
        (label, fold): 2 for label in (0, 1) for fold in (0, 1, 2)}


def test_models_are_selected_stored_and_evaluated_once(spark, tmp_path):
    data = rows(spark, per_capture=4)
    chosen = models.train_and_select(
        data.filter("split <> 'test'"), svm_grid=((1.0, "scale"),), forest_grid=((5, 3),))
    # All models separate these rows, so the simplest one wins.
    assert chosen.name == "rule"
    assert {r["model"] for r in chosen.evaluations.collect()} == {"rule", "rbf_svm", "random_forest"}
    assert all(r["f1"] == 1.0 for r in chosen.evaluations.collect())
    for name, parameters, exact in (("rbf_svm", (1.0, "scale"), 1000), ("rbf_svm", (1.0, "scale"), 0), ("random_forest", (5, 3), 0)):
        candidate = models.Candidate(name, parameters, 37, exact)
        kept = models.Selected(name, candidate.cut, candidate, candidate.fit(data), chosen.evaluations, 37)
        path = str(tmp_path / f"{name}-{exact}")
        models.save_model(kept, path, selection_digest="a" * 64, dataset_digest="b" * 64)
        loaded = models.load_model(spark, path)
        before = kept.score(data).select("window_id", F.round("score", 9)).orderBy("window_id").collect()
        assert before == loaded.score(data).select("window_id", F.round("score", 9)).orderBy("window_id").collect()
    metrics = models.evaluate(loaded, data.filter("split = 'test'"))
    assert metrics.first()["f1"] == 1.0
    with pytest.raises(ValueError):
        models.record_evaluation(spark, path, metrics, dataset_digest="c" * 64)
    models.record_evaluation(spark, path, metrics, dataset_digest="b" * 64)
    with pytest.raises(FileExistsError):
        models.record_evaluation(spark, path, metrics, dataset_digest="b" * 64)
    assert models.report(spark, path).count() == 1
    with pytest.raises(FileExistsError):
        models.save_model(kept, path, selection_digest="a" * 64, dataset_digest="b" * 64)
    for wrong in (data, data.filter("label > 1"), data.filter("split = 'test'").withColumn("label", F.lit(2)),
                  data.filter("split = 'test'").withColumn("feature_version", F.lit(1))):
        with pytest.raises(ValueError, match="test rows"):
            models.evaluate(loaded, wrong)
    # A changed stage is not loaded.
    stages = VersionedTable(path).published(spark) + "/stages/0"
    changed = next(f for f in sorted(pathlib.Path(stages).rglob("*")) if f.name.startswith("part-"))
    changed.write_bytes(changed.read_bytes() + b" ")
    changed.with_name(f".{changed.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="stages differ"):
        models.load_model(spark, path)


def test_alert_life_cycle(spark):
    changes = spark.createDataFrame(
        [("w", 1, 5.0, True), ("w", 2, 5.0, False), ("v", 1, 5.0, True), ("v", 2, None, None), ("v", 3, 6.0, True), ("u", 1, 1.0, False)],
        "window_id string, version bigint, score double, suspicious boolean")
    got = {r["window_id"]: (r["valid"], r["score"]) for r in serving.alert_lifecycle(changes).collect()}
    assert got == {"w": (False, 5.0), "v": (True, 6.0)}


def test_upsert_keeps_the_newest_version(spark, tmp_path):
    shape = "run_id string, window_id string, version bigint, v int"
    path = str(tmp_path / "t")
    sinks.upsert(spark.createDataFrame([("a", "1", 1, 10), ("a", "2", 1, 11), ("b", "3", 1, 12)], shape), path, ["window_id"])
    sinks.upsert(spark.createDataFrame([("a", "1", 3, 20), ("a", "2", 0, 21)], shape), path, ["window_id"])
    assert {(r["window_id"], r["v"]) for r in spark.read.parquet(path).collect()} == {("1", 20), ("2", 11), ("3", 12)}


def test_page_bounds(spark):
    for limit, offset in ((0, 0), (101, 0), (5, -1), (True, 0)):
        with pytest.raises(ValueError):
            serving.check_page(limit, offset)


def test_publishing_refuses_inconsistent_results(spark, tmp_path):
    from tracemill.operators import score

    found = windows.extract_windows(frame(spark, [event(1, 0)]), bounds(spark, 0, LENGTH))
    runs = spark.createDataFrame([("other", "live", 0, "complete")], "run_id string, source string, started_ns bigint, status string")
    with pytest.raises(ValueError, match="window without run"):
        sinks.publish_runs(runs, found, score.score_windows(found), str(tmp_path / "r"))
    assert not (tmp_path / "r").exists()


def test_plan_digest_is_that_of_canonical_json(spark):
    plans = [("b", "Zoë \"x\"\n", 11, 1.0, True, None), ("a", "\u2028😀\\", -3, 1e-7, False, 2.5e20), ("c", None, 5, 123456.789, None, 0.1)]
    names = ["run_id", "scenario", "seed", "seconds", "held", "share"]
    df = spark.createDataFrame(plans, "run_id string, scenario string, seed bigint, seconds double, held boolean, share double")
    documents = sorted((dict(zip(names, p)) for p in plans), key=lambda d: d["run_id"])
    text = json.dumps(documents, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    assert labelled.plan_digest(df.repartition(3)).first().plan_digest == hashlib.sha256(text.encode()).hexdigest()
    with pytest.raises(ValueError, match="no canonical JSON"):
        labelled.plan_digest(df.withColumn("x", F.array(F.lit(1))))


@pytest.mark.parametrize("working,penalty", [(1024, 1.0), (20, 0.5)])
def test_the_kernel_machine_is_optimal(spark, working, penalty):
    """The gap between primal and dual, from the whole kernel matrix, is closed; scores are those of the dual."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.standard_normal((60, 4)), rng.standard_normal((50, 4)) * 0.7 + 1])
    x = np.hstack([x, np.full((110, 1), 5.0)])
    y = np.array([0] * 60 + [1] * 50)
    y[[3, 77]] ^= 1
    rows = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))] + [(110, x[0].tolist(), int(y[0]))],
                                 "doc_id int, features array<double>, label int").repartition(3)
    machine = kernel_machine.fit(rows, penalty, working=working, tolerance=1e-7)
    got = {r.doc_id: r.score for r in machine.score(rows).collect()}
    z = np.array([x[i % 110] for i in range(111)])
    spread = z.std(0)
    spread[spread == 0] = 1
    z, sign = (z - z.mean(0)) / spread, np.append(2 * y - 1, 2 * y[0] - 1)
    k = np.exp(-0.25 * ((z[:, None] - z[None]) ** 2).sum(2))
    parts = machine.support.collect()
    vectors = np.vstack([np.frombuffer(r.vectors).reshape(-1, 5) for r in parts])
    weights = np.concatenate([np.frombuffer(r.weights) for r in parts])
    assert len(weights) == machine.n_support and np.isclose(weights.sum(), 0, atol=1e-9) and np.abs(weights).max() <= penalty + 1e-12
    outputs = np.exp(-0.25 * ((z[:, None] - vectors[None]) ** 2).sum(2)) @ weights - machine.bias
    assert np.allclose([got[i] for i in range(111)], outputs, atol=1e-9)
    square = weights @ np.exp(-0.25 * ((vectors[:, None] - vectors[None]) ** 2).sum(2)) @ weights
    primal = square / 2 + penalty * np.maximum(0, 1 - sign * outputs).sum()
    dual = np.abs(weights).sum() - square / 2
    assert 0 <= primal - dual + 1e-9 and primal - dual < 1e-4 * primal
    with pytest.raises(ValueError, match="both labels"):
        kernel_machine.fit(rows.filter("label = 1"))
