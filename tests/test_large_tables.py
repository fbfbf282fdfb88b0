"""Steps whose cost per task or on the driver must not follow the size of the given tables."""

import datetime
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.operators import serving
from tracemill.plans import queries, table_views
from tracemill.sources import sorted_store

# Shuffles by the run alone: one task would get a whole run.
BY_RUN = re.compile(r"hashpartitioning\(run_id#\d+, \d+[,)]")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events of fifty users over three days, as one file."""
    path = str(tmp_path_factory.mktemp("large"))
    begin = datetime.datetime(2024, 1, 1)
    rows = [(i, begin + datetime.timedelta(seconds=37 * i), i * 7 % 50, ("view", "purchase", "signup", "error")[i % 4])
            for i in range(6000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.parquet(
        f"{path}/events.parquet")
    return path


@pytest.fixture
def small_broadcasts(spark):
    """The events count as large, a table with a row per run as small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4000")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def first_plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "recomputation_differences", "window_trigrams", "window_max_bucket", "latest_predictions", "metrics",
    "alert_lifecycle", "list_alerts"])
def test_records_are_not_shuffled_by_run(spark, folder, small_broadcasts, name):
    assert not BY_RUN.search(first_plan(queries.REGISTERED[name](spark, folder)))


def test_windows_are_not_shuffled_by_run_to_find_missing_runs(spark, folder, small_broadcasts):
    assert not BY_RUN.search(first_plan(queries.integrity_violations(spark, folder)))
    changes = spark.range(5000).select(
        F.col("id").cast("string").alias("window_id"), F.concat(F.lit("run-"), F.col("id") % 3).alias("run_id"))
    found = serving.integrity_violations(
        changes.select("run_id").distinct().filter("run_id <> 'run-1'"), changes, changes, changes)
    assert not BY_RUN.search(first_plan(found)) and found.count() == sum(i % 3 == 1 for i in range(5000))


def test_events_of_a_large_table_are_dealt_to_tasks(spark, folder, monkeypatch):
    whole = table_views.telemetry(spark, folder)
    monkeypatch.setattr(table_views, "TASK_ROWS", 500)
    dealt = table_views.telemetry(spark, folder)
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 12 and max(r["count"] for r in sizes) < 1000
    assert whole.exceptAll(dealt).isEmpty() and dealt.count() == whole.count()


def test_small_parts_of_a_store_share_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sorted_store, "TASK_ROWS", 400)
    store = sorted_store.SortedStore(str(tmp_path / "s"), (("b", True), ("a", False)), rows_per_part=10)
    rows = [(i % 7, i) for i in range(1000)]
    store.write(spark.createDataFrame(rows, "b long, a long"))
    index = store.index(spark).orderBy("part").collect()
    assert len(index) >= 100 and all(r.n <= 10 for r in index) and [r.before for r in index] == [
        sum(q.n for q in index[:i]) for i in range(len(index))]
    # One task per 400 rows, not one per part.
    assert len({r.part // sorted_store._STRIDE for r in index}) <= 3
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [(r.b, r.a) for r in store.page(spark, 100, 395).collect()] == want[395:495]
    got = store.after(spark, {"b": want[604][0], "a": want[604][1]}, 30).collect()
    assert [(r.b, r.a) for r in got] == want[605:635]


def test_the_kernel_machine_needs_no_limit_of_rounds(spark, monkeypatch):
    from tracemill.operators import kernel_machine

    monkeypatch.setattr(kernel_machine, "MOST_ROUNDS", 3, raising=False)
    monkeypatch.setattr(kernel_machine, "BLOCK_ROWS", 16)
    monkeypatch.setattr(kernel_machine, "TASK_PAIRS", 4, raising=False)
    rows = spark.createDataFrame(
        [(i, [float(i * 7 % 23), float(i * i % 19), float(i % 5)], i * i % 19 % 2) for i in range(150)],
        "doc_id long, features array<double>, label int")
    machine = kernel_machine.fit(rows, working=24, tolerance=1e-4)
    whole = kernel_machine.fit(rows, working=400, tolerance=1e-4)
    assert machine.violation <= 2e-4 and abs(machine.bias - whole.bias) < 1e-2
    got = {r.doc_id: r.score for r in machine.score(rows).collect()}
    want = {r.doc_id: r.score for r in whole.score(rows).collect()}
    assert set(got) == set(range(150)) and all(abs(got[i] - want[i]) < 1e-2 for i in want)


def test_the_working_set_grows_to_hold_undecided_rows(spark, monkeypatch):
    """Rows that do not fit the set displace each other round by round; scores come from several slices of the support."""
    from tracemill.operators import kernel_machine

    updated, rounds = kernel_machine._updated, []

    def counted(state, ids, *others):
        rounds.append(len(ids))
        assert len(rounds) <= 12, rounds
        return updated(state, ids, *others)

    monkeypatch.setattr(kernel_machine, "_updated", counted)
    monkeypatch.setattr(kernel_machine, "BLOCK_ROWS", 16)
    monkeypatch.setattr(kernel_machine, "SLICE_BLOCKS", 2, raising=False)
    rows = spark.createDataFrame(
        [(i, [float(i * 7 % 23), float(i * i % 19), float(i * 11 % 31), float(i % 5)], i * i % 29 % 2) for i in range(240)],
        "doc_id long, features array<double>, label int")
    machine = kernel_machine.fit(rows, working=8)
    assert machine.violation <= 2e-6 and max(rounds) > 64
    parts = machine.support.collect()
    vectors = np.vstack([np.frombuffer(r.vectors).reshape(-1, 4) for r in parts])
    weights = np.concatenate([np.frombuffer(r.weights) for r in parts])
    assert len(parts) > 4 and len(weights) == machine.n_support
    for r in machine.score(rows).collect():
        x = (np.array(r.features) - machine.mean) / machine.scale
        want = np.exp(-machine.gamma * ((x - vectors) ** 2).sum(1)) @ weights - machine.bias
        assert abs(r.score - want) < 1e-9
