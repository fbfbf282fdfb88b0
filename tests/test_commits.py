"""Versioned tables: exclusive commits, merged levels, eviction."""

import os
import threading

import pytest

from tracemill.sources import sinks
from tracemill.sources.sorted_store import SortedStore
from tracemill.sources.commits import FANOUT, KEPT_VERSIONS, VersionedTable, VersionExists, create_once

ROW = "run_id string, v int"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), ROW)


def state(spark, table):
    return {r["run_id"]: r["v"] for r in table.read(spark).collect()}


def race(*actions):
    """What each of several actions at the same time raised, or None."""
    raised, gate = [None] * len(actions), threading.Barrier(len(actions))

    def run(n):
        gate.wait()
        try:
            actions[n]()
        except Exception as error:
            raised[n] = error

    threads = [threading.Thread(target=run, args=(n,)) for n in range(len(actions))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return raised


def test_one_of_many_writers_creates_a_file(spark, tmp_path):
    for turn in range(3):
        path = str(tmp_path / f"{turn}.json")
        raised = race(*[lambda n=n: create_once(spark, path, f"writer {n}" * 100) for n in range(6)])
        assert sum(e is None for e in raised) == 1 and all(e is None or isinstance(e, VersionExists) for e in raised)
        winner = next(n for n, e in enumerate(raised) if e is None)
        assert open(path).read() == f"writer {winner}" * 100
        assert [f for f in os.listdir(tmp_path) if "draft" in f] == []
    with pytest.raises(VersionExists):
        create_once(spark, path, "late")


def test_of_two_writers_of_one_run_one_fails(spark, tmp_path):
    path = str(tmp_path / "acceptance")

    def accept(*runs):
        return lambda: sinks.write_capture_acceptance(
            spark.createDataFrame([(r, "accepted") for r in runs], "run_id string, status string"), path)

    raised = race(accept("a", "b"), accept("b", "c"))
    assert [type(e) for e in raised if e is not None] == [FileExistsError]
    stored = sorted(r["run_id"] for r in sinks.read_capture_acceptance(spark, path).collect())
    assert stored in (["a", "b"], ["b", "c"])
    # Different runs both get in, at the same time as well.
    assert race(accept("d"), accept("e")) == [None, None]
    assert sorted(r["run_id"] for r in sinks.read_capture_acceptance(spark, path).collect()) == stored + ["d", "e"]
    with pytest.raises(FileExistsError, match="capture acceptance already recorded: d"):
        accept("x", "d")()
    with pytest.raises(FileExistsError):
        accept("y", "y")()


def test_one_of_two_publications_stays(spark, tmp_path):
    table = VersionedTable(str(tmp_path / "t"))

    def publish(n):
        return lambda: table.publish_once(spark, lambda folder: rows(spark, ("a", n)).write.parquet(folder))

    raised = race(publish(1), publish(2))
    assert sum(e is None for e in raised) == 1 and sum(isinstance(e, FileExistsError) for e in raised) == 1
    assert len(os.listdir(tmp_path / "t" / "data")) == 1 and spark.read.parquet(table.published(spark)).count() == 1


def test_files_stay_few_over_many_batches(spark, tmp_path):
    table, want, most = VersionedTable(str(tmp_path / "t"), ("run_id",), unmerged=1), {}, 0
    for batch in range(22):
        new = {f"r{batch % 5}": batch, f"s{batch}": batch}
        want.update(new)
        table.append(rows(spark, *new.items()), batch)
        table.append(rows(spark, ("r0", -1)), batch)  # a repeated batch changes nothing
        live = table.latest(spark).folders
        most = max(most, len(live))
        if batch % 7 == 0:
            assert state(spark, table) == want
            assert {r["run_id"] for r in table.before(spark, batch).collect()} >= set(want) - set(new)
            assert all(r["batch_id"] < batch for r in table.before(spark, batch).collect())
    assert state(spark, table) == want
    # Two levels hold 22 batches; deleted are all folders that no kept version names.
    assert most <= 2 * FANOUT + 1
    assert len(os.listdir(tmp_path / "t" / "data")) <= most + 2 * KEPT_VERSIONS + FANOUT
    assert len([f for f in os.listdir(tmp_path / "t" / "_log") if f.endswith(".json")]) <= KEPT_VERSIONS + 3


def test_ended_runs_are_evicted_without_coming_back(spark, tmp_path):
    table = VersionedTable(str(tmp_path / "t"), ("run_id",), fanout=2)
    for batch in range(9):
        table.append(rows(spark, ("old", 0 if batch == 0 else -1) if batch < 2 else (f"n{batch}", batch)), batch,
                     lambda merged: merged.filter("v >= 0"))
        assert state(spark, table).get("old", -1) == (0 if batch == 0 else -1)
    assert {r: v for r, v in state(spark, table).items() if r != "old"} == {f"n{b}": b for b in range(2, 9)}
    assert "old" not in state(spark, table)


def test_pages_read_the_files_around_their_key(spark, tmp_path):
    store = SortedStore(str(tmp_path / "s"), (("b", True), ("a", False)), rows_per_part=10)
    content = [(f"k{i:03}", i * 7 % 13, i) for i in range(95)]
    ordered = sorted(content, key=lambda r: (-r[1], r[0]))
    store.write(spark.createDataFrame(content, "a string, b int, v int").repartition(3))
    assert store.rows(spark) == 95 and store.index(spark).count() > 5
    for offset in (0, 7, 44, 90, 95, 500):
        assert [(r.a, r.b, r.v) for r in store.page(spark, 20, offset).collect()] == ordered[offset:offset + 20]
    page = store.page(spark, 3, 41)
    assert len(page.inputFiles()) <= 2
    for at in (0, 30, 93, 94):
        key = {"a": ordered[at][0], "b": ordered[at][1]}
        assert [r.position for r in store.after(spark, key, 15).collect()] == list(range(at + 1, min(at + 16, 95)))
    assert store.after(spark, {"a": "", "b": 99}, 1).first().position == 0
    assert store.after(spark, {"a": "zzz", "b": ordered[20][1]}, 1).first().b < ordered[20][1]
    for wrong in ((0, 0), (101, 0), (5, -1)):
        with pytest.raises(ValueError):
            store.page(spark, *wrong)
    store.write(spark.createDataFrame([("x", 1, 1)], "a string, b int, v int"))
    assert [r.v for r in store.page(spark).collect()] == [1] and store.page(spark, 5, 1).count() == 0
