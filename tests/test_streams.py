"""Streams: health of open runs, withdrawn runs, state that stays small, chunks."""

import os
import random

import pytest

from tests.builders import LENGTH, event, frame, row
from tests.test_recordings import golden, write
from tracemill.sources import sinks
from tracemill.streaming.ingest import RunIngest, stream_lines
from tracemill.sources.commits import VersionedTable
from tracemill.streaming.open_runs import SILENT, UNREADABLE, state_of
from tracemill.streaming.windows import WindowStream


def renamed(records, run):
    return [{**r, "run_id": run} for r in records]


def watch(spark, tmp_path, files, idle_ms=60_000):
    """The health rows after each arrival of one file, and the runs that still have state."""
    folder = tmp_path / "in"
    folder.mkdir()
    ingest = RunIngest(str(tmp_path / "state"))
    for n, lines in enumerate(files):
        write(folder / f"{n}.jsonl", lines)
        ingest.watch(stream_lines(spark, str(folder)), str(tmp_path / "check"), idle_ms=idle_ms).awaitTermination()
    log = ingest.open_runs().log(spark).collect()
    left = {r["key"]["run_id"] for r in state_of(spark, str(tmp_path / "check")).collect()}
    last = {r["run_id"]: r for r in ingest.open_runs().current(spark).collect()}
    return sorted((r["batch_id"], r["run_id"], r["records"], r["event_rate"], r["lost_events"], r["connected"], r["error"])
                  for r in log), left, last


def test_health_of_open_runs_after_each_batch(spark, tmp_path):
    a, b = renamed(golden(), "a"), renamed(golden(), "b")
    last = max(r.get("timestamp_ns", 0) for r in a[:4])
    log, left, current = watch(spark, tmp_path, [a[1:3], [*a[:1], b[0]], a[3:4] + b[1:3], [*a[4:]], [b[3]]])
    elapsed = last - a[0]["capture_start_ns"]
    counted = [r for r in log if r[1] == "a"]
    # Before its start a run has counts but no rate; the end record closes it.
    assert [(r[0], r[2], r[3] is None, r[5]) for r in counted] == [
        (0, 2, True, True), (1, 2, False, True), (2, 3, False, True), (3, len(a) - 2, False, False)]
    assert counted[2][3] == 3e9 / max(1, elapsed) and counted[3][3] == 0.0
    assert [r[5] for r in log if r[1] == "b"] == [True, True, True]
    assert left == {"b"}
    assert not current["a"]["connected"] and current["b"]["records"] == 3


def test_a_broken_record_is_the_error_of_its_run_and_silence_ends_a_run(spark, tmp_path):
    a, b = renamed(golden(), "a"), renamed(golden(), "b")
    broken = {**a[2], "collector_sequence": -1}
    log, left, _ = watch(spark, tmp_path, [a[:2], [broken, "{"], b[:2], [b[2]], [b[3]]], idle_ms=1)
    counted = [(r[2], r[5], r[6]) for r in log if r[1] == "a"]
    assert counted == [(1, True, None), (1, True, UNREADABLE), (1, False, UNREADABLE)]
    assert left <= {"b"}
    assert not [r for r in log if r[1] == "b" and r[6] not in (None, SILENT)]


def test_a_run_that_a_late_file_breaks_is_withdrawn(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    ingest = RunIngest(str(tmp_path / "state"), threshold=0.2)
    results = str(tmp_path / "state" / "results")
    for name, lines, shown in (("a", golden(), 1), ("b", [golden()[1]], 0)):
        write(folder / f"{name}.jsonl", lines)
        ingest.start(stream_lines(spark, str(folder)), str(tmp_path / "check")).awaitTermination()
        assert [sinks.read_results(spark, results, n).count() for n in ("runs", "windows", "alerts")] == [shown] * 3
    assert [r["status"] for r in spark.read.parquet(f"{results}/runs").collect()] == ["withdrawn"]


def test_window_state_stays_small_and_ended_runs_are_forgotten(spark, tmp_path):
    rng = random.Random(3)
    root = str(tmp_path / "state")
    stream = WindowStream(root, bucket_rows=4, keep_ended=1, keep_changes=3)
    everything = WindowStream(str(tmp_path / "all"), bucket_rows=4)
    for batch in range(9):
        # Every run lives for two batches; its first telemetry comes one batch before its start.
        part = []
        for run, phase in ((f"r/{batch}", 0), (f"r/{batch - 1}", 1)):
            if batch - phase < 0:
                continue
            sequence = 10 * phase + 1
            part += [event(sequence + i, rng.randrange(3 * LENGTH), run_id=run) for i in range(4)]
            if phase:
                part += [row("run_start", None, run_id=run, capture_start_ns=0),
                         row("run_end", sequence + 5, 4 * LENGTH, run_id=run)]
        records = frame(spark, part)
        for s in (stream, everything):
            s.apply(records, batch)
        if batch == 4:
            stream.apply(records, batch)  # a repeated batch changes nothing
    key = lambda s: sorted((r["window_id"], r["O_sum"], r["late_event_count"], r["partial"]) for r in s.windows(spark).collect())
    assert key(stream) == key(everything) and key(stream)
    left = sorted(os.listdir(tmp_path / "state" / "marked"))
    assert [n for n in left if n.startswith("run_id=")] == ["run_id=r%2F7"]
    assert len([n for n in os.listdir(tmp_path / "state" / "changes") if n.startswith("batch_id=")]) <= 4
    for name in ("runs", "held", "windows"):
        assert len(VersionedTable(f"{root}/{name}").latest(spark).folders) <= 6
    # A record of a forgotten run changes nothing and is put aside.
    before = key(stream)
    stream.apply(frame(spark, [event(99, 5, "D", run_id="r/0")]), 9)
    assert key(stream) == before and spark.read.parquet(f"{root}/after_end").count() == 1


def test_chunks_of_any_size_give_equal_windows(spark, tmp_path):
    rng = random.Random(12)
    part = [row("run_start", 0, run_id="r", capture_start_ns=0)]
    part += [event(i, rng.randrange(2 * LENGTH), "OCD"[i % 3]) for i in range(1, 9)]
    records = frame(spark, [*part, row("run_end", 9, 2 * LENGTH)])
    found = []
    for n, sizes in enumerate(([], [1] * 4, [7, 0, 2], [0, 3, 0, 7])):
        stream = WindowStream(str(tmp_path / str(n)), bucket_rows=3)
        stream.replay(records, sizes)
        found.append(sorted((r["window_id"], r["O_sum"], r["OCD"], r["late_event_count"], r["partial"]) for r in stream.windows(spark).collect()))
    assert found[0] and all(f == found[0] for f in found)
    for wrong in ([-1], [2.0], [True], [5, 6]):
        with pytest.raises(ValueError, match="chunk sizes"):
            stream.replay(records, wrong)
