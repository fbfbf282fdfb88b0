import random

import pytest

from tests.builders import (
    LENGTH, SECOND, arriving, beat, bounds, by_definition, collected, event, frame, gone, row,
)
from tracemill.operators import normalize, score, windows
from tracemill.schemas import COUNTERS
from tracemill.streaming.windows import WindowStream


def extract(spark, records, end, start=0, rows=4):
    return windows.extract_windows(frame(spark, records), bounds(spark, start, end), bucket_rows=rows)


def single(spark, records, end=LENGTH):
    found = extract(spark, records, end).collect()
    assert len(found) == 1
    return found[0]


def test_sequence_order_beats_arrival_and_time(spark):
    w = single(spark, arriving(
        event(4, SECOND // 10, "O"), event(1, SECOND // 5, "O"), event(3, 11 * SECOND // 10, "D"),
        event(2, 12 * SECOND // 10, "C"), beat(5, LENGTH)))
    assert (w["O_sum"], w["C_sum"], w["D_sum"]) == (2, 1, 1)
    assert (w["O_max_1s"], w["C_max_1s"], w["D_max_1s"]) == (2, 1, 1)
    assert (w["OCD"], w["CDO"], w["ODC"]) == (1, 1, 0)


def test_failed_operations_do_not_count(spark):
    w = single(spark, [event(1, 1, "C", result=-13), event(2, 2, "D", result=-2), event(3, 3, "O", result=4)])
    assert (w["O_sum"], w["C_sum"], w["D_sum"]) == (1, 0, 0)


def test_boundary_event_closes_the_previous_window(spark):
    found = extract(spark, [event(1, 0), event(2, LENGTH, "C")], LENGTH + 1).orderBy("start_ns").collect()
    assert [w["complete"] for w in found] == [True, False]


def test_late_event_keeps_the_id(spark):
    on_time = single(spark, [event(1, 0), beat(2, LENGTH)])
    w = single(spark, [event(1, 0), beat(2, LENGTH), event(3, 1, "C")])
    assert w["window_id"] == on_time["window_id"]
    assert (w["late_event_count"], w["quality"], w["C_sum"], w["classifiable"]) == (1, ["late"], 1, False)


@pytest.mark.parametrize("records, lost", [
    ([event(1, 5, lost=3), beat(2, LENGTH)], 3),
    ([beat(1, 2, lost=5), event(2, 5), beat(3, LENGTH)], 5),
    ([event(1, 5), beat(2, LENGTH, lost=4)], 4),
])
def test_losses_count_for_their_interval(spark, records, lost):
    w = single(spark, records)
    assert (w["loss_count"], w["quality"]) == (lost, ["loss"])


def test_exit_and_end_of_capture_leave_partial_windows(spark):
    found = extract(spark, [event(1, 1), event(2, 2, process=2), gone(3, 3)], 4).collect()
    assert all(w["partial"] for w in found) and len(found) == 2


def _random_stream(seed):
    rng = random.Random(seed)
    records, at = [], 0
    for index in range(1, rng.randint(20, 80)):
        at += rng.choice([0, 1, SECOND, 3 * SECOND, LENGTH // 2, LENGTH])
        when = max(0, at - rng.choice([0, 0, 0, LENGTH, 2 * LENGTH]))
        if rng.random() < 0.2:
            when = when // LENGTH * LENGTH
        kind = rng.random()
        process = rng.choice([1, 1, 1, 2])
        lost = rng.choice([0, 0, 0, 0, 3])
        if kind < 0.75:
            records.append(event(index, when, rng.choice("OCD"), process, rng.choice([0, 5, None, -1]), lost))
        elif kind < 0.9:
            records.append(gone(index, when, process))
        else:
            records.append(beat(index, when, lost))
    return records, max(r["timestamp_ns"] for r in records) + rng.choice([0, 1, LENGTH])


def test_random_streams_equal_the_definitions(spark):
    """Many random runs at once, each with its own bounds, in small order ranges."""
    runs, rows, expected = [], [], {}
    for seed in range(60):
        records, end = _random_stream(seed)
        runs.append((f"r{seed}", 0, end))
        rows += [{**r, "run_id": f"r{seed}"} for r in records]
        for key, value in by_definition(records, 0, end).items():
            expected[(f"r{seed}", *key)] = value
    run_frame = spark.createDataFrame(runs, "run_id string, capture_start_ns bigint, capture_end_ns bigint")
    found = windows.extract_windows(frame(spark, rows).repartition(4), run_frame, bucket_rows=8)
    got = {}
    for run in {r[0] for r in runs}:
        got[run] = {}
    for r in found.collect():
        got[r["run_id"]][r["tgid"], r["start_ns"]] = r
    seen = {(run, *key): value for run, table in got.items() for key, value in table.items()}
    assert seen.keys() == expected.keys()
    for key, (features, partial, loss, late) in expected.items():
        r = seen[key]
        assert {name: r[name] for name in features} == features, key
        assert (r["partial"], r["loss_count"], r["late_event_count"]) == (partial, loss, late), key


@pytest.mark.parametrize("cuts", [(30,), (7, 12, 40)])
def test_stream_in_any_chunks_equals_the_batch(spark, tmp_path, cuts):
    records, end = _random_stream(11)
    whole = [row("run_start", None, None, capture_start_ns=0, source="live"), *records,
             row("run_end", len(records) + 1, end, status="complete", total_lost_events=0)]
    stream = WindowStream(str(tmp_path / "state"), bucket_rows=8, slot_windows=2)
    begin = 0
    for number, cut in enumerate([*cuts, len(whole)]):
        chunk = frame(spark, whole[begin:cut])
        stream.apply(chunk, number)
        if number == 0:
            stream.apply(chunk, number)  # a repeated batch changes nothing
        begin = cut
    assert collected(stream.windows(spark)) == by_definition(records, 0, end)


@pytest.mark.parametrize("cuts", [(5, 20), (0, 33)])
def test_records_before_their_run_start_are_held(spark, tmp_path, cuts):
    records, end = _random_stream(11)
    late = [*records[:25], row("run_start", None, None, capture_start_ns=0, source="live"), *records[25:],
            row("run_end", len(records) + 1, end, status="complete", total_lost_events=0)]
    stream = WindowStream(str(tmp_path / "state"), bucket_rows=8, slot_windows=2)
    begin = 0
    for number, cut in enumerate([*cuts, len(late)]):
        stream.apply(frame(spark, late[begin:cut]), number)
        begin = cut
    assert collected(stream.windows(spark)) == by_definition(records, 0, end)


def test_a_run_whose_start_comes_last_is_complete(spark, tmp_path):
    stream = WindowStream(str(tmp_path / "state"))
    stream.apply(frame(spark, [event(1, 0), event(2, 1, "C")]), 0)
    stream.apply(frame(spark, [row("run_end", 3, LENGTH, status="complete", total_lost_events=0)]), 1)
    stream.apply(frame(spark, [row("run_start", None, None, capture_start_ns=0, source="live")]), 2)
    (window,) = stream.windows(spark).collect()
    assert (window["O_sum"], window["C_sum"]) == (1, 1)


def test_file_stream_feeds_the_windows(spark, tmp_path):
    records = [row("run_start", None, None, capture_start_ns=0, source="live"), event(1, 0), beat(2, LENGTH),
               event(3, 1, "C"), row("run_end", 4, LENGTH, status="complete", total_lost_events=0)]
    folder = str(tmp_path / "in")
    frame(spark, records).coalesce(1).write.parquet(folder)
    stream = WindowStream(str(tmp_path / "state"))
    source = spark.readStream.schema(frame(spark, records).schema).parquet(folder)
    stream.start(source, str(tmp_path / "check")).awaitTermination()
    (window,) = stream.windows(spark).collect()
    assert (window["O_sum"], window["C_sum"], window["late_event_count"]) == (1, 1, 1)


def test_rule_scores_and_abstention(spark):
    busy = [event(i, i, "D") for i in range(1, 51)] + [beat(51, LENGTH)]
    scored = score.score_windows(extract(spark, busy, LENGTH)).collect()[0]
    assert (scored["score"], scored["suspicious"], scored["quality"]) == (5.0, True, "complete")
    late = score.score_windows(extract(spark, [event(1, 0), beat(2, LENGTH), event(3, 1)], LENGTH)).collect()[0]
    assert (late["score"], late["suspicious"], late["quality"]) == (None, None, "late")
    with pytest.raises(ValueError):
        score.check_threshold(float("nan"))
    with pytest.raises(ValueError):
        score.check_feature_order(extract(spark, busy, LENGTH).select("D_sum", "C_sum"))


def test_windows_read_the_marked_table_few_times(spark):
    """Every branch of the window plan reads one narrow table; none repeats the watermark."""
    records = arriving(event(1, 1), event(2, LENGTH + 2), gone(3, LENGTH + 3))
    plan = windows.extract_windows(frame(spark, records), bounds(spark, 0, 2 * LENGTH))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 5
    assert "watermark_ns" in plan and "filename" not in plan


def test_heartbeats_from_snapshots_feed_window_losses(spark):
    shape = "run_id string, pos bigint, timestamp_ns bigint, " + ", ".join(f"{name} bigint" for name in COUNTERS)
    rest = [0] * (len(COUNTERS) - 1)
    rows = [("r", 1, 5, 2, *rest), ("r", 2, LENGTH, 3, *rest), ("r", 3, LENGTH + 1, 1, *rest), ("r", 4, LENGTH + 2, 6, *rest)]
    beats = normalize.heartbeats(spark.createDataFrame(rows, shape), 2)
    assert {(r["pos"], r["lost_events"]) for r in beats.collect()} == {(1, 2), (2, 1), (4, 5)}
    lost = windows.loss_by_window(windows.with_run_bounds(beats, bounds(spark, 0, 3 * LENGTH)), LENGTH)
    assert {(r["start_ns"], r["loss_count"]) for r in lost.collect()} == {(0, 3), (LENGTH, 5)}
