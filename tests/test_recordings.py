import base64
import json

import pytest

from tests.builders import LENGTH, arriving, beat, event, frame, gone, row
from tracemill.operators import health, normalize, validate
from tracemill.plans.replay import replay, replay_and_publish
from tracemill.schemas import COUNTERS, FEATURES
from tracemill.sources import recordings, sinks
from tracemill.streaming.ingest import RunIngest, stream_lines

PROCESS = {"type": "process_identity", "schema_version": 1, "boot_id": "demo", "tgid": 4242, "start_time_ns": 42}


def record(kind, **fields):
    return {"type": kind, "schema_version": 1, "run_id": "demo", **fields}


def golden():
    def operation(sequence, at, name):
        return record("event", collector_sequence=sequence, timestamp_ns=at, process=PROCESS, tid=4242, operation=name,
                      result=0, filename="a", filename_bytes_b64=None, telemetry_quality="complete", lost_events=0)
    return [
        record("run_start", capture_start_ns=0, source="replay"),
        operation(1, 0, "C"), operation(2, 1, "D"), operation(3, 2, "D"),
        record("heartbeat", collector_sequence=4, timestamp_ns=LENGTH, lost_events=0),
        record("run_end", collector_sequence=5, timestamp_ns=LENGTH, status="complete", total_lost_events=0),
    ]


def write(path, records):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records))
    return str(path)


def test_golden_recording(spark, tmp_path):
    path = write(tmp_path / "demo.jsonl", golden())
    runs, windows, predictions = replay(spark, path, threshold=0.2)
    (w,) = windows.collect()
    nonzero = {name: w[name] for name in FEATURES if w[name]}
    assert nonzero == {"C_sum": 1, "D_sum": 2, "C_max_1s": 1, "D_max_1s": 2, "CDD": 1}
    assert (w["complete"], w["start_ns"], w["end_ns"]) == (True, 0, LENGTH)
    (p,) = predictions.collect()
    assert (p["score"], p["suspicious"]) == (0.3, True)
    results = str(tmp_path / "results")
    replay_and_publish(spark, path, results, threshold=0.2)
    replay_and_publish(spark, path, results, threshold=0.2)
    assert [sinks.read_results(spark, results, name).count() for name in ("runs", "windows", "predictions", "alerts")] == [1] * 4


@pytest.mark.parametrize("change, reason", [
    ({"process": {**PROCESS, "boot_id": " "}}, "boot_id is no text or empty"),
    ({"process": {**PROCESS, "tgid": True}}, "tgid is no integer from 1 to 2^32 - 1"),
    ({"process": {**PROCESS, "tgid": 2**32}}, "tgid is no integer from 1 to 2^32 - 1"),
    ({"process": {**PROCESS, "more": 1}}, "process has a field that is not known"),
    ({"timestamp_ns": 2**64}, "timestamp_ns is no integer from 0 to 2^64 - 1"),
    ({"timestamp_ns": 2**63}, "integer needs more than 63 bits"),
    ({"timestamp_ns": 1.0}, "timestamp_ns is no integer from 0 to 2^64 - 1"),
    ({"timestamp_ns": "1"}, "timestamp_ns is no integer from 0 to 2^64 - 1"),
    ({"operation": "X"}, "operation is none of O, C, D"),
    ({"filename_bytes_b64": "!!"}, "filename_bytes_b64 is not base64"),
    ({"lost_events": -1}, "lost_events is no integer from 0 to 2^64 - 1"),
    ({"schema_version": 2}, "schema_version is not the known one"),
    ({"extra": 1}, "record has a field that is not known"),
    ({"type": "other"}, "unknown record type"),
    ({"result": 2**63}, "result is neither null nor a 64-bit integer"),
])
def test_rejected_records(spark, change, reason):
    line = json.dumps({**golden()[1], **change})
    lines = spark.createDataFrame([(line, "f", 0, 0)], "value string, recording string, block bigint, pos bigint")
    assert recordings.parse_records(lines).first()["violations"] == [reason]


def test_line_errors_name_file_and_line(spark, tmp_path):
    path = tmp_path / "bad.jsonl"
    good = [json.dumps(r).encode() for r in golden()]
    path.write_bytes(b"\n".join([good[0], b"", b"[1]", b"{", b'"\xff"', good[1]]) + b"\n")
    lines = recordings.read_lines(spark, str(path))
    got = recordings.quarantine(recordings.parse_records(lines), lines).orderBy("line_number").collect()
    assert [(r["line_number"], r["violations"][0]) for r in got] == [
        (2, "blank JSONL record"), (3, "line is no JSON object"), (4, "invalid JSON"), (5, "invalid UTF-8")]
    with pytest.raises(ValueError, match="bad.jsonl:2: blank JSONL record"):
        replay(spark, str(path))


def test_defaults_of_optional_fields(spark):
    short = record("event", collector_sequence=1, timestamp_ns=0, process=PROCESS, tid=1, operation="O")
    lines = spark.createDataFrame([(json.dumps(short), "f", 0, 0)], "value string, recording string, block bigint, pos bigint")
    parsed = recordings.parse_records(lines)
    assert parsed.first()["violations"] == []
    r = recordings.telemetry_records(parsed).first()
    assert (r["result"], r["filename"], r["telemetry_quality"], r["lost_events"]) == (None, "", "complete", 0)


def test_canonical_lines_round_trip(spark, tmp_path):
    path = write(tmp_path / "demo.jsonl", golden())
    parsed = recordings.read_records(spark, path)
    lines = [r["value"] for r in sinks.canonical_lines(recordings.telemetry_records(parsed)).orderBy("pos").collect()]
    assert lines == [json.dumps(r, sort_keys=True, separators=(",", ":")) for r in golden()]
    telemetry = recordings.telemetry_records(parsed)
    with pytest.raises(sinks.ByteBudgetExceeded):
        sinks.write_recordings(telemetry, str(tmp_path / "cut"), max_bytes=len(lines[0]) + len(lines[1]) + 2)
    assert spark.read.text(str(tmp_path / "cut")).count() == 2


def test_feature_windows_check_their_id(spark, tmp_path):
    _, windows, _ = replay(spark, write(tmp_path / "demo.jsonl", golden()))
    w = windows.first()
    base = record("feature_window", process=PROCESS, start_ns=0, end_ns=LENGTH, feature_names=list(FEATURES),
                  values=[w[name] for name in FEATURES], window_id=w["window_id"], partial=False)
    path = write(tmp_path / "w.jsonl", [base, {**base, "end_ns": LENGTH + 1}, golden()[0], {**base, "values": [1]}])
    got = recordings.feature_windows(recordings.read_records(spark, path)).orderBy("pos")
    reasons = [r["violations"] for r in got.collect()]
    assert reasons[0] == []
    assert reasons[1] == ["feature window_id does not match its identity fields"]
    assert reasons[2] == ["record is no feature window"]
    assert reasons[3] == ["numbers of feature names and values differ"]
    spread = recordings.spread_features(got.filter("size(violations) = 0")).first()
    assert {name: spread[name] for name in FEATURES} == {name: w[name] for name in FEATURES}


def envelope(*body, end=LENGTH, **last):
    n = len(body)
    records = [row("run_start", None, None, capture_start_ns=0, source="live"), *body,
               row("run_end", n + 1, end, **{"status": "complete", "total_lost_events": 0, **last})]
    return [{**r, "pos": i} for i, r in enumerate(records)]


def changed(records, index, **fields):
    return [{**r, **fields} if i == index else r for i, r in enumerate(records)]


GOOD = envelope(event(1, 0), beat(2, 5), gone(3, LENGTH))
CASES = {
    "good": (GOOD, []),
    "no_start": (GOOD[1:], [validate.BEGIN]),
    "two_ends": (GOOD + [{**GOOD[-1], "pos": 9, "collector_sequence": 5}], [validate.END]),
    "foreign": (changed(GOOD, 2, type="feature_window"), [validate.ENVELOPE, validate.SEQUENCE]),
    "failed": (changed(GOOD, 4, status="failed"), [validate.STATUS]),
    "other_run": (changed(GOOD, 2, run_id="q"), [validate.RUN_ID]),
    "gap": (changed(GOOD, 3, collector_sequence=4), [validate.SEQUENCE]),
    "outside": (changed(GOOD, 3, timestamp_ns=LENGTH + 1), [validate.BOUNDARY]),
    "wrong_loss": (changed(GOOD, 4, total_lost_events=1), [validate.LOSS_TOTAL]),
    "lossy": (changed(changed(GOOD, 2, lost_events=2), 4, total_lost_events=2), [validate.LOSSY]),
    "degraded": (changed(GOOD, 1, telemetry_quality="degraded"), [validate.DEGRADED]),
    "no_result": (changed(GOOD, 1, result=None), [validate.NO_RESULT]),
    "late_is_fine": (envelope(event(1, 9), event(2, 1)), []),
}


def test_stream_rules(spark):
    rows = [{**r, "recording": name} for name, (records, _) in CASES.items() for r in records]
    df = frame(spark, rows)
    for size in (2, 1000):
        got = {r["recording"]: r for r in validate.validate_runs(df, bucket_rows=size).collect()}
        for name, (_, reasons) in CASES.items():
            assert got[name]["violations"] == reasons, name
    lax = {r["recording"]: r["accepted"] for r in validate.validate_runs(
        df, require_lossless=False, require_results=False).collect()}
    assert lax["lossy"] and lax["degraded"] and lax["no_result"] and not lax["gap"]
    wanted = spark.createDataFrame(
        [("good", 1, LENGTH + 5)], "recording string, capture_start_ns bigint, capture_end_ns bigint")
    checked = validate.validate_runs(df.filter("recording = 'good'"), expected=wanted).first()
    assert checked["violations"] == [validate.START_MATCH, validate.END_MATCH]


def test_final_health_states(spark):
    df = frame(spark, [{**r, "recording": name} for name in ("good", "lossy") for r in CASES[name][0]])
    got = {r["recording"]: r for r in health.final_health(validate.validate_runs(df)).collect()}
    assert (got["good"]["error"], got["good"]["lost_events"]) == (None, 0)
    assert (got["lossy"]["error"], got["lossy"]["lost_events"]) == (validate.LOSSY, 2)


def test_ingest_publishes_accepted_runs_only(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.jsonl", golden())
    bad = [{**r, "run_id": "bad"} for r in golden()]
    bad[2]["collector_sequence"] = 9
    write(folder / "b.jsonl", bad)
    write(folder / "c.jsonl", [{**golden()[0], "run_id": "torn"}, "{", {**golden()[5], "run_id": "torn", "collector_sequence": 1}])
    ingest = RunIngest(str(tmp_path / "state"), threshold=0.2)
    ingest.start(stream_lines(spark, str(folder)), str(tmp_path / "check")).awaitTermination()
    results = str(tmp_path / "state" / "results")
    assert [r["run_id"] for r in sinks.read_results(spark, results, "runs").collect()] == ["demo"]
    assert sinks.read_results(spark, results, "alerts").count() == 1
    errors = {r["run_id"]: r["error"] for r in spark.read.parquet(str(tmp_path / "state" / "health")).collect()}
    assert errors == {"demo": None, "bad": validate.SEQUENCE, "torn": "recording has lines that could not be read"}


def test_ingest_of_clean_files_in_several_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    ingest = RunIngest(str(tmp_path / "state"), threshold=0.2)

    def arrive(name, records):
        write(folder / name, records)
        ingest.start(stream_lines(spark, str(folder)), str(tmp_path / "check")).awaitTermination()

    results = str(tmp_path / "state" / "results")
    arrive("a.jsonl", golden()[:2])
    arrive("b.jsonl", golden()[2:])
    assert sinks.read_results(spark, results, "windows").count() == 1
    # The same swap of two records is refused in one file and in two.
    for run, parts in (("one", [(0, 1, 3, 2, 4, 5)]), ("two", [(0, 1, 3), (2, 4, 5)])):
        for n, part in enumerate(parts):
            arrive(f"{run}{n}.jsonl", [{**golden()[i], "run_id": run} for i in part])
    assert [r["run_id"] for r in sinks.read_results(spark, results, "runs").collect()] == ["demo"]
    errors = {r["run_id"]: r["error"] for r in spark.read.parquet(str(tmp_path / "state" / "health")).collect()}
    assert errors["one"] == errors["two"] is not None


def test_republishing_removes_what_an_older_version_held(spark, tmp_path):
    path = write(tmp_path / "demo.jsonl", golden())
    results = str(tmp_path / "results")
    replay_and_publish(spark, path, results, threshold=0.2)
    assert sinks.read_results(spark, results, "alerts").count() == 1
    replay_and_publish(spark, path, results, threshold=1000.0)
    assert [sinks.read_results(spark, results, n).count() for n in ("runs", "windows", "predictions", "alerts")] == [1, 1, 1, 0]


def test_whole_numbers(spark):
    from tracemill.sources.tables import whole_number

    cells = ["1", "1.0", "1.0000000000000000000001", "1e3", "1.5", "-1", "99999999999", "18446744073709551615", "18446744073709551616", ""]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").selectExpr(whole_number("c")).collect()]
    assert [None if v is None else int(v) for v in got] == [1, 1, None, 1000, None, None, 99999999999, 2**64 - 1, None, None]


def test_filename_display(spark):
    names = [b"report-\xff\n<script>&\\.txt", b"plain name.txt", "é​ 😀".encode(), b"\x7f\x80", b""]
    shown = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n binary").select(
        normalize.filename_display("n")).collect()]
    assert shown == ["report-\\xff\\x0a\\x3cscript\\x3e\\x26\\\\.txt", "plain name.txt", "é\\u200b\\u2028😀", "\\x7f\\x80", ""]


def test_loss_deltas_and_regressions(spark):
    rows = [("r", 1, 4, 0), ("r", 2, 5, 1), ("r", 3, 4, 9), ("q", 1, 2, 2)]
    df = spark.createDataFrame(
        [(run, pos, a, b, 0, 0, 0, 0) for run, pos, a, b in rows],
        "run_id string, pos bigint, " + ", ".join(f"{name} bigint" for name in COUNTERS))
    got = {(r["run_id"], r["pos"]): (r["lost_events"], r["regressed"]) for r in normalize.loss_deltas(df, 2).collect()}
    assert got == {("r", 1): (4, False), ("r", 2): (2, False), ("r", 3): (7, True), ("q", 1): (4, False)}


def test_raw_records_become_contract_records(spark):
    raw = {"schema_version": 1, "record_type": "event", "run_id": "r", "collector_sequence": 1, "monotonic_ns": 5,
           "process": {"boot_id": "b", "tgid": 1, "start_time_ns": 0}, "tid": 1, "event_type": "syscall",
           "attempt": {"name": "openat", "create_intent": True}, "result": {"return_value": -2, "succeeded": False},
           "filename": {"raw_base64": base64.b64encode(b"x").decode(), "display": "x", "truncated": False}}
    exit_ = {**raw, "collector_sequence": 2, "event_type": "process_exit", "attempt": None, "result": None, "filename": None}
    broken = {**raw, "collector_sequence": 3, "filename": None}
    lines = spark.createDataFrame(
        [(json.dumps(r), "f", i) for i, r in enumerate((raw, exit_, broken))], "value string, recording string, pos bigint")
    checked = normalize.protocol_violations(recordings.raw_syscalls(lines))
    assert [r["violations"] for r in checked.orderBy("pos").collect()] == [
        [], [], ["attempt, result or filename of a syscall is missing"]]
    (e,) = normalize.contract_events(checked.filter("size(violations) = 0")).collect()
    assert (e["operation"], e["result"], e["filename_bytes_b64"]) == ("C", -2, "eA==")
    assert normalize.contract_exits(checked).count() == 1


def test_labelled_rows_need_exact_fields(spark):
    good = {"window_id": "w", "capture_id": "c", "capture_hash": "h", "split": "test", "label": 1, "feature_version": 2,
            "feature_names": ["a"], "features": [1, 2.5], "complete": True, "quality": "good"}
    cases = [(good, []), ({**good, "label": True}, ["invalid label"]), ({**good, "x": 1}, ["fields are not those of a labelled window"]),
             ({**good, "features": [True]}, ["features holds other than numbers"]), ("", None), ("[]", ["row is no JSON object"])]
    lines = spark.createDataFrame(
        [(c if isinstance(c, str) else json.dumps(c), i) for i, (c, _) in enumerate(cases)], "value string, pos bigint")
    got = {r["pos"]: r for r in recordings.labeled_rows(lines).collect()}
    assert {i: r["violations"] for i, r in got.items()} == {i: v for i, (_, v) in enumerate(cases) if v is not None}
    assert got[0]["features"] == [1.0, 2.5]


def test_damaged_collector_lines_are_told(spark):
    event_ = {"schema_version": 1, "record_type": "event", "run_id": "r", "collector_sequence": 1, "monotonic_ns": 2**64 - 1,
              "process": {}, "tid": 1, "event_type": "process_exit", "attempt": None, "result": None, "filename": None}
    state = {"schema_version": 1, "record_type": "collector_health", "run_id": "r", "monotonic_ns": 5, "connected": True,
             "loss_counters": {}, "loss_total": 0, "telemetry_complete": True}
    cases = [(event_, None), (state, None), ("{", "invalid JSON"), ("", "blank JSONL record"), ("[1]", "line is no JSON object"),
             ({**event_, "record_type": "x"}, "unknown record type"), ({**state, "connected": 1}, "connected is neither true nor false"),
             ({**event_, "process": 1}, "process is no JSON object"), ({**event_, "attempt": "open"}, "attempt is neither an object nor null"),
             ({**state, "tid": 1}, "record has a field that is not known"), ({**event_, "schema_version": True}, "schema_version is not the known one"),
             ({**event_, "monotonic_ns": -1}, "monotonic_ns is no integer from 0 to 2^64 - 1")]
    lines = spark.createDataFrame(
        [(c if isinstance(c, str) else json.dumps(c), "f", i) for i, (c, _) in enumerate(cases)], "value string, recording string, pos bigint")
    got = {r["pos"]: r["violations"] for r in recordings.collector_violations(lines).collect()}
    assert got == {i: [v] for i, (_, v) in enumerate(cases) if v}
