import csv
import hashlib
import io
import json
import random

import pytest

from tracemill.operators import audit
from tracemill.plans.audit_job import run_audit, write_report
from tracemill.sources import byte_ranges, split_csv, tables

SECOND = 1_000_000_000


def events(spark, *captures):
    """Captures are lists of (ts, pid, kind, pattern); their order gives the index."""
    rows = [("training", f"c{i}", i, n, *e) for i, capture in enumerate(captures) for n, e in enumerate(capture)]
    return spark.createDataFrame(
        rows, "split string, capture_id string, capture_index int, row bigint, ts bigint, pid bigint, kind string, pattern bigint")


def rebuilt(spark, *captures, rows=2):
    return {r["adjusted_id"]: r for r in audit.rebuild_features(events(spark, *captures), bucket_rows=rows).collect()}


def test_offsets_join_captures_and_row_order_beats_time(spark):
    got = rebuilt(spark, [(9, 10001, "O", 0), (1, 10001, "C", 0)], [(5, 1, "D", 0)])
    assert list(got) == [10001]
    assert (got[10001]["OCD"], got[10001]["O_sum"]) == (1, 1)


def test_empty_capture_consumes_an_index(spark):
    assert set(rebuilt(spark, [(0, 1, "O", 0)], [], [(0, 1, "O", 0)])) == {1, 20001}


def test_periods_truncate_toward_zero(spark):
    got = rebuilt(spark, [(SECOND, 1, "O", 0), (1, 1, "O", 0), (2 * SECOND - 1, 1, "O", 0)])
    assert got[1]["O_max"] == 3
    origin = 9_007_199_254_740_993
    big = rebuilt(spark, [(origin, 1, "O", 0), (origin + SECOND - 1, 1, "O", 0), (origin + SECOND, 1, "O", 0)])
    assert (big[1]["O_max"], big[1]["O_sum"]) == (2, 3)


def test_overlapping_trigrams(spark):
    assert rebuilt(spark, [(0, 1, "O", 0)] * 5)[1]["OOO"] == 3


def test_pattern_peaks_come_from_different_periods(spark):
    got = rebuilt(spark, [(0, 1, "O", 3), (SECOND, 1, "O", 1), (0, 1, "C", 1), (SECOND, 1, "C", 4)])
    assert (got[1]["P_max"], got[1]["P_sum"]) == (7, 9)


def test_missing_kind_adds_a_zero_candidate(spark):
    assert rebuilt(spark, [(0, 1, "O", -5), (SECOND, 1, "C", 0)])[1]["P_max"] == 0
    assert rebuilt(spark, [(0, 1, "O", -5), (0, 1, "C", 0)])[1]["P_max"] == -5


def test_wide_table_has_observed_columns_only(spark):
    wide = audit.rebuild_features(events(spark, [(0, 2, "O", 1), (1, 2, "C", 1), (2, 2, "C", 1), (0, 1, "O", 0)]))
    table = audit.wide_features(wide, "training")
    assert table.columns == ["PID", "C_max", "C_sum", "O_max", "O_sum", "P_max", "P_sum", "OCC"]
    assert sorted(map(tuple, table.collect())) == [(1, 0, 0, 1, 1, 0, 0, 0), (2, 2, 2, 1, 1, 3, 3, 1)]


def test_regressions_are_counted_across_ranges(spark):
    df = events(spark, [(t, 1, "O", 0) for t in (5, 4, 4, 9, 1, 2)])
    captures = df.select("split", "capture_id", "capture_index").distinct()
    for size in (1, 2, 3, 100):
        assert audit.capture_summary(captures, df, size).first()["timestamp_regressions"] == 2


def test_numbers_accept_whole_decimals_only(spark):
    from pyspark.sql import functions as F

    cells = ["1", "1.0", "18446744073709551615", "18446744073709551616", "1.5", "NaN", "-1", "x", ""]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(
        F.expr(tables.whole_number("c"))).collect()]
    assert [None if v is None else int(v) for v in got] == [1, 1, 2**64 - 1, None, None, None, None, None, None]


def _write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="") as stream:
        csv.writer(stream, lineterminator="\n").writerows(rows)


def _checkout(root):
    """Two splits with one capture each, their published features and labels."""
    files = {}
    for split, kinds in (("training", [0, 1, 2]), ("testing", [0, 0, 0])):
        rows = [tables.CAPTURE_COLUMNS] + [(n, 7, kind, 0, 1, 0, 0, 0, 0, "a,b") for n, kind in enumerate(kinds)]
        _write(root / f"logs/{split}/a.csv", rows)
        names = ["C_max", "C_sum", "D_max", "D_sum", "O_max", "O_sum", "P_max", "P_sum", "OCD"] if split == "training" else [
            "O_max", "O_sum", "P_max", "P_sum", "OOO"]
        values = [1, 1, 1, 1, 1, 1, 3, 3, 1] if split == "training" else [3, 3, 3, 3, 1]
        _write(root / f"data/{split}_data.csv", [["PID", *names], [7, *values]])
        _write(root / f"data/{split}_labels.csv", [["PID"], ["7.0"], [8]])
        files[f"logs/{split}/a.csv"] = ("capture", split)
        files[f"data/{split}_data.csv"] = ("features", split)
        files[f"data/{split}_labels.csv"] = ("labels", split)
    entries = []
    for path, (kind, split) in files.items():
        content = (root / path).read_bytes()
        entries.append({"path": path, "sha256": hashlib.sha256(content).hexdigest(), "size": len(content), "kind": kind,
                        "capture_id": path if kind == "capture" else None, "split": split})
    return {"schema_version": 1, "repository": "https://example.invalid/x", "commit": "0" * 40, "files": entries}


def test_audit_of_a_small_checkout(spark, tmp_path):
    root = tmp_path / "checkout"
    document = _checkout(root)
    manifest_path = tmp_path / "manifest.json"
    manifest_path.write_text(json.dumps(document))
    manifest = tables.read_file_manifest(spark, str(manifest_path))
    expected = {"training": (1, 2), "testing": (1, 2)}
    report = run_audit(spark, str(root), manifest, expected)
    assert report.verdict.first()["ok"], report.verdict.first()
    assert report.captures.filter("events = 3").count() == 2

    # A bad split is reported, the other one is audited.
    (root / "data/training_data.csv").write_text("PID,C_max,D_max,Z\n")
    (root / "data/testing_labels.csv").unlink()
    report = run_audit(spark, str(root), manifest, expected)
    assert {r["split"]: (r["status"], r["reason"]) for r in report.splits.collect()} == {
        "training": ("invalid", "data/training_data.csv: unexpected feature schema"),
        "testing": ("invalid", "data/testing_labels.csv: file is not available")}
    _write(root / "data/testing_labels.csv", [["PID"], ["7.0"], [8]])
    (root / "logs/training/a.csv").write_text("")
    report = run_audit(spark, str(root), manifest, expected)
    assert {r["split"]: r["status"] for r in report.splits.collect()} == {"training": "invalid", "testing": "audited"}
    assert {(r["path"], r["violation"]) for r in report.problems.collect()} == {
        ("data/training_data.csv", "unexpected feature schema"), ("logs/training/a.csv", "empty schema or duplicate columns")}
    verdict = report.verdict.first()
    assert not verdict["ok"] and verdict["invalid_splits"] == 1 and report.differences.count() == 0
    assert {r["split"] for r in report.captures.collect()} == {"testing"}
    _write(root / "logs/training/a.csv", [tables.CAPTURE_COLUMNS] + [(n, 7, kind, 0, 1, 0, 0, 0, 0, "a,b") for n, kind in enumerate([0, 1, 2])])
    _write(root / "data/training_data.csv", [["PID", "C_sum", "C_max", "EEE"], [7, 2, 1, 0], [9, 0, 0, 0]])
    (root / "logs/extra.csv").write_text("PID\n1\n")
    report = run_audit(spark, str(root), manifest, expected)
    verdict = report.verdict.first()
    assert not verdict["ok"] and verdict["unmanifested_files"] == 1 and verdict["input_mismatches"] == 1
    kinds = {(r["kind"], r["pid"] and int(r["pid"]), r["feature"]) for r in report.differences.collect()}
    assert ("cell", 7, "C_sum") in kinds and ("missing_reconstructed_ids", 9, None) in kinds
    assert ("missing_reconstructed_columns", None, "EEE") in kinds and ("column_order_differs", None, None) in kinds
    assert ("extra_reconstructed_columns", None, "OCD") in kinds
    write_report(report, str(tmp_path / "report"))
    lines = spark.read.csv(str(tmp_path / "report/differences"), header=True)
    assert lines.count() == report.differences.count()


def test_malformed_captures_are_reported(spark, tmp_path):
    good = [1, 2, 0, 0, 0, 0, 0, 0, 0, "f"]
    _write(tmp_path / "a.csv", [tables.CAPTURE_COLUMNS, good, good[:-1], [1, 2, 4, *good[3:]], ["x", *good[1:]]])
    got = tables.read_captures(spark, str(tmp_path / "a.csv")).orderBy("row").collect()
    assert [r["violations"] for r in got] == [
        [], ["malformed row width"], ["unknown event type"], ["expected a nonnegative 64-bit integer"]]
    for name, header in (("b", tables.CAPTURE_COLUMNS[::-1]), ("c", [c.lower() for c in tables.CAPTURE_COLUMNS])):
        _write(tmp_path / f"{name}.csv", [header, good])
        got = tables.read_captures(spark, str(tmp_path / f"{name}.csv")).orderBy("row").collect()
        assert [r["violations"] for r in got] == [["unexpected capture schema"], []]


def by_the_csv_module(content: bytes):
    """The rows of a file as the standard library reads them, or None where a quote is wrong."""
    try:
        return [row for row in csv.reader(io.StringIO(content.decode(), newline=""), strict=True)]
    except csv.Error:
        return None


def test_rows_of_files_cut_anywhere_equal_the_csv_module(spark, tmp_path):
    rng = random.Random(6)
    contents = []
    for n in range(30):
        rows = [[rng.choice(["a", "", "b c", 'q"t', "x,y", "two\nlines", "cr\rin", "crlf\r\nin", '"', "\n\n"])
                 for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 12))]
        out = io.StringIO()
        csv.writer(out, lineterminator=rng.choice(["\n", "\r\n", "\r"])).writerows(rows)
        text = out.getvalue()
        if n % 3 == 0:  # damaged files
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(['"', "\n", ",", 'x"']) + text[at:]
        contents.append(text.rstrip("\n").encode() if n % 5 == 0 else text.encode())
        (tmp_path / f"{n:02}.csv").write_bytes(contents[-1])
    for block, ranges in (("1m", 4096), ("30b", 3)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = {}
        for r in split_csv.read_csv_rows(spark, str(tmp_path), ranges).collect():
            got.setdefault(int(r["path"][-6:-4]), []).append((r["pos"], r["sub"], r["cells"], r["problem"]))
        for n, content in enumerate(contents):
            want, rows = by_the_csv_module(content), sorted(got.get(n, []), key=lambda r: r[:2])
            if want is None:
                assert any(r[3] == split_csv.QUOTING for r in rows), content
            else:
                assert [r[2] for r in rows] == want, content
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_overlap_lists_each_file_once(spark):
    rows = [(f"t{i}", "h", "training", "capture") for i in range(3)] + [("u1", "h", "testing", "capture"), ("u2", "g", "testing", "capture")]
    inventory = spark.createDataFrame(rows, "path string, actual_sha256 string, split string, kind string")
    got = {r["path"]: r["partners"] for r in audit.content_overlap(inventory).collect()}
    assert got == {"t0": 1, "t1": 1, "t2": 1, "u1": 3}


def test_files_of_any_size_are_hashed_in_ranges(spark, tmp_path):
    big = tmp_path / "deep" / "big.bin"
    big.parent.mkdir()
    with big.open("wb") as stream:
        stream.truncate((2 << 30) + 5)  # a sparse file takes no disk
    small = {"a.txt": b"abc", "empty": b"", "deep/b.txt": b"x" * 100}
    for name, content in small.items():
        (tmp_path / name).write_bytes(content)
    got = {r["path"]: (r["actual_size"], r["actual_sha256"]) for r in tables.file_inventory(spark, str(tmp_path)).collect()}
    zeros = hashlib.sha256()
    for _ in range(2048):
        zeros.update(bytes(1 << 20))
    zeros.update(bytes(5))
    assert got == {**{n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in small.items()},
                   "deep/big.bin": ((2 << 30) + 5, zeros.hexdigest())}


def test_changed_blocks_are_found_by_their_digests(spark, tmp_path):
    for name, size in (("a", 35), ("b", 20), ("c", 0), ("d", 5)):
        (tmp_path / name).write_bytes(bytes(range(size)))

    def blocks():
        rows = byte_ranges.block_digests(spark, str(tmp_path), block_bytes=10).collect()
        return spark.createDataFrame(rows, "path string, size bigint, block bigint, block_size bigint, sha256 string")

    before = blocks()
    assert sorted((r["path"], r["block"], r["block_size"]) for r in before.collect()) == [
        ("a", 0, 10), ("a", 1, 10), ("a", 2, 10), ("a", 3, 5), ("b", 0, 10), ("b", 1, 10), ("c", 0, 0), ("d", 0, 5)]
    (tmp_path / "a").write_bytes(bytes(range(12)) + b"!" + bytes(range(13, 35)))
    (tmp_path / "d").unlink()
    changed = byte_ranges.changed_blocks(before, blocks()).collect()
    assert sorted((r["path"], r["block"], r["after"] is None) for r in changed) == [("a", 1, False), ("d", 0, True)]
    tree = {r["path"]: (r["n_blocks"], r["tree_sha256"]) for r in byte_ranges.tree_digests(before).collect()}
    halves = [hashlib.sha256(bytes(range(20))[i:i + 10]).hexdigest() for i in (0, 10)]
    assert tree["b"] == (2, hashlib.sha256("".join(halves).encode()).hexdigest())
