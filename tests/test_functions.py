import hashlib
import json
import random

from pyspark.sql import functions as F

from tracemill.functions.json_text import json_double, json_string, window_id
from tracemill.functions.ordered import order_bucket, previous, running, trigram_profile


def _random_rows(seed, n=300):
    rng = random.Random(seed)
    rows, pos = [], 0
    for _ in range(n):
        pos += rng.choice([1, 1, 2, 5])
        rows.append((rng.choice("aab"), pos, rng.randint(-50, 50), rng.choice("XYZ")))
    return rows


def test_running_and_previous_over_buckets_equal_plain_loops(spark):
    rows = _random_rows(1)
    df = spark.createDataFrame(rows, "k string, pos bigint, v bigint, s string").repartition(5).withColumn(
        "b", order_bucket("pos", 7))
    got = running(df, ["k"], [F.col("pos")], ["b"], {
        "high": ("max", F.col("v")), "total": ("sum", F.col("v")), "n": ("count", F.lit(1))})
    got = previous(got, ["k"], [F.col("pos")], ["b"], {"before": F.col("v")})
    state = {}
    for k, pos, v, _ in rows:
        high, total, n, last = state.get(k, (v, 0, 0, None))
        state[k] = (max(high, v), total + v, n + 1, v)
        state[k, pos] = (max(high, v), total + v, n + 1, last)
    for r in got.collect():
        assert (r["high"], r["total"], r["n"], r["before"]) == state[r["k"], r["pos"]]


def test_trigrams_cross_sparse_buckets(spark):
    for seed, size in ((2, 1), (3, 2), (4, 5), (5, 1000)):
        rows = _random_rows(seed)
        df = spark.createDataFrame(rows, "k string, pos bigint, v bigint, s string").repartition(3).withColumn(
            "b", order_bucket("pos", size))
        got = {r["k"]: r for r in trigram_profile(df, ["k"], [F.col("pos")], ["b"], "s", "XYZ").collect()}
        for key in "ab":
            text = "".join(s for k, _, _, s in rows if k == key)
            for gram in ("XYZ", "XXX", "ZYX", "YYZ"):
                assert got[key][gram] == sum(text[i:i + 3] == gram for i in range(len(text))), (seed, gram)
            assert got[key]["X_sum"] == text.count("X")


def test_json_text_equals_a_compact_encoder(spark):
    texts = ["", "plain", 'q"\\', "tab\tnl\nret\r\b\f", "é", "\u007f", "line ", "😀x", "\x00\x1f", "a\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", F.expr(json_string("t")).alias("a"), F.expr(json_string("t", ascii_only=False)).alias("u")).collect()
    for r in got:
        assert r["a"] == json.dumps(r["t"])
        assert r["u"] == json.dumps(r["t"], ensure_ascii=False)
    numbers = [0.0, -0.0, 1.0, 33.0, 1e7, 123456789.5, 1e15, 1e16, 1.5e20, 0.5, 0.001, 0.00012, 1.5e-5, -2.25, 1e-300]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", F.expr(json_double("x")).alias("t"))
    for r in rows.collect():
        assert r["t"] == json.dumps(r["x"])


def test_window_id_is_the_digest_of_its_identity(spark):
    rows = [("run", "boot", 5, 7, 0, 10), ("rün\n", 'b"', 4242, 2**40, 10, 20)]
    df = spark.createDataFrame(
        rows, "run_id string, boot_id string, tgid bigint, start_time_ns bigint, start_ns bigint, end_ns bigint")
    got = [r[0] for r in df.select(window_id()).collect()]
    assert got == [hashlib.sha256(json.dumps([*r, 2], separators=(",", ":")).encode()).hexdigest() for r in rows]


def test_ranks_do_not_depend_on_ranges(spark):
    from tracemill.functions.ordered import ranks

    rows = [("ab"[i % 7 == 0], i * 37 % 101 // 5, i) for i in range(101)]
    want = {}
    for key in "ab":
        for rank, r in enumerate(sorted(r for r in rows if r[0] == key)):
            want[r] = rank
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(3)
    for size in (1, 2, 3, 1000):
        assert {tuple(r)[:3]: r["rank"] for r in ranks(df, ["k"], ["v", "id"], "rank", size).collect()} == want
    assert ranks(df.limit(0), ["k"], ["v", "id"], "rank").count() == 0
