"""Operators on pages and embeddings, the SQL counterparts and the pipeline."""

import hashlib
import math
import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.builders import documents, frame
from tracemill.llm import queries, toxicity, topk, url_filter, warc
from tracemill.llm.expected_sql import STATEMENTS

PAGES = "page_id bigint, url string, html string"
FOLDER = "/root/testdata/sf0.001"


# URL filter


def link(*hosts):
    return "".join(f'<a href="https://{h}/x">y</a>' for h in hosts)


def pages():
    return [
        (1, "https://Good.Example.org/fr/1?q#z", link("middle.com", "other.com")), (2, "http://bad.net/x", link("bad.net")),
        (3, "https://middle.com", link("other.com")), (4, "https://farm.com/a", link("bad.net", "bad.net", "far.net")),
        (5, "https://other.com#f", None), (6, None, link("bad.net")), (7, "no scheme", ""), (8, "https://a.example.net/en/", ""),
        (9, "https://a.example.net/de/", ""), (10, "https://x.example.com/de/1", ""), (11, "https://example.com/en/1", ""),
        (12, "https://notnet/x", ""), (13, "http://www.net", ""), (4, "https://farm.com/a", link("bad.net", "bad.net", "far.net")),
        (14, "https://org/fr/", "<img src='//near.com/p'>")]


def brute_ranks(edges, seeds, damping=0.85):
    """The fixed point, from the linear system."""
    hosts = sorted({h for e in edges for h in e} | set(seeds))
    at, out = {h: i for i, h in enumerate(hosts)}, Counter()
    for (a, _), n in edges.items():
        out[a] += n
    flow = np.zeros((len(hosts), len(hosts)))
    for (a, b), n in edges.items():
        flow[at[b], at[a]] += damping * n / out[a]
    base = np.array([(1 - damping) * seeds.get(h, 0) for h in hosts])
    return dict(zip(hosts, np.linalg.solve(np.eye(len(hosts)) - flow, base)))


def test_rules_and_propagation_equal_brute_force(spark):
    got = url_filter.judge(spark.createDataFrame(pages(), PAGES)).collect()
    assert len(got) == len(pages())
    by_id = {r.page_id: r for r in got}
    assert (by_id[1].host, by_id[1].path, by_id[1].rule, by_id[1].verdict) == ("good.example.org", "/fr/1", "org/fr/", "allow")
    assert (by_id[3].host, by_id[3].path, by_id[3].rule) == ("middle.com", "", None)
    assert (by_id[6].host, by_id[6].path, by_id[7].host, by_id[7].verdict) == ("", "", "", "allow")
    assert [by_id[i].rule for i in (2, 8, 9, 10, 11, 12, 13, 14)] == [
        "net/", "example.net/en/", "net/", "example.com/de/", None, None, None, "org/fr/"]
    hosts = Counter(r.host for r in got if r.host)
    good, bad, edges = Counter(), Counter(), Counter()
    for r in got:
        good[r.host] += r.rule is not None and r.verdict == "allow"
        bad[r.host] += r.rule is not None and r.verdict == "block"
    for page_id, _, html in pages():
        for piece in (html or "").split("//")[1:]:
            target = piece.split("/")[0]
            if by_id[page_id].host and target != by_id[page_id].host:
                edges[by_id[page_id].host, target] += 1
    trust = brute_ranks(edges, {h: good[h] / n for h, n in hosts.items()})
    distrust = brute_ranks({(b, a): n for (a, b), n in edges.items()}, {h: bad[h] / n for h, n in hosts.items()})
    for r in got:
        assert math.isclose(r.trust, trust.get(r.host, 0) / 0.15, abs_tol=1e-4)
        assert math.isclose(r.distrust, distrust.get(r.host, 0) / 0.15, abs_tol=1e-4)
        if r.rule is None:
            assert r.verdict == ("block" if r.distrust >= 0.5 and r.distrust > r.trust else "allow")
    assert by_id[4].verdict == "block" and by_id[5].verdict == "allow"


def test_hosts_that_link_to_each_other_are_ranked_to_the_end(spark):
    """Twenty steps would leave the distrust of both below the threshold."""
    rows, n = [], 0
    for _ in range(1000):
        n += 1
        rows.append((n, f"http://a.example.com/{'de' if n <= 164 else 'x'}/", link("b.com") if n == 500 else None))
    rows.append((2000, "http://b.com/", link("a.example.com")))
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, PAGES)).collect()}
    share = 0.164
    want = brute_ranks({("a.example.com", "b.com"): 1, ("b.com", "a.example.com"): 1}, {"a.example.com": share})
    assert math.isclose(got[500].distrust, want["a.example.com"] / 0.15, abs_tol=1e-5)
    assert math.isclose(got[2000].distrust, want["b.com"] / 0.15, abs_tol=1e-5)
    assert (got[500].distrust > 0.5) == (got[500].verdict == "block") and got[500].verdict == "block"


def test_url_filter_of_an_empty_table(spark):
    assert url_filter.judge(spark.createDataFrame([], PAGES)).count() == 0


# WARC


def captures():
    same, long = "ä" * 600, "<p>" + "z" * 50_000
    return [(1, "http://b.org/x", same), (2, "http://a.org/y?q=1", same), (3, None, long), (4, "http://a.org/", "short"),
            (5, "http://a.org/\r\nz", "short"), (6, "http://c.org", None), (7, "x", ""), (2, "http://a.org/y?q=1", same),
            (8, "http://a.org/y?q=1", long), (None, "http://d.org", same)]


def test_archives_give_back_every_page(spark):
    got = warc.archive_and_read(
        spark.createDataFrame(captures(), PAGES).repartition(3), archive_bytes=1000, range_rows=2).collect()
    want = Counter()
    largest = {}
    for i, _, html in captures():
        if i is not None:
            largest[html] = max(i, largest.get(html, i))
    for i, _, html in captures():
        body = (html or "").encode()
        revisit = len(body) >= 1000 and largest[html] != i
        want[i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response",
             largest[html] if revisit else None] += 1
    assert Counter(tuple(r) for r in got) == want


def test_merged_index_is_in_global_order(spark, tmp_path):
    from tracemill.llm.scratch import Scratch

    rows = [(i, f"http://h{i * 7 % 10}.org/{i * 13 % 50}", "x") for i in range(100)] + [(i, "http://hot.org/", "x") for i in range(100, 160)]
    runs = warc.write_archives(warc.roles(spark.createDataFrame(rows, PAGES).repartition(4)), str(tmp_path), archive_bytes=7)
    scratch = Scratch(spark, "test")
    runs = scratch.keep(runs, "runs")
    index = [tuple(r) for r in warc.merged_index(runs, scratch, range_rows=9).orderBy("range", "place").select(
        "url_key", "captured", "page_id").collect()]
    assert index == sorted(index) and len(index) == 160
    assert runs.select("archive").distinct().count() > 10


def test_records_are_read_in_several_tasks(spark, tmp_path):
    from tracemill.llm.scratch import Scratch

    rows = spark.createDataFrame([(i, f"http://h{i}.org/", "x" * 5000) for i in range(200)], PAGES).repartition(4)
    scratch = Scratch(spark, "test")
    runs = scratch.keep(warc.write_archives(warc.roles(rows), str(tmp_path), archive_bytes=50_000), "runs")
    read = warc.read_records(warc.merged_index(runs, scratch), str(tmp_path))
    assert read.count() == 200 and read.select(F.spark_partition_id()).distinct().count() > 3


def test_url_keys_reverse_the_host_alone():
    keys = {"http://a.Example.org:8080/x?Q": "org,example,a:8080)/x?q", "https://org": "org)", "http://b.org?x#y": "org,b)?x",
            None: ")", "no scheme": "no scheme)"}
    assert {u: warc.url_key(u) for u in keys} == keys


def test_loser_tree_merges_any_number_of_runs():
    import random

    rng = random.Random(2)
    for k in range(0, 12):
        runs = [sorted((rng.randrange(20),) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_warc_of_an_empty_table(spark):
    assert warc.archive_and_read(spark.createDataFrame([], PAGES)).count() == 0


# Top-k


def vectors():
    import random

    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(260)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]
    rows += [(400, None), (450, [None] * 6), (500, [float("nan")] + [0.0] * 5), (550, [float("inf")] * 6), (600, [0.5]),
             (650, []), (None, [0.1] * 6), (700, [0.0] * 6), (5, rows[5][1])]
    return rows


def test_top_k_equals_brute_force(spark):
    table = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>").repartition(3)
    usable = []
    for r in table.collect():
        v = r.embedding
        if r.vec_id is not None and v and all(x is not None and math.isfinite(x) for x in v):
            usable.append((r.vec_id, [math.floor(256 * x) for x in v] + [0] * (6 - len(v))))
    got = topk.top_k(table.where("vec_id % 50 = 0"), table, block_rows=32).collect()
    by_query = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by_query.setdefault(r.query_id, []).append((r.vec_id, r.score))
    asked = {i: v for i, v in usable if i % 50 == 0}
    assert set(by_query) == set(asked)
    for i, q in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i)[:5]
        assert by_query[i] == [(j, -s) for s, j in scored]


def clustered(n=4000, dim=16, clusters=40, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim)) * 60
    return np.floor(centres[rng.integers(clusters, size=n)] + rng.standard_normal((n, dim)))


@pytest.mark.parametrize("x", [clustered(), clustered(300, 2, 5), np.floor(np.random.default_rng(1).standard_normal((700, 3)) * 40),
                               np.zeros((50, 4)), np.repeat(clustered(40, 3, 4), 30, 0), np.array([[1.0, 2.0]])])
def test_cover_trees_cover_separate_and_nest(x):
    tree = topk.CoverTree.build(x)
    assert (tree.rows == x[tree.order]).all() and sorted(tree.order) == list(range(len(x)))
    seen = np.zeros(len(x), int)
    for node in range(len(tree.radii)):
        rows = tree.rows[tree.low[node]:tree.high[node]]
        reach = np.sqrt(((rows - tree.centres[node]) ** 2).sum(1))
        assert reach.max() <= tree.radii[node] + 1e-9
        kids = tree.children(node)
        if not len(kids):
            seen[tree.low[node]:tree.high[node]] += 1
            continue
        cover = topk.SHRINK * tree.radii[node]
        assert (tree.radii[kids[~tree.loose[kids]]] <= cover + 1e-9).all() and tree.loose[kids[:-1]].sum() == 0
        # Centres of children, with those that stand alone.
        alone = tree.rows[tree.low[kids[-1]]:tree.high[kids[-1]]] if tree.loose[kids[-1]] else tree.rows[:0]
        centres = np.vstack([tree.centres[kids[~tree.loose[kids]]], alone])
        assert (centres == tree.centres[node]).all(1).any()
        apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))
        assert (apart[~np.eye(len(centres), dtype=bool)] > cover - 1e-9).all()
        assert (tree.low[kids[0]], tree.high[kids[-1]]) == (tree.low[node], tree.high[node])
    assert (seen == 1).all()


def test_clustered_vectors_are_pruned():
    x = clustered()
    queries, data = topk.CoverTree.build(x[::50]), topk.CoverTree.build(x)
    best = topk.Best(np.arange(len(x))[::50][queries.order], 5)
    scored = topk.dual_search(queries, data, np.arange(len(x))[data.order], best)
    assert scored < len(queries.rows) * len(x) / 3
    exact = x[::50][queries.order] @ x.T
    exact[np.arange(len(exact)), best.own] = -np.inf
    assert (best.scores == -np.sort(-exact, 1)[:, :5]).all()


def test_a_repeated_id_and_many_copies_stay_in_small_blocks(spark):
    from tracemill.llm.scratch import Scratch

    rows = spark.createDataFrame([(7, [1.0, 2.0])] * 300 + [(i, [float(i), 1.0]) for i in range(50)], "vec_id long, v array<double>")
    blocks = topk._blocks(rows.repartition(4), 2, 32, Scratch(spark, "test"), "data").select("n").collect()
    assert sum(r.n for r in blocks) == 350 and max(r.n for r in blocks) <= 64
    table = rows.select("vec_id", F.col("v").alias("embedding"))
    got = topk.top_k(table.where("vec_id = 49"), table, block_rows=32).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got)] == [(i + 1, 48 - i, 256 * 256 * ((48 - i) * 49 + 1)) for i in range(5)]


def test_top_k_of_few_and_no_rows(spark):
    few = spark.createDataFrame([(50, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(few.where("vec_id % 50 = 0"), few).collect()] == [(50, 1, 1, 256 * 512)]
    assert topk.top_k(few.limit(0), few.limit(0)).count() == 0


# Registered queries and the pipeline


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not present")
@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_queries_equal_their_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = connection.execute(STATEMENTS[name])
    columns = sorted(d[0] for d in result.description)
    want = connection.execute(f"SELECT {', '.join(columns)} FROM ({STATEMENTS[name]})").fetchall()
    frame_ = queries.QUERIES[name](spark, FOLDER)
    assert sorted(frame_.columns) == columns
    assert Counter(tuple(r[c] for c in columns) for r in frame_.collect()) == Counter(want)


def test_pipeline_stages(spark, tmp_path):
    import random

    from tests.llm.builders import paragraph

    rng = random.Random(9)
    rows = [(i, paragraph(rng, 20), "en", f"s{i % 4}", 0) for i in range(80)]
    bad = "blockhead nincompoop numskull"
    rows = [(i, t + (" " + bad) * 2 if i % 8 == 0 else t, *rest) for i, t, *rest in rows]
    rows.append((200, rows[1][1], "en", "s1", 0))
    rows.append((201, rows[2][1].replace("stone", "stones", 1), "en", "s1", 0))
    leaked = paragraph(rng, 4)
    rows.append((202, rows[3][1][::-1] + " " + leaked, "en", "s2", 0))
    rows += [(None, None, None, None, None), (203, "", None, None, 0)]
    folder = str(tmp_path)
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(80)], "doc_id long, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leaked)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    kept = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert kept.columns == names
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(
        r[0] or -1 for r in rows if r[0] is None or r[0] >= 80 or r[0] % 8)
    once = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    assert once.columns == names
    assert sorted(r.doc_id or -1 for r in once.collect() if r.doc_id != 0) == sorted(
        r[0] or -1 for r in rows if r[0] not in (0, 200, 201))
    clean = corpus_pipeline.drop_contaminated(spark, docs, folder)
    assert clean.columns == names and clean.count() == len(rows) - 1 and clean.where("doc_id = 202").count() == 0
    assert corpus_pipeline.mix_sources(spark, docs, folder).columns == names
    result = corpus_pipeline.run(spark, folder)
    assert {"shard", "shard_bytes"} <= set(result.columns)
    left = {r.doc_id for r in result.collect()}
    assert left and not left & {200, 201, 202, 8, 16} and documents()
    assert toxicity.held_out is not None


def test_near_duplicates_are_removed_by_row_and_not_by_id(spark):
    import random

    from tests.llm.builders import paragraph

    rng = random.Random(31)
    texts = [paragraph(rng, 25) for _ in range(6)]
    edited = texts[0].replace(texts[0].split()[40], "changed", 1)
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[2]), (7, texts[2]), (8, edited), (None, texts[3]), (None, texts[3]),
            (None, texts[1]), (9, texts[4]), (5, texts[5]), (9, texts[5]), (None, ""), (None, ""), (3, " "), (3, " ")]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in rows])
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == Counter([(7, texts[0]), (7, texts[1]), (7, texts[2]), (None, texts[3]), (9, texts[4]), (5, texts[5]),
                           (None, ""), (None, ""), (3, " ")])
