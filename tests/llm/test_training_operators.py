"""Operators that prepare training examples, vectors and scores."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.builders import documents, frame, with_clashes
from tracemill.llm import fill_in_middle as fim, language_model as lm, whitening

# Fill in the middle


def brute_example(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by plain string slices."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not n or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def mixed_texts():
    rng = random.Random(5)
    letters = "ab cé漢😀\n<>P"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["has <P> inside", "a<S>", "<M>", "almost <S", "ends with <", "😀", "é", "x", "", None, "漢" * 40_000, "y" * 400_000]
    return [(i, t, None, None, None) for i, t in enumerate(texts)] + documents() + [(None, "no id", None, None, None)]


def test_examples_equal_string_slices_and_give_back_the_text(spark):
    rows = mixed_texts()
    made = fim.transform(frame(spark, rows).repartition(3)).withColumn("back", fim.restored("fim_text", "fim_form"))
    got = sorted(((r.doc_id, r.text, r.fim_units, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim_text, r.back)
                  for r in made.collect()), key=repr)
    assert got == sorted(((i, t, *brute_example(i, t), t or "") for i, t, *_ in rows), key=repr)
    assert {g[3] for g in got} == {"plain", "psm", "spm"}


def test_examples_in_slices_of_few_bytes(monkeypatch):
    monkeypatch.setattr(fim, "SLICE_BYTES", 7)
    texts = ["ab", "", "漢字漢字漢字", "é", "", "abcdefghij"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    parts = list(fim._slices(iter([batch, batch.slice(2, 3), batch.slice(0, 0)]), 0))
    assert [v for p in parts for v in p.column(0).to_pylist()] == texts + texts[2:5]
    assert len(parts) > 5


def test_index_converts_in_both_directions():
    text = "aé漢😀b😀" * 50
    index = fim.ExceptionIndex(np.frombuffer(text.encode(), np.uint8))
    chars = np.arange(len(text) + 1)
    offsets = np.array([len(text[:i].encode()) for i in chars])
    assert (index.to_bytes(chars) == offsets).all() and (index.to_chars(offsets) == chars).all()


@pytest.mark.parametrize("plain_from,spm_below,form", [(0, 0, "plain"), (100, 0, "psm"), (100, 100, "spm")])
def test_rates_choose_the_form(spark, plain_from, spm_below, form):
    made = fim.transform(frame(spark, [(i, "some text", "", "", 0) for i in range(20)]), plain_from, spm_below)
    assert {r.fim_form for r in made.collect()} == {form}


def test_examples_of_awkward_tables(spark):
    assert fim.transform(frame(spark, [])).count() == 0
    docs = with_clashes(frame(spark, documents())).selectExpr("*", "1 AS fim_form", "2 AS body", "3 AS h1", "4 AS n")
    made = fim.transform(docs)
    assert made.columns == [c for c in docs.columns if c != "fim_form"] + list(fim.ADDED)
    assert made.count() == len(documents()) and {r.fim_form for r in made.collect()} <= {"plain", "psm", "spm"}


# Whitening

VECTORS = "vec_id bigint, embedding array<float>, label int"


def vectors(n=90, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) * np.linspace(0.2, 1.5, dim)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [1.0, None] + [0.0] * (dim - 2), 1), (902, [float("nan")] * dim, 1),
           (903, [float("inf")] + [0.0] * (dim - 1), 1), (904, [], 1), (905, [0.5, -0.25], 1), (906, [1e30] * dim, 1)]
    return rows + odd + [rows[0], rows[0], (None, rows[1][1], None)]


def brute_whitening(rows, dim, k):
    """Ids, exact deviations, whitened columns up to sign, and shares of variance."""
    fine = [(i, [float(np.float32(c)) for c in v] + [0.0] * (dim - len(v))) for i, v, _ in rows
            if v is not None and all(c is not None and abs(c) < 2 ** 31 for c in v)]
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in fine], dtype=object)
    n, sums = len(x), x.sum(0)
    deviation = ((n * x - sums) ** 2).sum(1)
    centred = ((n * x - sums) / n).astype(float)
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return [i for i, _ in fine], deviation, centred @ basis / np.sqrt(values), values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("dim,k", [(12, 8), (3, 8), (40, 2)])
def test_whitened_vectors_equal_a_dense_decomposition(spark, dim, k):
    rows = vectors(dim=dim)
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(3), k, block_rows=16).toPandas()
    ids, deviation, whitened, explained = brute_whitening(rows, dim, min(k, dim))
    assert len(got) == len(ids) * min(k, dim) and (got["n"] == len(ids)).all()
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-10
    for c in range(min(k, dim)):
        part = got[got.component == c + 1]
        key = lambda i, d, w: (-1 if i is None or i != i else int(i), int(d), round(float(w), 7) + 0.0)
        want = [sorted(key(*r) for r in zip(ids, deviation, sign * whitened[:, c])) for sign in (1, -1)]
        assert sorted(key(*r) for r in zip(part.vec_id, part.deviation, part.whitened)) in want
        assert np.allclose(part.explained, explained[c], rtol=1e-10)


def test_whitening_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0], 0)], [(i, [1.0, 2.0], 0) for i in range(5)], [(1, None, 0)], [(1, [], 0)]):
        got = whitening.whiten(spark.createDataFrame(rows, VECTORS))
        assert got.columns[0] == "vec_id" and got.count() == 0
    # Three vectors span a plane: two components.
    flat = whitening.whiten(with_clashes(spark.createDataFrame(
        [(i, [float(i == j) for j in range(9)], 0) for i in range(3)], VECTORS))).collect()
    assert sorted((r.vec_id, r.component) for r in flat) == [(i, c) for i in range(3) for c in (1, 2)]


def test_deviations_beyond_63_bits_are_null_and_others_exact():
    x = np.array([[1 << 40, 0], [0, 1 << 20]], dtype=np.int64)
    d = whitening._deviations(x, 1 << 25, np.array([1 << 60, 5], dtype=object))
    assert d.tolist() == [[(1 << 65) - (1 << 60), -5], [-(1 << 60), (1 << 45) - 5]]
    assert whitening._squares(d) == [None, None]
    assert whitening._squares(np.array([[3, -4], [2 << 30, 1 << 30]])) == [25, 5 << 60]


def test_jacobi_davidson_finds_clustered_and_repeated_eigenvalues():
    rng = np.random.default_rng(2)
    values = np.concatenate([[5, 5, 5 - 1e-9, 4.999], np.linspace(1, 4.99, 196)])
    basis = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    matrix = (basis * values) @ basis.T
    found, directions = whitening.jacobi_davidson(lambda u: matrix @ u, 200, 6)
    assert np.allclose(found, np.sort(values)[::-1][:6], rtol=1e-13, atol=0)
    assert np.abs(matrix @ directions - directions * found).max() < 1e-12
    assert np.allclose(directions.T @ directions, np.eye(6), atol=1e-13)


def test_minres_solves_indefinite_systems_side_by_side():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((30, 30))
    a, shifts, right = a + a.T, np.array([0.0, 3.0, -2.0]), rng.standard_normal((30, 3))
    x = whitening.minres(lambda v: a @ v - v * shifts, right, 200, 1e-12)
    assert np.allclose(a @ x - x * shifts, right, atol=1e-8)


# Language model


def brute_scores(rows, order):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) from plain counts."""
    texts = []
    for doc_id, text, *_ in rows:
        held = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2
        texts.append((doc_id, held, (text or "").encode().lower().split() + [None]))
    counts = [Counter() for _ in range(order)]
    for _, held, words in texts:
        for k in range(order if not held else 0):
            counts[k].update(tuple(words[i - k:i + 1]) for i in range(k, len(words)))
    stats = np.zeros((order, 66))
    for k, c in enumerate(counts):
        stats[k, :2] = len(c), sum(n == 1 for n in c.values())
        for n in c.values():
            stats[k, 2 + n.bit_length() - 1] += n
    curve = lm.Smoothing.of(stats)
    n, v = sum(counts[0].values()), len(counts[0])

    def probability(context, word):
        if not context:
            return (counts[0][(word,)] + 1) / (n + v + 1)
        shorter, held = probability(context[1:], word), counts[len(context) - 1][context]
        if not held:
            return shorter
        left = 1 / (1 + curve.slopes[len(context) - 1] * np.log1p(held))
        return (1 - left) * counts[len(context)][(*context, word)] / held + left * shorter

    return [(d, held, len(w), sum(counts[0][(x,)] > 0 for x in w), n,
             sum(np.log10((counts[0][(x,)] + 1) / (n + v + 1)) for x in w),
             sum(np.log10(probability(tuple(w[max(0, i - order + 1):i]), x)) for i, x in enumerate(w)))
            for d, held, w in texts], probability, counts


def lm_rows():
    rng = random.Random(8)
    words = ["Alpha", "beta", "BETA", "gamma", "Ünit", "ünit", "x y", "d.", "漢字"]
    texts = [" \t\n\r\x0b\x0c"[i % 6].join(rng.choices(words, [40, 20, 9, 5, 4, 3, 2, 2, 1], k=rng.randrange(30))) for i in range(120)]
    texts += ["beta alpha " * 300, "w" * 5000 + " alpha", "only here", " alpha ", texts[0], texts[0]]
    return [(i, t, None, None, None) for i, t in enumerate(texts)] + documents(n=15)


@pytest.mark.parametrize("order,block,part,piece", [(1, 500, 1 << 21, 1 << 20), (2, 2_000_000, 1 << 21, 1 << 20),
                                                     (2, 150, 40, 64), (3, 70, 300, 200), (4, 50, 1000, 30)])
def test_scores_equal_plain_counts(spark, order, block, part, piece):
    rows = lm_rows()
    got = lm.score(frame(spark, rows).repartition(2), order, block_tokens=block, part_keys=part, piece_bytes=piece).collect()
    want, _, _ = brute_scores(rows, order)
    key = lambda r: repr(tuple(r[:5]))
    got, want = sorted(map(tuple, got), key=lambda r: (key(r), r[6])), sorted(want, key=lambda r: (key(r), r[6]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)
    assert order == 1 or sum(r[6] for r in got if r[1]) > sum(r[5] for r in got if r[1])


def test_probabilities_of_all_words_add_up_to_one():
    rows = lm_rows()[:100]
    _, probability, counts = brute_scores(rows, 3)
    for context in [(), (b"beta",), (b"alpha", b"beta"), (b"never",), *list(counts[1])[:20]]:
        if context[-1:] != (None,):
            assert np.isclose(sum(probability(context, w[0]) for w in counts[0]) + probability(context, b"never seen"), 1)


def test_a_long_text_is_read_alike_in_stretches_of_any_length():
    packer = lm._Packer(3, 10 ** 9, 100, None)
    rng = random.Random(1)
    list(packer.add(0, 1, False, " ".join(rng.choices("abcdefg", k=500)).encode()))
    block = {**packer.lists, "tokens": np.concatenate(packer.tokens).tobytes(),
             "words": np.arange(len(packer.vocabulary), dtype=np.uint64).tobytes()}
    runs = lm._Runs(block, 3)
    totals = [runs.counts(k) for k in (1, 2, 3)]
    automaton = lm.Automaton(runs, totals, lm.Smoothing(501, 8, (0.3, 0.5)))
    assert np.allclose([automaton.read(runs, lane)[0] for lane in (1, 2, 7, 100, 4096)], automaton.read(runs)[0])


def test_scores_of_awkward_tables(spark):
    assert lm.score(frame(spark, [])).count() == 0
    only_held = [(i, "a b a", None, None, None) for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(frame(spark, only_held)).collect()} == {(0, 0, 0.0, 0.0)}
    got = lm.score(with_clashes(frame(spark, documents())).selectExpr("*", "1 AS held", "2 AS block", "3 AS tokens"))
    assert got.count() == len(documents()) and got.where("score > 0 or score is null").count() == 0
    assert [r.n_tokens for r in lm.score(frame(spark, [(None, None, None, None, None)])).collect()] == [1]
