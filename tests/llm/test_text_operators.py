"""Operators on documents against brute force."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.builders import DOCS, documents, frame, paragraph, with_clashes
from tracemill.llm import decontamination, mixing, sentence_spans, sharding, simhash, suffix_dedup, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    return with_clashes(frame(spark, documents())).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def counted(rows):
    return Counter(tuple(r) for r in rows)


# Suffix dedup


def brute_removed(rows, length):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(d[i:i + length] for _, d in data for i in range(len(d) - length + 1))
    out = []
    for doc_id, d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [2000, 2, 1])
def test_suffix_dedup_equals_brute_force_also_when_anchors_are_hot(docs, hot):
    rows = [r for r in documents() if len(r[1] or "") < 20_000]
    short = docs.where("text is null or length(text) < 20000")
    got = suffix_dedup.without_repeats(short, hot=hot).drop("kept").collect()
    assert counted(got) == brute_removed(rows, 200)


def test_suffix_dedup_of_an_empty_table(empty):
    assert suffix_dedup.without_repeats(empty).count() == 0


def test_texts_longer_than_a_piece_are_hashed_whole(monkeypatch):
    import numpy as np

    data = np.frombuffer(bytes(range(97, 122)) * 80, np.uint8)
    whole = suffix_dedup.anchors(data, suffix_dedup.Hasher(), 200, 96)
    monkeypatch.setattr(suffix_dedup, "_PIECE", 450)
    pieces = suffix_dedup.anchors(data, suffix_dedup.Hasher(), 200, 96)
    assert sum(whole[3] >> 8) == sum(pieces[3] >> 8) == len(data) - 199


def test_run_length_index_compresses_repeats():
    index = suffix_dedup.RunLengthIndex([b"abcabcabc" * 20] * 30)
    assert index.n_runs < 200 < len(index.rest)


# Fingerprints


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words)] if 0 < len(words) < 3 else [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=2):
    """prints: {doc_id: fingerprint}; smallest reachable id of each."""
    found = {}
    for start in sorted(prints):
        if start in found:
            continue
        todo = [start]
        while todo:
            i = todo.pop()
            if i not in found:
                found[i] = start
                todo += [j for j in prints if bin(prints[i] ^ prints[j]).count("1") <= distance]
    return found


def test_near_duplicates_equal_brute_force(docs):
    rows = [r for r in documents() if r[0] is not None]
    prints = {r[0]: brute_fingerprint(r[1]) for r in rows}
    roots = brute_components(prints)
    got = simhash.near_duplicates(docs.where("doc_id is not null")).withColumn("fp", simhash.hexadecimal("fp"))
    assert counted(got.collect()) == Counter((r[0], f"{prints[r[0]]:016x}", roots[r[0]]) for r in rows)


def test_null_ids_never_name_a_component(docs):
    got = {r.fp: r.component_id for r in simhash.near_duplicates(docs).where("doc_id is null").collect()}
    assert None not in got.values() and len(got) == 2


@pytest.mark.parametrize("segments,bucket", [(5, 128), (5, 1), (7, 3), (3, 2)])
def test_pigeonring_links_reach_whole_components(spark, segments, bucket):
    import random

    from tracemill.llm.components import components
    from tracemill.llm.scratch import Scratch

    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    values = {c for c in centres}
    for c in centres:
        for _ in range(12):
            for _ in range(rng.randint(1, 2)):
                c ^= 1 << rng.randrange(64)
            values.add(c)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    scratch = Scratch(spark, "test")
    table = spark.createDataFrame([(s,) for s in signed.values()], "fp bigint")
    links = simhash.links(table, scratch, segments, bucket)
    back = {s: v for v, s in signed.items()}
    assert all(bin(back[r.u] ^ back[r.v]).count("1") <= 2 for r in links.collect())
    roots = {r.node: r.root for r in components(links, scratch).collect()}
    want = brute_components({s: v for v, s in signed.items()})
    assert all(roots.get(s, s) == want[s] for s in back)


def test_near_copies_find_edited_texts_and_spare_others(spark):
    import random

    rng = random.Random(8)
    texts = [paragraph(rng, 25) for _ in range(30)]
    edited = [t.replace(t.split()[40], "changed", 1) for t in texts[:10]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(edited)] + [(500, None), (501, "")]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 100 if 100 <= i < 500 else i for i, _ in rows}


def brute_similar(a, b):
    x, y = ({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y) >= 0.8


@pytest.mark.parametrize("block", [512, 4])
def test_near_copies_equal_pairs_of_shingle_sets_also_in_large_buckets(spark, block):
    import random

    rng = random.Random(21)
    rows = []
    for _ in range(4):
        base = [rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(300)]
        for _ in range(25):  # two edits of one base are often less similar than 0.8 to each other
            words = list(base)
            for at in rng.sample(range(300), rng.choice([1, 4, 7, 9])):
                words[at] = f"new{rng.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(words)))
    root = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows[:i]:
            if root[i] != root[j] and brute_similar(a, b):
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    assert {r.doc_id: r.component_id for r in got} == root and 4 < len(set(root.values()))


def test_near_copy_candidates_do_not_depend_on_the_bucket():
    """Pairs at 0.8: nearly all share a key."""
    import numpy as np

    rng, met = np.random.default_rng(3), 0
    for _ in range(400):
        shared, a, b = (np.sort(rng.integers(0, 1 << 63, n, np.uint64)) for n in (240, 30, 30))
        x, y = (simhash.sketch(np.concatenate([shared, z])).reshape(simhash.TABLES, -1) for z in (a, b))
        met += bool((x == y).all(axis=1).any())
    assert met >= 398


# Sentence spans


def brute_spans(rows):
    documents = sorted({(r[0], hashlib.sha256((r[1] or "").encode()).hexdigest(), r[1]) for r in rows},
                       key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    first, gone = {}, {}
    for n, (_, _, text) in enumerate(documents):
        for a, b, digest in sentence_spans.runs(sentence_spans._measured(text), 2, 12):
            if digest in first:
                gone.setdefault(n, set()).update(range(a, b + 1))
            first.setdefault(digest, (n, a))
    return {(d[0], d[2]): sorted(gone.get(n, ())) for n, d in enumerate(documents)}


def test_repeated_sentences_equal_brute_force(docs):
    want = brute_spans(documents())
    got = sentence_spans.without_repeats(docs).collect()
    assert len(got) == len(documents()) and any(r.removed for r in got)
    for r in got:
        pieces = sentence_spans.sentences(r.text)
        assert r.removed == want[r.doc_id, r.text] and r.n_sentences == len(pieces)
        kept = "".join(p for i, p in enumerate(pieces) if i not in r.removed)
        assert (r.kept_text or "") == kept


def test_sentences_join_to_the_text():
    for text in ("", "One. Two!  Three?\n\nfour 3.14 five", "\n\n.", "no end", "a.b.c. d"):
        assert "".join(sentence_spans.sentences(text)) == text


def test_repeated_passages_without_sentence_boundaries_are_cut(spark):
    import random

    rng = random.Random(41)

    def words(n):
        return " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))

    def signs(n):
        return "".join(chr(rng.randrange(0x4e00, 0x9f00)) for _ in range(n))

    one, plain, long, dense = words(25) + ". ", words(300), words(120), signs(300)
    chinese = "".join(signs(12) + "。" for _ in range(8))
    rows = [(1, "A first text. " + one + "Its end."), (2, "Another text here. " + one + "More of it."),
            (3, plain), (4, plain), (5, words(40) + " " + long + " " + words(40)), (6, words(33) + " " + long),
            (7, chinese), (8, signs(20) + "。" + chinese), (9, dense), (10, signs(50) + dense), (11, "ab c " * 400),
            (12, "ab c " * 400)]
    got = {r.doc_id: r for r in sentence_spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].kept_text == "Another text here. More of it." and got[4].kept_text == "" and got[12].kept_text == ""
    assert len(got[6].kept_text.split()) < 33 + 40 and len(got[8].kept_text) == 21 and len(got[10].kept_text) < 150
    assert all(got[i].n_removed == 0 for i in (1, 3, 5, 7, 9))
    assert all("".join(sentence_spans.sentences(t)) == t for _, t in rows)


def test_sentence_spans_of_an_empty_table(empty):
    assert sentence_spans.without_repeats(empty).count() == 0


# Decontamination


def items():
    import random

    rng = random.Random(11)
    return [(i, paragraph(rng, 4)) for i in range(4)] + [(4, None), (5, ""), (6, "two words"), (0, "repeat of " + "x " * 9)]


def brute_contained(text, item, window=13, similarity=0.8):
    import re

    a, b = (re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()) for t in (text, item))
    size = min(window, len(b))
    return size >= 6 and any(
        sum(x == y for x, y in zip(a[i:i + size], b[j:j + size])) >= math.ceil(similarity * size)
        for i in range(len(a) - size + 1) for j in range(len(b) - size + 1))


@pytest.mark.parametrize("slice_bytes", [1 << 20, 300])
def test_contamination_equals_brute_force(spark, slice_bytes):
    import random

    rng = random.Random(12)
    bench = items()
    words = bench[1][1].split()
    for at in (3, 9, 15, 20):
        words[at] = "other"
    texts = [paragraph(rng, 5), paragraph(rng, 3) + " " + bench[0][1] + " end", " ".join(words), bench[2][1].upper(),
             " ".join(bench[3][1].split()[:12]), None, "", bench[0][1] + bench[3][1]]
    table = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)] * 2).withColumn("contaminated_by", F.lit(7))
    got = decontamination.mark(table, spark.createDataFrame(bench, "item_id long, text string"), slice_bytes=slice_bytes)
    want = {i: sorted({n for n, item in bench if brute_contained(t, item)}) for i, t in enumerate(texts)}
    rows = got.collect()
    assert len(rows) == 2 * len(texts) and want[2] == [1] and want[3] == [2]
    assert all(r.contaminated_by == want[r.doc_id] for r in rows)


def test_contamination_of_and_by_empty_tables(spark, docs, empty):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    assert decontamination.mark(empty, bench).count() == 0
    assert decontamination.mark(docs, bench.limit(0)).where("size(contaminated_by) > 0").count() == 0


def test_masks_hit_every_tolerated_pattern():
    from itertools import combinations

    for size in range(1, 14):
        changed = size - decontamination.agreeing(size, 0.8)
        masks = decontamination.family(size, changed)
        for gone in combinations(range(size), changed):
            assert any(all(i + s not in gone for i, c in enumerate(m) if c == "1")
                       for m in masks for s in range(size - len(m) + 1)), (size, gone)


def test_short_items_and_each_pattern_of_changed_words_are_found(spark):
    bench = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, 14)]
    texts, want = [], []
    for n, item in bench:
        changed = {*()} if n < 6 else {0, n // 2} if n > 9 else {n // 2}
        for gone in [(), changed, (3, 7) if n == 13 else (), (4, 6) if n == 13 else ()]:
            texts.append("before " + " ".join("zz" if k in gone else w for k, w in enumerate(item.split())) + " after")
            want.append([n])
        if 1 < n < 6:  # not exact
            texts.append(" ".join(item.split()[:-1]) + " zz")
            want.append([])
    got = decontamination.mark(frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]),
                               spark.createDataFrame(bench, "item_id long, text string"))
    assert {r.doc_id: r.contaminated_by for r in got.collect()} == dict(enumerate(want))


# Toxicity


def toxic_rows():
    import random

    rng = random.Random(4)
    rows, labels = [], []
    for i in range(200):
        text = paragraph(rng, 6).split()
        if i % 4 == 0:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["blockhead", "nincompoop", "vermsk" + rng.choice("abcdefg")]))
        rows.append((i, " ".join(text), None, "s", 0))
        labels.append((i, int(i % 4 == 0)))
    return rows, labels + [(None, 1), (3, None), (5, 7)]


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = toxic_rows()
    return toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_toxicity_on_held_out_documents(spark, model):
    rows, labels = toxic_rows()
    scored = toxicity.score(frame(spark, rows), model).withColumn("held", toxicity.held_out())
    wrong = [r for r in scored.where("held").collect() if (r.toxicity >= 0.5) != (r.doc_id % 4 == 0)]
    assert not wrong


def test_misspelt_terms_are_found_and_quotations_weigh_less(model):
    lexicon = toxicity.Lexicon(model.words, model.stems)
    assert [lexicon.token(t) for t in ("blockhead!", "blockhaed", "n1ncompoop,", "vermskz", "garden12", "BLOCK")] == \
        [0, 2, 1, 0, None, None]
    plain = toxicity.features("what a blockhead stands there today", lexicon)
    quoted = toxicity.features('he wrote "what a blockhead" about it', lexicon)
    assert quoted[0] < plain[0] and quoted[1] > plain[1]


def test_the_product_automaton_equals_edit_distances():
    import itertools

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    terms = ("abcab", "aabbccaab", "abc")
    lexicon = toxicity.Lexicon(terms)
    for n in (3, 5, 6):
        for letters in itertools.islice(itertools.product("abc", repeat=n), 0, None, 3):
            word = "a" + "".join(letters)
            # The first letter is always kept, so distances are those of the rests.
            fits = [distance(word[1:], t[1:]) for t in terms
                    if distance(word[1:], t[1:]) <= toxicity.edits_allowed(t, False)]
            found = lexicon.edits(word)
            assert (found is None and not fits) or found == min(fits, default=None), word


def test_terms_inside_tokens_and_beyond_64_letters_are_found(model):
    lexicon = toxicity.Lexicon(model.words, model.stems)
    clean = toxicity.features("garden", lexicon)
    for text in ("you,moron,go", "idiot/moron", "stone...blockhead", "_moron_", "idiot!moron", "x" * 70 + "-moron",
                 "garden," * 30 + "moron", "moron" + "n" * 80):
        assert toxicity.features(text, lexicon)[0] > clean[0], text
    two, one = (toxicity.features(t, lexicon)[0] for t in ("idiot/moron", "moron"))
    assert two > one and toxicity.features("vermska,moron", lexicon)[0] > one
    assert lexicon.words("n1ncomp*op,") == [("n1ncomp*op,", 2)]
    assert toxicity.features("garden,stone/river", lexicon) == clean


def test_toxicity_of_nulls_and_empty_tables(spark, model, empty):
    rows = frame(spark, [(1, None, None, None, None), (2, "", None, None, None)] * 2)
    assert len({r.toxicity for r in toxicity.score(rows, model).collect()}) == 1
    assert toxicity.score(empty, model).count() == 0
    untaught = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert untaught.words == toxicity.KNOWN_TERMS


# Mixing and sharding


def brute_mix(rows, range_rows=None):
    count = lambda t: len((t or "").encode().split())
    sums = Counter()
    for r in rows:
        sums[r[3]] += count(r[1])
    return sums


@pytest.mark.parametrize("range_rows", [1 << 13, 3])
def test_mix_meets_budgets_in_any_number_of_ranges(spark, range_rows):
    import random

    rng = random.Random(5)
    rows = [(i, paragraph(rng, rng.randint(0, 6)), "en", "big" if i % 10 else rng.choice(["a", None]), 0) for i in range(300)]
    sums = brute_mix(rows)
    got = mixing.mix(frame(spark, rows), range_rows=range_rows).collect()
    used = Counter()
    for r in got:
        used[r.source] += r.mix_tokens
    total, k = sum(sums.values()), len(sums)
    # The exponent by bisection, as the documentation defines it.
    low, high = 0.0, 1.0
    shares = [v / total for v in sums.values()]

    def entropy(a):
        z = sum(s ** a for s in shares)
        return -sum(s ** a / z * math.log(s ** a / z) for s in shares)

    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(middle) >= 0.95 * math.log(k) else (low, middle)

    def repeats(a):
        z = sum(s ** a for s in shares)
        return max(s ** (a - 1) / z for s in shares)

    floor, top = 0.0, 1.0
    for _ in range(50):
        middle = (floor + top) / 2
        floor, top = (floor, middle) if repeats(middle) <= 4 else (middle, top)
    exponent = max(low, top)
    z = sum(s ** exponent for s in shares)
    longest = max(len(r[1].split()) for r in rows)
    for source, tokens in sums.items():
        budget = total * (tokens / total) ** exponent / z
        assert budget - longest - 5 <= used[source] <= budget + 5
    epochs = Counter((r.doc_id, r.mix_epoch) for r in got)
    assert max(epochs.values()) == 1 and max(r.mix_epoch for r in got) <= 4


def test_ranges_do_not_change_the_mix(docs):
    whole = counted(mixing.mix(docs.select("doc_id", "text", "source")).collect())
    assert counted(mixing.mix(docs.select("doc_id", "text", "source"), range_rows=2).collect()) == whole


def test_mix_of_an_empty_table(empty):
    assert mixing.mix(empty).count() == 0


def test_shards_fit_and_split_only_where_needed(docs):
    rows = sharding.shard(docs.withColumn("shard", F.lit("old")), limit=2500).collect()
    assert len(rows) == len(documents())
    sizes, members = Counter(), {}
    for r in rows:
        sizes[r.shard] += len((r.text or "").encode())
        members.setdefault(r.shard, []).append(r)
    for name, size in sizes.items():
        assert size <= 2500 or members[name][0].oversize
    names = {s.partition("/")[0] for s in sizes}
    assert all(not other.startswith(name) for name in names for other in names if other != name)
    for name in names:  # the parent of a shard did not fit
        parent = name[:-1]
        if name:
            assert sum(v for s, v in sizes.items() if s.startswith(parent)) > 2500


@pytest.mark.parametrize("item,hit", [("so " * 400, True), ("so so so no " * 100, False), ("so " * 9 + "no " * 4 + "so " * 200, True),
                                      (" ".join(f"so so w{i}" for i in range(130)), False)])
def test_texts_of_one_word_have_bounded_hits(item, hit):
    """Tens of millions of equal seeds: told in pieces, each alignment verified once."""
    import tracemalloc

    bench = decontamination._Benchmark([(7, item), (8, "nothing else " * 20)], decontamination.MASKS, 13, 0.8)
    hashes, owner = decontamination.tokens(["so " * 40_000, "other text", "so " * 500], decontamination._Powers())
    tracemalloc.start()
    found = decontamination._verified(bench, hashes, owner, 3, 13, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == ({0: {7}, 2: {7}} if hit else {}) and peak < 200 << 20


def test_alignments_are_told_once():
    for n_texts in (3, 1 << 60):  # packed into one number, or not
        told = decontamination._Alignments(n_texts, 10, 1000)
        assert told.packed == (n_texts == 3)
        triples = np.array([[0, 9, -1000], [2, 0, 1000], [1, 5, 0], [1, 5, 0]])
        assert sorted(told.fresh(*triples.T)) == [(0, 9, -1000), (1, 5, 0), (2, 0, 1000)]
        assert told.fresh(*np.array([[1, 5, 0], [1, 5, 1]]).T) == [(1, 5, 1)]


@pytest.mark.parametrize("size,copies,limit,part_rows", [(100, 40, 1000, 10), (10, 3, 16, 1), (100, 5, 99, 1), (30, 7, 100, 3), (7, 1, 3, 1)])
def test_repeats_of_one_row_are_dealt_to_parts_that_fit(spark, size, copies, limit, part_rows):
    table = frame(spark, [(1, "x" * size, None, None, None)] * copies + [(i, "y", None, None, None) for i in range(2, 9)])
    rows = sharding.shard(table.repartition(3), limit=limit).collect()
    assert len(rows) == copies + 7
    members = {}
    for r in rows:
        members.setdefault(r.shard, []).append(r)
    for shard in members.values():
        whole = sum(len(r.text) for r in shard)
        assert {(r.shard_rows, r.shard_bytes, r.oversize) for r in shard} == {(len(shard), whole, whole > limit)}
        assert whole <= limit or len(shard) == 1
    dealt = sorted((len(m) for m in members.values() if m[0].doc_id == 1), reverse=True)
    if size * copies > limit and copies > 1:
        assert dealt == [part_rows] * (copies // part_rows) + [copies % part_rows] * (copies % part_rows > 0)


def test_sharding_of_an_empty_table(empty):
    assert sharding.shard(empty).count() == 0


def test_shards_are_written_as_one_file_each(docs, tmp_path, spark):
    sharding.write_shards(docs.select("doc_id", "text"), str(tmp_path / "out"), limit=5000)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(documents())
    assert all(len(list(p.glob("part-*"))) == 1 for p in (tmp_path / "out").glob("shard=*"))


def test_rows_without_an_id_spread_over_the_ranges(spark):
    """Null ids are placed by content, so no range holds all of them; the mix is that of one range."""
    rows = [(None, f"{'word ' * (i % 7 + 1)}{i}", "a") for i in range(60)] + [(1, "b b", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole = mixing.mix(docs, range_rows=1000)
    parts = mixing.mix(docs, range_rows=4)
    columns = ["text", "source", "mix_tokens", "mix_epoch", "mix_block", "mix_order"]
    assert counted(whole.select(columns).collect()) == counted(parts.select(columns).collect())
    assert len({r.mix_order for r in whole.where("source = 'a'").collect()}) > 30


def test_rows_of_one_id_spread_over_the_ranges(spark):
    """Different texts of one id lie in many ranges, without changing the mix."""
    docs = spark.createDataFrame([(7, f"{'word ' * (i % 7 + 1)}{i}", "a") for i in range(200)], "doc_id long, text string, source string")
    whole, parts = (mixing.mix(docs, range_rows=n) for n in (1000, 4))
    columns = ["text", "mix_tokens", "mix_epoch", "mix_block", "mix_order"]
    assert counted(whole.select(columns).collect()) == counted(parts.select(columns).collect())
    places = {r.place for r in mixing._dealt(docs.select(F.concat_ws(":", "doc_id", F.md5("text")).alias("who"), "source"), spark.createDataFrame(
        [("a", 0, 50)], "source string, passes long, ranges long")).select(F.col("range").alias("place")).collect()}
    assert len(places) > 30


def test_a_hot_id_teaches_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(i, f"other {i}") for i in range(2, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, toxic int")
    sample = toxicity._sample(docs.repartition(5), labels, 8000).collect()
    held = {r.doc_id for r in labels.where(toxicity.held_out()).collect()}
    assert len(sample) == 29 - len(held) and sum(r.text.startswith("text") for r in sample) == (1 not in held)
    assert sorted(sample) == sorted(toxicity._sample(docs.repartition(2), labels, 8000).collect())
