"""The near-duplicate stage links fingerprints as op8 does, besides near copies."""

import corpus_pipeline
from tests.llm.builders import frame
from tracemill.llm import simhash


def test_texts_with_linked_fingerprints_are_near_duplicates(spark):
    often = "red stone wall " * 100
    texts = [often + " ".join(f"{c}{i}" for i in range(30)) for c in "ab"] + ["quite another text of seven words"]
    a, b = (simhash.fingerprint(t) for t in texts[:2])
    assert bin(a ^ b).count("1") <= simhash.DISTANCE
    assert simhash.similarity(*(simhash.shingle_set(t) for t in texts[:2])) < 0.2
    rows = [(3, texts[0]), (2, texts[1]), (1, texts[2]), (9, ""), (8, None)]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in rows])
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert got == {1, 2, 8, 9}
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs.limit(3)).collect()} == {1: 1, 2: 2, 3: 2}
