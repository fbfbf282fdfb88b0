"""Near-duplicate documents: majority fingerprints linked through pigeonring filtering.

A fingerprint is a ring of ``SEGMENTS`` segments. If two fingerprints differ in at most ``DISTANCE``
bits, some start exists from which every chain of consecutive segments holds at most its
proportional share of the differences: with l segments of m, ``floor(l * DISTANCE / m)``. As long as
that share is zero the segments are equal, so these leading segments are the join key; the longer
prefixes of the chain prune candidates before the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tracemill.llm.components import components
from tracemill.llm.scratch import Scratch

DISTANCE = 2
SEGMENTS = 5
# Fingerprints of one bucket that are compared with each other; larger buckets take `_star_links`.
BUCKET = 128
_SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """64-bit majority fingerprint of the 3-word shingles of a text, as an unsigned integer.

    A-Z are lower-cased, words end at ASCII white space, repeated shingles count again. One or two
    words form one shingle; no words (empty or null text) give zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else map(b" ".join, zip(words, words[1:], words[2:]))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, _SEED) for s in shingles), dtype="<u8", count=max(1, len(words) - 2))
    ones = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), _CHUNK):
        part = hashes[begin:begin + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    majority = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``, one row per row of docs; fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def chains(segments: int, distance: int) -> list[dict]:
    """For every start on the ring: the mask of the equal leading segments, and the masks of longer
    chains with their budgets (only where a budget is tighter than the next longer chain's)."""
    edges = [round(i * 64 / segments) for i in range(segments + 1)]
    part = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(segments)]
    found = []
    for start in range(segments):
        mask, by_budget = 0, {}
        for length in range(1, segments + 1):
            mask |= part[(start + length - 1) % segments]
            by_budget[length * distance // segments] = mask
        found.append({"key": _signed(by_budget.pop(0)),
                      "budgets": [(b, _signed(m)) for b, m in sorted(by_budget.items())]})
    return found


def _star_links(heavy: DataFrame) -> DataFrame:
    """Links inside buckets that are too large to compare pair by pair.

    Two fingerprints differ in at most two bits exactly if some value is at most one bit from both.
    So each fingerprint visits its 65 neighbours; whoever meets at a neighbour (65 at most) is linked
    to the smallest. Rows grow linearly and nothing is left out.
    """
    values = heavy.select("fp").distinct()
    near = values.select("fp", F.explode(F.array(
        "fp", *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)])).alias("meeting"))
    return near.groupBy("meeting").agg(F.collect_set("fp").alias("members")).where("size(members) > 1").select(
        F.explode("members").alias("u"), F.array_min("members").alias("v")).where("u != v")


def links(prints: DataFrame, scratch: Scratch, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """``(u, v)``: edges that connect all distinct fingerprints of ``prints`` within ``DISTANCE`` bits.

    Every edge is a true link. Buckets of up to ``bucket`` fingerprints give all their links, larger
    ones enough to connect the same components.
    """
    rings = chains(segments, DISTANCE)
    starts = F.array(*[
        F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(r["key"])).alias("part"))
        for i, r in enumerate(rings)])
    dealt = prints.select("fp").distinct().select("fp", F.inline(starts))
    sizes = dealt.groupBy("start", "part").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = scratch.keep(dealt.join(sizes, ["start", "part"]), "buckets")
    light = shared.where(F.col("members") <= bucket).select("start", "part", "fp")
    other = light.select("start", "part", F.col("fp").alias("fp2"))
    differ = F.col("fp").bitwiseXOR(F.col("fp2"))
    within = F.lit(False)
    for i, ring in enumerate(rings):
        passes = F.col("start") == i
        for budget, mask in ring["budgets"]:
            passes &= F.bit_count(differ.bitwiseAND(F.lit(mask))) <= budget
        within |= passes
    close = light.join(other, ["start", "part"]).where(F.col("fp") < F.col("fp2")).where(within).where(
        F.bit_count(differ) <= DISTANCE).select(F.col("fp2").alias("u"), F.col("fp").alias("v"))
    return close.union(_star_links(shared.where(F.col("members") > bucket)))


def near_duplicates(docs: DataFrame, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per row of ``docs``.

    component_id is the smallest doc_id that is reachable over links, the row's own included. Nulls:
    a null text is an empty text; a null doc_id is kept and never names a component unless all ids
    of it are null. Equal fingerprints (copies, repeated rows, all texts without words) are one node,
    so a group of copies of any size costs one row in the search. An empty table gives no rows; other
    columns of ``docs`` are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs), "prints")
    roots = scratch.keep(components(links(prints, scratch, segments, bucket), scratch), "roots")
    smallest = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(
        roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = smallest.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = smallest.select("fp", "root").join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(column: str) -> "F.Column":
    """A signed long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


# Near copies: texts whose sets of five-word shingles are similar (Jaccard) to SIMILAR. Candidates agree in
# all PER_KEY min-hashes of at least one of TABLES tables: 99.96 % of pairs at 0.8, whatever the corpus size.
SIMILAR = 0.8
SHINGLE_WORDS = 5
TABLES, PER_KEY = 20, 5
# Texts of one bucket that are compared in one task; larger buckets are compared block by block.
BLOCK = 512
# Pairs agreeing in fewer min-hashes are not compared by their sets: at 0.8 one pair in a million.
_LEAST_EQUAL = 60
_FACTORS = np.random.default_rng(_SEED).integers(1 << 62, 1 << 63, TABLES * PER_KEY, np.uint64) * np.uint64(2) + np.uint64(1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the different five-word shingles, words as in ``fingerprint``. Fewer than five
    words form one shingle; no words give none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter(
        (digest(b" ".join(words[i:i + SHINGLE_WORDS]), _SEED) for i in range(n)), np.uint64, n))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets that are not both empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Sixteen bits of each min-hash of a set that is not empty."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for begin in range(0, len(shingles), 1024):
        part = shingles[begin:begin + 1024]
        least = np.minimum(least, (_FACTORS[:, None] * part).min(axis=1))
    return (least * _GOLDEN >> np.uint64(48)).astype(np.uint16)


def text_key(text: str = "text") -> list["F.Column"]:
    """Two hashes, k1 and k2, by which equal texts are known."""
    column = F.col(text).cast("string")
    return [F.xxhash64(column).alias("k1"), F.xxhash64(F.lit(1), column).alias("k2")]


def _sketched(docs: DataFrame, by_print: bool) -> DataFrame:
    """``(doc_id, k1, k2, node, sketch, fp)``: equal shingle sets are one node; no words, a null node.

    fp is the fingerprint as in ``fingerprints``, null unless ``by_print``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, found, prints = [], [], []
            for text in batch.column("text"):
                shingles = shingle_set(text.as_py())
                prints.append(_signed(fingerprint(text.as_py())) if by_print and len(shingles) else None)
                nodes.append(xxhash.xxh64_intdigest(shingles.tobytes(), _SEED) - (1 << 63) if len(shingles) else None)
                found.append(sketch(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(nodes, pa.int64()),
                 pa.array(found, pa.binary()), pa.array(prints, pa.int64())], ["doc_id", "k1", "k2", "node", "sketch", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), *text_key(), "text").mapInArrow(
        run, "doc_id bigint, k1 bigint, k2 bigint, node bigint, sketch binary, fp bigint")


def _print_links(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``(u, v)``: the nodes whose texts are in one component of linked fingerprints, each with the smallest."""
    prints = scratch.keep(rows.where("node is not null").select("node", "fp").distinct(), "prints")
    roots = scratch.keep(components(links(prints, scratch), scratch), "print_roots")
    placed = scratch.keep(prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "node", F.coalesce("root", "fp").alias("component")).distinct(), "placed")
    least = placed.groupBy("component").agg(F.min("node").alias("v"))
    return placed.join(least, "component").where("node != v").select(F.col("node").alias("u"), "v")


def _keys(nodes: DataFrame) -> DataFrame:
    """``(place, part, node)``: the bucket of each node in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16)
            rows = rows.reshape(-1, TABLES, PER_KEY).astype(np.uint64)
            part = np.zeros(rows.shape[:2], np.uint64)
            for k in range(PER_KEY):
                part = (part ^ rows[:, :, k]) * _GOLDEN
                part ^= part >> np.uint64(29)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.tile(np.arange(TABLES, dtype=np.int16), len(rows))), pa.array(part.ravel().view(np.int64)),
                pa.array(np.repeat(batch.column("node").to_numpy(), TABLES))], ["place", "part", "node"])

    return nodes.select("node", "sketch").mapInArrow(run, "place smallint, part bigint, node bigint")


def _sets(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([sketch(s).tobytes() for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "sketch", "shingles"])

    return texts.mapInArrow(run, "node bigint, sketch binary, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose shingle sets are similar to SIMILAR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = [similarity(np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)) >= SIMILAR
                     for p, q in zip(batch.column("p"), batch.column("q"))]
            yield batch.filter(pa.array(close, pa.bool_())).select(["u", "v"])

    known = sets.select("node", "shingles")
    return pairs.join(known.toDF("u", "p"), "u").join(known.toDF("v", "q"), "v").select(
        "u", "v", "p", "q").mapInArrow(run, "u bigint, v bigint")


def _linked(group: pa.Table) -> pa.Table:
    """Links between the components of two blocks: every pair is compared until its components are one."""
    nodes, root = group.column("node").to_numpy(), group.column("root").to_numpy()
    low, block = group.column("low").to_numpy(), group.column("block").to_numpy()
    rows = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(len(nodes), -1)
    sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
    above, us, vs = {}, [], []

    def top(x):
        while x in above:
            x = above[x]
        return x

    one_block = len(np.unique(block)) == 1
    for i in range(len(nodes)):
        # Pairs with the smallest node of the bucket were compared before.
        todo = (root != root[i]) & (nodes != low[i]) & (nodes[i] != low[i])
        todo &= np.arange(len(nodes)) > i if one_block else (block > block[i])
        at = np.flatnonzero(todo)
        for j in at[(rows[at] == rows[i]).sum(axis=1) >= _LEAST_EQUAL]:
            a, b = top(root[i]), top(root[j])
            if a != b and similarity(sets[i], sets[j]) >= SIMILAR:
                above[a] = b
                us.append(nodes[i])
                vs.append(nodes[j])
    return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})


def _rest(shared: DataFrame, roots: DataFrame, sets: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """Links of the pairs in a bucket that are not compared and not yet in one component.

    Nodes of a bucket are dealt to blocks of about ``block``, large components to blocks of their own,
    and each pair of blocks is compared by one task.
    """
    bucket = ["place", "part"]
    rooted = shared.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(
        *bucket, "node", "low", F.coalesce("root", "node").alias("root"))
    many = rooted.groupBy(*bucket).agg(
        F.count(F.lit(1)).alias("total"), F.min("root").alias("a"), F.max("root").alias("b")).where(
        "total > 2 and a != b").select(*bucket, "total")
    left = scratch.keep(rooted.join(many, bucket), "open")
    sizes = left.groupBy(*bucket, "root").agg(F.count(F.lit(1)).alias("members"))
    dealt = left.join(sizes, [*bucket, "root"]).withColumn("alone", F.when(F.col("members") >= block, F.col("root")))
    number = F.when(F.col("alone").isNotNull(), F.xxhash64("root", F.pmod(
        F.xxhash64("node"), F.ceil(F.col("members") / block)))).otherwise(
        F.xxhash64(F.lit(0), F.pmod(F.xxhash64("root"), F.ceil(F.col("total") / block))))
    dealt = scratch.keep(dealt.select(*bucket, "node", "low", "root", "alone", number.alias("block")), "blocks")
    names = dealt.select(*bucket, "block", "alone").distinct()
    other = names.select(*bucket, F.col("block").alias("block2"), F.col("alone").alias("alone2"))
    meet = names.join(other, bucket).where("block <= block2").where(
        "alone is null or alone2 is null or alone != alone2").select(
        *bucket, F.col("block").alias("x"), F.col("block2").alias("y"))
    sides = meet.select(*bucket, F.explode(F.array_distinct(F.array("x", "y"))).alias("block"), "x", "y")
    rows = dealt.drop("alone").join(sides, [*bucket, "block"]).join(sets, "node")
    return rows.groupBy(*bucket, "x", "y").applyInArrow(_linked, "u bigint, v bigint")


def near_groups(docs: DataFrame, scratch: Scratch, block: int = BLOCK, by_print: bool = False) -> DataFrame:
    """``(doc_id, k1, k2, root)``, one row per row of ``docs``; rows of one group have one root.

    k1 and k2 are ``text_key``. Texts without words have a null root. Groups are connected by pairs
    whose shingle sets are similar to SIMILAR, with ``by_print`` also by all fingerprints that ``links`` links.
    Equal sets are one node. In every bucket the smallest node is compared with all others; then all pairs
    that are not in one component yet are.
    """
    rows = scratch.keep(_sketched(docs, by_print), "sketches")
    nodes = scratch.keep(rows.where("node is not null").groupBy("node").agg(
        F.first("sketch").alias("sketch"), F.min(F.struct("doc_id", "k1", "k2")).alias("key")), "nodes")
    keys = scratch.keep(_keys(nodes), "keys")
    buckets = keys.groupBy("place", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("low")).where("n > 1").drop("n")
    shared = scratch.keep(keys.join(buckets, ["place", "part"]).select("place", "part", "node", "low"), "shared")
    scratch.drop(keys)
    wanted = nodes.select("node", "key.*").toDF("node", "d", "a", "b").join(
        shared.select("node").distinct(), "node", "left_semi")
    # One row stands for all copies of a text.
    texts = docs.select(F.col("doc_id").cast("bigint"), *text_key(), F.col("text").cast("string").alias("text")).join(
        wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k1") == F.col("a")) & (F.col("k2") == F.col("b"))).groupBy(
        "node").agg(F.first("text").alias("text"))
    sets = scratch.keep(_sets(texts), "sets")
    pairs = shared.where("node != low").select(F.col("node").alias("u"), F.col("low").alias("v")).distinct()
    edges = scratch.keep(_verified(pairs, sets), "links")
    if by_print:
        edges = scratch.keep(edges.union(_print_links(rows, scratch)), "links")
    roots = scratch.keep(components(edges, scratch), "roots")
    rest = scratch.keep(_rest(shared, roots, sets, scratch, block), "rest")
    if rest.head(1):
        roots = scratch.keep(components(edges.union(rest), scratch), "roots")
    scratch.drop(sets)
    scratch.drop(shared)
    found = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return rows.select("doc_id", "k1", "k2", "node").join(found, "node", "left").select("doc_id", "k1", "k2", "root")


def near_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(doc_id, component_id)``, one row per row of ``docs``: groups of copies and near copies.

    Groups as in ``near_groups``. Nulls, empty texts, ties and repeated rows as in ``near_duplicates``;
    texts without words are left as they are, each a component of its own.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    rows = scratch.keep(near_groups(docs, scratch, block), "groups")
    named = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.where("root is not null").join(named, "root").select("doc_id", "component_id").union(
        rows.where("root is null").select("doc_id", F.col("doc_id").alias("component_id")))


def one_per_group(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which rows stay, as ``(doc_id, k1, k2)``: one of each group, and all without words. Groups are of linked
    fingerprints, as in ``near_duplicates``, and of near copies.

    Of a group it is the row with the smallest doc_id (null last), then k1 and k2. The second table has
    those of them that stand for several equal rows, of which one stays; rows with neither id nor words
    are not equal to each other.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    rows = scratch.keep(near_groups(docs, scratch, by_print=True), "groups")
    chosen = rows.where("root is not null").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")).alias("row")).select(
        "row.doc_id", "row.k1", "row.k2")
    kept = scratch.keep(chosen.union(rows.where("root is null").select("doc_id", "k1", "k2").distinct()), "kept")
    repeated = rows.where("doc_id is not null or root is not null").groupBy("doc_id", "k1", "k2").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return kept, scratch.keep(same_rows(repeated, kept, "left_semi"), "repeated")


def same_rows(rows: DataFrame, others: DataFrame, how: str) -> DataFrame:
    """Join by doc_id and text key; null ids are equal."""
    a, b, c = (F.col(f"_{i}") for i in range(3))
    return rows.join(others.toDF("_0", "_1", "_2"), F.col("doc_id").cast("bigint").eqNullSafe(a)
                     & (F.col("k1") == b) & (F.col("k2") == c), how)
