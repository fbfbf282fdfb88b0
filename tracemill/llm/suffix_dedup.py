"""Repeated byte strings of a fixed length, through run-length indexes of their surroundings.

Equal 200-byte windows have the same anchor (the 96-byte gram with the smallest hash) at the same
place. Windows are therefore grouped by anchors, only anchors that repeat go on, and equal stretches
around one anchor collapse. What is left per anchor is indexed: a run-compressed Burrows-Wheeler
transform of the stretches, with longest common prefixes sampled at both ends of each run. Matching
statistics stream through the text from sample to sample, losing one byte per step, and windows
whose statistic reaches the length are repeated. Marks go back to every text with such a stretch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracemill.llm.bitmap import bitmap, listed
from tracemill.llm.scratch import Scratch

LENGTH = 200
GRAM = 96
# Bytes of stretches that share one index, and different stretches of one anchor that are indexed
# together. Anchors with more are split by the bytes that several neighbouring windows share.
INDEX_BYTES = 1 << 20
HOT = 2000
WIDTHS = (16, 1)
_PIECE = 1 << 20
_PLACE_BITS = 21
_REMEMBERED = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX[1])
    return h ^ (h >> np.uint64(31))


class Hasher:
    """Hashes of substrings from prefix sums, modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) < len(data) + 1:
            n = 2 * len(data) + 2
            up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:len(data)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _scramble((sums[ends] - sums[begins]) * self.down[begins])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours: prefix minima of blocks meet suffix minima of the block before."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def anchors(data: np.ndarray, hasher: Hasher, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Stretches of neighbouring windows with one anchor, in arrays: ``(anchor hash, hash of the stretch,
    first window, 256 * number of windows + place of the anchor after the first window)``. A stretch
    spans all bytes of its windows; its hash also depends on where the anchor is."""
    found = []
    step = _PIECE - length + 1
    for begin in range(0, max(1, len(data) - length + 1), step):
        piece = data[begin:begin + _PIECE]
        windows = len(piece) - length + 1
        if windows <= 0:
            break
        sums = hasher.sums(piece)
        at = np.arange(len(piece) - gram + 1)
        hashes = hasher.between(sums, at, at + gram)
        low = np.uint64((1 << _PLACE_BITS) - 1)
        best = sliding_minimum((hashes & ~low) | at.astype(np.uint64), length - gram + 1)
        first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
        count = np.diff(np.append(first, windows))
        place = (best[first] & low).astype(np.int64)
        stretch = hasher.between(sums, first, first + count + length - 1)
        stretch = _scramble(stretch ^ (place - first).astype(np.uint64))
        found.append((hashes[place], stretch, first + begin, count * 256 + place - first))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*found))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _keys(data: bytes) -> tuple[int, int]:
    digest = hashlib.sha256(data).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:16], "big", signed=True)


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of texts, with samples at the ends of its runs.

    ``sampled`` are the text positions at run ends, with the longest common prefix to the suffix
    before (at run heads) and after (at run tails). All other values follow from these, see
    ``matching_statistics``.
    """

    def __init__(self, texts: list[bytes]):
        lengths = np.array([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(data)
        begins = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(texts)), lengths)
        rest = (begins + lengths)[owner] - np.arange(n)  # bytes to the end of the text
        levels, ranks = self._ranks(data, rest)
        order = np.argsort(ranks, kind="stable")
        before = np.where(np.arange(n) == begins[owner], -1 - owner, data[np.arange(n) - 1].astype(np.int64))
        transform = before[order]
        head = np.concatenate([[True], transform[1:] != transform[:-1]])
        tail = np.concatenate([head[1:], [True]])
        self.n_runs = int(head.sum())
        up = np.flatnonzero(head & (np.arange(n) > 0))
        down = np.flatnonzero(tail & (np.arange(n) < n - 1))
        self.heads = order[head]
        self.tails = order[tail]
        self.before = np.zeros(n, np.int64)
        self.after = np.zeros(n, np.int64)
        self.before[order[up]] = self._common(levels, rest, order[up], order[up - 1])
        self.after[order[down]] = self._common(levels, rest, order[down], order[down + 1])
        self.rest = rest

    @staticmethod
    def _ranks(data: np.ndarray, rest: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        """Ranks of all suffixes by doubling, and the ranks by their first h bytes for each h on the way.

        Suffixes that are equal to their texts' ends share a rank.
        """
        n = len(data)
        wide = np.zeros(n + 8, np.int64)
        wide[:n] = data.astype(np.int64) + 1
        key = np.zeros(n, np.int64)
        for j in range(7):
            key = key * 257 + np.where(rest > j, wide[j:j + n], 0)
        levels, h, limit = [], 7, int(rest.max(initial=1))
        # Single letters settle what the seven-letter level leaves open in `_common`.
        levels.append((1, data.astype(np.int32)))
        while True:
            order = np.argsort(key)
            ordered = key[order]
            fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            ranks = np.empty(n, np.int32)
            ranks[order] = fresh + 1
            levels.append((h, ranks))
            if h >= limit or fresh[-1] == n - 1:
                return levels, ranks
            following = np.zeros(n, np.int64)
            inside = rest > h
            following[inside] = ranks[np.flatnonzero(inside) + h]
            key = ranks.astype(np.int64) * (n + 1) + following
            h *= 2

    @staticmethod
    def _common(levels: list[tuple[int, np.ndarray]], rest: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefixes of pairs of suffixes, by equal ranks from long to short."""
        limit = np.minimum(rest[a], rest[b])
        done = np.zeros(len(a), np.int64)
        for h, ranks in reversed(levels):
            for _ in range(1 if h > 7 else 2 if h == 7 else 7):
                able = np.flatnonzero(done + h <= limit)
                able = able[ranks[a[able] + done[able]] == ranks[b[able] + done[able]]]
                if not len(able):
                    break
                done[able] += h
        return done

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest string from there that also starts elsewhere in the texts.

        Between two samples a position has the neighbours of the position before it, moved on by one
        byte, so its common prefix is one shorter.
        """
        n = len(self.rest)
        out = np.zeros(n, np.int64)
        for sampled, values in ((self.heads, self.before), (self.tails, self.after)):
            last = np.full(n, -1, np.int64)
            last[sampled] = sampled
            last = np.maximum.accumulate(last)
            # The first byte of every text starts a run, so there is a sample in each text.
            out = np.maximum(out, values[last] + last - np.arange(n))
        return out


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For every text its windows of ``length`` bytes that also start elsewhere in the texts."""
    if not texts:
        return []
    statistics = RunLengthIndex(texts).matching_statistics()
    edges = np.cumsum([0, *[len(t) for t in texts]])
    return [np.flatnonzero(statistics[a:b] >= length) for a, b in zip(edges, edges[1:])]


def _ranges(places: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive numbers as (first, last)."""
    if not len(places):
        return []
    cuts = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.r_[0, cuts + 1]].tolist(), places[np.r_[cuts, len(places) - 1]].tolist()))


# shape holds the number of windows of a stretch and the place of its anchor after the first window.
_ANCHOR = "h bigint, c bigint, k1 bigint, k2 bigint, a bigint, shape int"
_STRETCH = "g bigint, h bigint, c bigint, shape int, base int, blob binary"
_MARK = "h bigint, c bigint, shape int, low int, high int"


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """All stretches of all texts. A task sends a text at most twice, which tells that it repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(), {}
        for batch in batches:
            parts = []
            for text in batch.column(0):
                data = _bytes(text.as_py())
                if len(data) < length:
                    continue
                key = _keys(data)
                seen[key] = seen.get(key, 0) + 1
                if seen[key] > 2:
                    continue
                if len(seen) > _REMEMBERED:
                    seen.clear()
                h, c, a, shape = anchors(np.frombuffer(data, np.uint8), hasher, length, gram)
                parts.append((h, c, np.full(len(h), key[0]), np.full(len(h), key[1]), a, shape))
            if parts:
                h, c, k1, k2, a, shape = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(k1), pa.array(k2),
                     pa.array(a), pa.array(shape.astype(np.int32))], ["h", "c", "k1", "k2", "a", "shape"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, _ANCHOR)


def _filtered(df: DataFrame, column: str, found: np.ndarray) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(found)  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = listed(sent.value, batch.column(column).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


def _texts(docs: DataFrame, found: np.ndarray) -> DataFrame:
    """``(k1, k2, blob)``: compressed texts whose key may be in the bitmap, once each."""
    sent = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            rows = []
            for text in batch.column(0):
                data = _bytes(text.as_py())
                key = _keys(data)
                if key in seen or not listed(sent.value, np.array(key[:1]))[0]:
                    continue
                if len(seen) >= _REMEMBERED:
                    seen.clear()
                seen.add(key)
                rows.append((*key, zlib.compress(data, 1)))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())],
                ["k1", "k2", "blob"])

    once = docs.select(F.col("text").cast("string")).mapInArrow(run, "k1 bigint, k2 bigint, blob binary")
    return once.groupBy("k1", "k2").agg(F.first("blob").alias("blob"))


def _stretch_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()]
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      ["g", "h", "c", "shape", "base", "blob"])


def _stretches(listed_texts: DataFrame, length: int) -> DataFrame:
    """The bytes of one example of each stretch. Input: (blob, wanted: [(h, c, shape, a)])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, wanted in zip(batch.column("blob"), batch.column("wanted")):
                data = zlib.decompress(blob.as_py())
                yield _stretch_batch([
                    (w["h"], w["h"], w["c"], w["shape"], 0, data[w["a"]:w["a"] + (w["shape"] >> 8) + length - 1])
                    for w in wanted.as_py()])

    return listed_texts.mapInArrow(run, _STRETCH)


def _split(hot: DataFrame, length: int, width: int) -> DataFrame:
    """Stretches cut into groups of up to ``width`` windows, grouped anew by what these share.

    Windows whose distance from the anchor falls in the same interval of ``width`` have
    ``length - width + 1`` bytes in common at the same distance from the anchor. Equal windows agree
    in these bytes, so they meet again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                data, anchor = row["blob"], (row["shape"] & 255) - row["base"]
                windows, low = len(data) - length + 1, 0
                while low < windows:
                    interval = (anchor - low) // width
                    high = min(windows, anchor - interval * width + 1)
                    core = data[anchor - interval * width:anchor - (interval + 1) * width + 1 + length]
                    name = f"{row['h']}:{width}:{interval}".encode()
                    digest = hashlib.blake2b(core + b"\0" + name, digest_size=8).digest()
                    rows.append((int.from_bytes(digest, "big", signed=True), row["h"], row["c"], row["shape"],
                                 row["base"] + low, data[low:high + length - 1]))
                    low = high
            yield _stretch_batch(rows)

    return hot.mapInArrow(run, _STRETCH)


def _indexed(stretches: DataFrame, length: int) -> DataFrame:
    """Repeated windows of stretches, by an index per group (small groups share one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marks(rows: list[dict]) -> pa.RecordBatch:
            found = [
                (r["h"], r["c"], r["shape"], r["base"] + low, r["base"] + high)
                for r, places in zip(rows, repeated_windows([r["blob"] for r in rows], length))
                for low, high in _ranges(places)]
            kinds = [pa.int64()] * 2 + [pa.int32()] * 3
            columns = list(zip(*found)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              ["h", "c", "shape", "low", "high"])

        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if size >= INDEX_BYTES and row["g"] != held[-1]["g"]:
                    yield marks(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["blob"])
        if held:
            yield marks(held)

    return stretches.repartition("g").sortWithinPartitions("g").mapInArrow(run, _MARK)


def _marks(stretches: DataFrame, scratch: Scratch, length: int, hot: int) -> DataFrame:
    """Repeated windows of all stretches. Groups above ``hot`` are split until one window is left."""
    found, rows = None, stretches
    for width in (*WIDTHS, 0):
        sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        sized = rows.join(sizes, "g")
        if width == 0:
            # All members of such a group are one and the same window.
            part = sized.select("h", "c", "shape", F.col("base").alias("low"), F.col("base").alias("high"))
            return found.union(part)
        part = _indexed(sized.where(F.col("members") <= hot).drop("members"), length)
        found = part if found is None else found.union(part)
        large = sized.where(F.col("members") > hot).drop("members")
        if not sizes.where(F.col("members") > hot).head(1):
            return found
        rows = scratch.keep(_split(large, length, width), "split")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``(k1, k2, ranges)``: by text key the (first, last) repeated windows of every text that has some."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    rows = scratch.keep(_anchor_rows(docs, length, gram), "anchors")
    repeated = scratch.keep(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "repeated")
    shared = scratch.keep(_filtered(rows, "h", bitmap(repeated, "h")).join(repeated, "h", "left_semi"), "shared")
    scratch.drop(rows)
    kinds = scratch.keep(shared.groupBy("h", "c", "shape").agg(
        F.count(F.lit(1)).alias("m"), F.min(F.struct("k1", "k2", "a")).alias("at")), "kinds")
    several = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").drop("kinds")
    wanted = kinds.join(several, "h").groupBy("at.k1", "at.k2").agg(
        F.collect_list(F.struct("h", "c", "shape", "at.a")).alias("wanted"))
    wanted = scratch.keep(wanted, "wanted")
    texts = _texts(docs, bitmap(wanted, "k1"))
    stretches = scratch.keep(_stretches(wanted.join(texts, ["k1", "k2"]).select("blob", "wanted"), length), "stretches")
    whole = kinds.where("m > 1").select(
        "h", "c", "shape", F.lit(0).alias("low"), (F.shiftright("shape", 8) - 1).alias("high"))
    marks = scratch.keep(_marks(stretches, scratch, length, hot).union(whole), "marks")
    # A window of a text is marked once per stretch and mark; a text has no more ranges than windows.
    return scratch.keep(shared.join(marks, ["h", "c", "shape"]).groupBy("k1", "k2").agg(F.collect_set(F.struct(
        (F.col("a") + F.col("low")).alias("first"), (F.col("a") + F.col("high")).alias("last"))).alias("ranges")), "ranges")


_RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)``, one row per row of ``docs``.

    Every byte of a string of ``length`` bytes that also starts anywhere else in the texts is removed;
    ``kept`` is what is left, in binary (a cut may fall inside a character), null if nothing was removed.
    n_spans counts the maximal removed runs. Strings do not cross texts and are judged on the input.
    Null and empty texts have no bytes; texts below ``length`` bytes lose nothing; repeated rows repeat
    each other like copies; a null doc_id is kept; a very long text is hashed in overlapping pieces. An
    empty table gives no rows; other columns are not read.
    """
    ranges = repeated_ranges(docs, length, gram, hot)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(ranges, "k1"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                data = _bytes(text.as_py())
                key = _keys(data)
                found = listed(sent.value, np.array(key[:1]))[0]
                rows.append((*key, zlib.compress(data, 1) if found else None, len(data), hashlib.sha256(data).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", "k1", "k2", "blob", "n_bytes", "sha"])

    whole = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        read, "doc_id bigint, k1 bigint, k2 bigint, blob binary, n_bytes bigint, sha string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blob, marks, n_bytes, sha in zip(*(batch.column(c).to_pylist() for c in (
                    "blob", "ranges", "n_bytes", "sha"))):
                if not marks:
                    rows.append((n_bytes, 0, 0, sha, None))
                    continue
                edges = np.zeros(n_bytes + 1, np.int32)
                first, last = np.array([(m["first"], m["last"]) for m in marks]).T
                np.add.at(edges, first, 1)
                np.add.at(edges, last + length, -1)
                gone = np.cumsum(edges[:-1]) > 0
                kept = np.frombuffer(zlib.decompress(blob), np.uint8)[~gone].tobytes()
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((n_bytes, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return whole.join(ranges, ["k1", "k2"], "left").drop("k1", "k2").mapInArrow(
        cut, f"doc_id bigint, {_RESULT}, kept binary")
