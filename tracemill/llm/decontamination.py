"""Benchmark decontamination by spaced seeds.

Fixed masks read some token positions and ignore others, so a seed still matches if an ignored token
was changed. Hashes of all masked positions of the texts are joined with those of the benchmark;
around each hit the two token sequences are aligned and compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Six tokens are read by each mask; 0 is ignored. `family` adds what these miss.
MASKS = ("111111", "11011011", "1010110101")
# Shorter items must be copied exactly.
SHORTEST = 6
# A family of more masks gives way to lighter masks, and more patterns than that to runs.
_MOST_MASKS, _MOST_PATTERNS = 6, 2000
# A hit counts if some aligned run of this many tokens (the whole item, if shorter) agrees to this share.
WINDOW = 13
SIMILARITY = 0.8
# Bytes of benchmark text sent to the tasks at once; a larger benchmark takes several passes.
SLICE_BYTES = 8 << 20
# Bytes of text that are tokenised together.
_CHUNK = 1 << 20
# Hits that are looked at together; a text of one word has more than its length times the item's.
_HITS = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_FILTER_BITS = 20


def agreeing(size: int, similarity: float) -> int:
    """Tokens of ``size`` that must agree."""
    return size if size < SHORTEST else math.ceil(similarity * size)


def _fits(mask: str, size: int) -> list[int]:
    """The mask at all its places in ``size`` tokens, as bits."""
    return [int(mask, 2) << shift for shift in range(size - len(mask) + 1)]


@lru_cache
def family(size: int, tolerated: int, masks: tuple[str, ...] = MASKS) -> tuple[str, ...]:
    """Masks of which one fits between any ``tolerated`` changed tokens of ``size``, proven by enumeration.

    ``masks`` come first; what they miss is hit by the best further masks of as many tokens as possible.
    """
    if not tolerated:
        return masks if any(len(m) <= size for m in masks) else ("1" * size,)
    if math.comb(size, tolerated) > _MOST_PATTERNS:
        # Some run between the changed tokens has at least its share of the others.
        return masks + ("1" * -(-(size - tolerated) // (tolerated + 1)),)
    patterns = [sum(1 << i for i in at) for at in combinations(range(size), tolerated)]

    def hit(mask: str) -> set[int]:
        places = _fits(mask, size)
        return {p for p in patterns if any(not p & place for place in places)}

    first = tuple(m for m in masks if len(m) <= size)
    missed = set(patterns).difference(*map(hit, first))
    for weight in range(min(6, size - tolerated), 0, -1):
        found, left = first, set(missed)
        choice = {} if not left else {
            mask: hit(mask) for length in range(weight, size + 1) for inner in combinations(range(1, length - 1), max(0, weight - 2))
            for mask in ["".join("1" if i in (0, length - 1, *inner) else "0" for i in range(length))]
            if mask.count("1") == weight}
        while left and len(found) < _MOST_MASKS:
            best = max(choice, key=lambda m: (len(choice[m] & left), m), default=None)
            if best is None or not choice[best] & left:
                break
            found, left = found + (best,), left - choice[best]
        if not left:
            return found
    raise ValueError("no family of masks")  # a mask of one token always fits


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the hash base and of its inverse, long enough for the texts seen so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
        return self.up[:n], self.down[:n]


def _word_bytes() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return table


_WORD = _word_bytes()


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX[1])
    return h ^ (h >> np.uint64(31))


def tokens(texts: list[str | None], powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all tokens of the texts, and the number of the text each belongs to.

    Tokens are runs of ASCII letters, digits and non-ASCII bytes of the lower-cased text.
    """
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = _WORD[data]
    turns = np.flatnonzero(np.diff(inside))
    starts, ends = turns[::2], turns[1::2]
    up, down = powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    hashes = _scramble((sums[ends] - sums[starts]) * down[starts])
    begins = np.cumsum([0, *[len(p) + 1 for p in parts]])
    return hashes, np.searchsorted(begins, starts, "right") - 1


def _seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """One hash per start of a mask. Too few tokens: none."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    found = np.zeros(n, np.uint64)
    for place, read in enumerate(mask):
        if read == "1":
            found = found * np.uint64(_MIX[0]) + hashes[place:place + n]
    return found * np.uint64(_MIX[1]) ^ _scramble(np.uint64([int(mask, 2)]))


class _Benchmark:
    """Seeds of a slice of the benchmark, sorted, with the item and token they start at."""

    def __init__(self, items: list[tuple[int, str | None]], masks: tuple[str, ...], window: int, similarity: float):
        self.ids = [i for i, _ in items]
        self.hashes, owner = tokens([t for _, t in items], _Powers())
        self.begins = np.searchsorted(owner, np.arange(len(items) + 1))
        sizes = np.minimum(window, np.diff(self.begins, append=len(owner)))
        # Each length of items has its own masks.
        families = {n: family(n, n - agreeing(n, similarity), masks) for n in np.unique(sizes).tolist() if n}
        self.masks = sorted({m for f in families.values() for m in f})
        seeds, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for mask in self.masks:
            found = _seeds(self.hashes, mask)
            used = np.isin(sizes, [n for n, f in families.items() if mask in f])
            own = (owner[:len(found)] == owner[len(mask) - 1:len(mask) - 1 + len(found)]) & used[owner[:len(found)]]
            seeds.append(found[own])
            places.append(np.flatnonzero(own))
        seeds, places = np.concatenate(seeds), np.concatenate(places)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.places = seeds[order], places[order]
        self.owner = owner
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.seeds >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, hashes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (token of the texts, token of the benchmark) at which equal seeds start, some at a time."""
        for mask in self.masks:
            found = _seeds(hashes, mask)
            at = np.flatnonzero(self.filter[found >> np.uint64(64 - _FILTER_BITS)])
            at = at[owner[at] == owner[at + len(mask) - 1]]
            low = np.searchsorted(self.seeds, found[at], "left")
            count = np.searchsorted(self.seeds, found[at], "right") - low
            at, low, count = at[count > 0], low[count > 0], count[count > 0]
            ends = np.cumsum(count)
            for begin in range(0, int(ends[-1]) if len(ends) else 0, _HITS):
                number = np.arange(begin, min(begin + _HITS, int(ends[-1])))
                which = np.searchsorted(ends, number, "right")
                yield at[which], self.places[low[which] + number - (ends[which] - count[which])]


class _Alignments:
    """Distinct (text, item, shift): each is told once, however many hits it has."""

    def __init__(self, n_texts: int, n_items: int, longest: int):
        self.n_items, self.width = max(1, n_items), (2 * longest + 1).bit_length()
        self.packed = (n_texts * self.n_items).bit_length() + self.width <= 63
        self.middle, self.known = longest, np.zeros(0, np.int64)
        self.told: set[tuple[int, int, int]] = set()

    def fresh(self, text: np.ndarray, item: np.ndarray, shift: np.ndarray) -> list[tuple[int, int, int]]:
        if not self.packed:
            new = set(map(tuple, np.unique(np.stack([text, item, shift], 1), axis=0).tolist())) - self.told
            self.told |= new
            return sorted(new)
        keys = np.unique(((text * self.n_items + item) << self.width) + shift + self.middle)
        keys = keys[~np.isin(keys, self.known, assume_unique=True)]
        self.known = np.union1d(self.known, keys)
        pair, shift = keys >> self.width, (keys & ((1 << self.width) - 1)) - self.middle
        return list(zip((pair // self.n_items).tolist(), (pair % self.n_items).tolist(), shift.tolist()))


def _verified(bench: _Benchmark, hashes: np.ndarray, owner: np.ndarray, n_texts: int, window: int,
              similarity: float) -> dict[int, set[int]]:
    """Items found in each text, by number of the text."""
    begins = np.searchsorted(owner, np.arange(n_texts + 1))
    alignments = _Alignments(n_texts, len(bench.ids), len(hashes) + len(bench.hashes))
    found: dict[int, set[int]] = {}
    done = np.zeros(0, np.int64)  # pairs of text and item that need no more hits
    for left, right in bench.hits(hashes, owner):
        text, item = owner[left], bench.owner[right]
        if len(done):
            open_ = ~np.isin(text * len(bench.ids) + item, done)
            left, right, text, item = left[open_], right[open_], text[open_], item[open_]
        shift = (left - begins[text]) - (right - bench.begins[item])
        new = set()
        for t, i, d in alignments.fresh(text, item, shift):
            if bench.ids[i] in found.get(t, ()):
                new.add(t * len(bench.ids) + i)
                continue
            a, b = hashes[begins[t]:begins[t + 1]], bench.hashes[bench.begins[i]:bench.begins[i + 1]]
            low, high = max(0, -d), min(len(b), len(a) - d)
            size = min(window, len(b))
            if high - low < size:
                continue
            same = np.concatenate([[0], np.cumsum(a[low + d:high + d] == b[low:high])])
            if (same[size:] - same[:-size]).max() >= agreeing(size, similarity):
                found.setdefault(t, set()).add(bench.ids[i])
                new.add(t * len(bench.ids) + i)
        done = np.union1d(done, list(new)).astype(np.int64)
    return found


def _slices(spark, benchmark: DataFrame, slice_bytes: int) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark in pieces of a bounded size, whatever its own size is."""
    items = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = max(1, math.ceil(2 * size / slice_bytes))
    for piece in range(pieces):
        kept = items if pieces == 1 else items.where(
            F.pmod(F.xxhash64("item_id", "text"), F.lit(pieces)) == piece)
        rows = [tuple(r) for r in kept.collect()]
        if rows:
            yield rows


def mark(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW,
         similarity: float = SIMILARITY, slice_bytes: int = SLICE_BYTES,
         column: str = "contaminated_by") -> DataFrame:
    """Every row of ``docs`` with ``column``: the sorted ids of the benchmark items that it contains.

    An item is contained if somewhere ``window`` consecutive tokens of it (all of them, if it has fewer)
    line up with the text and at least ``similarity`` of them agree. Items of fewer than six tokens must
    be copied exactly. No such overlap is missed: see ``family``. Nulls and empty texts contain nothing; null or empty items are never
    found; a null item_id is left out of the list but its finding shows as a null in it. Repeated rows
    are judged alike, repeated items are listed once, empty tables give no findings. Other columns pass
    through; one named like ``column`` is replaced.

    Rows stay where they are: the benchmark comes to them in pieces of at most about ``slice_bytes``,
    one pass over the texts for each.
    """
    spark = docs.sparkSession
    out = docs.drop(column)
    schema = T.StructType(list(out.schema.fields) + [T.StructField(column, T.ArrayType(T.LongType()))])
    result = out.withColumn(column, F.array().cast("array<bigint>"))
    for rows in _slices(spark, benchmark, slice_bytes):
        sent = spark.sparkContext.broadcast(_Benchmark(rows, masks, window, similarity))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            bench, powers = sent.value, _Powers()
            for batch in batches:
                before, now = batch.column(column).to_pylist(), []
                texts = batch.column("text").to_pylist()
                begin = 0
                while begin < len(texts):
                    end, size = begin, 0
                    while end < len(texts) and (end == begin or size < _CHUNK):
                        size += len(texts[end] or "")
                        end += 1
                    hashes, owner = tokens(texts[begin:end], powers)
                    found = _verified(bench, hashes, owner, end - begin, window, similarity)
                    now += [found.get(t, ()) for t in range(end - begin)]
                    begin = end
                lists = [sorted({*old, *new}, key=lambda x: (x is None, x)) for old, new in zip(before, now)]
                arrays = [batch.column(f.name) for f in schema.fields[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(lists, pa.list_(pa.int64()))], [f.name for f in schema.fields])

        result = result.mapInArrow(run, schema)
    return result
