"""Substring dedup by sliding sentence spans.

Every run of consecutive sentences, and every long sentence alone, is hashed and the hashes are joined over the whole corpus. Of a
repeated run the first occurrence stays; sentences covered by any other occurrence go.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tracemill.llm.scratch import Scratch

# A run is the shortest one of at least so many sentences that holds at least so many words.
MIN_SENTENCES = 2
MIN_WORDS = 12
# A sentence of so many words is also a run alone; longer ones are cut at places their words choose.
SINGLE_WORDS = 20
LONG_WORDS = 32
_BOUNDARY = re.compile(r"[.!?]\s+|\n\s*|[。！？｡．؟۔।॥።։][」』”’）]*\s*")
# Scripts without spaces: each character is a unit. Other words are units, or their characters if very long.
_DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_UNIT = re.compile(rf"[{_DENSE}]|[^\s{_DENSE}]+")
_LONGEST_WORD = 32
# Sizes in sixths of a word: a word, a character of a dense script, a character of a very long word.
_WORD, _SIGN, _LETTER = 6, 3, 1
# A cut stands where the hash of three units is the smallest among so many on both sides, or after so many words.
_NEAR = {_WORD: 4, _SIGN: 8, _LETTER: 24}
_FORCED_WORDS = 64
_IS_DENSE = re.compile(f"[{_DENSE}]")


def _units(text: str) -> list[tuple[int, int, int]]:
    """``(begin, end, size)`` of the units of a text."""
    found = []
    for m in _UNIT.finditer(text):
        a, b = m.span()
        if b - a > _LONGEST_WORD:
            found += [(i, i + 1, _LETTER) for i in range(a, b)]
        else:
            found.append((a, b, _SIGN if b - a == 1 and _IS_DENSE.match(text, a) else _WORD))
    return found


def _size(text: str) -> int:
    """Sixths of words in a text."""
    words = text.split()
    if text.isascii() and max(map(len, words), default=0) <= _LONGEST_WORD:
        return _WORD * len(words)
    return sum(u[2] for u in _units(text))


def _cuts(text: str) -> list[int]:
    """Places inside a long piece at which it is cut. They depend on a few units around them only, so
    equal passages are cut alike in any surroundings; the forced cut serves texts of one repeated word."""
    units = _units(text)
    parts = [text[a:b].encode("utf-8", "surrogatepass") for a, b, _ in units]
    hashes = [xxhash.xxh32_intdigest(b"\0".join(parts[max(0, i - 2):i + 1])) for i in range(len(parts))]
    cuts, held = [], 0
    for i, (_, _, size) in enumerate(units[:-1]):
        held += size
        near = _NEAR[size]
        if held >= _FORCED_WORDS * _WORD or near <= i and hashes[i] < min(hashes[i - near:i]) and \
                hashes[i] <= min(hashes[i + 1:i + near + 1]):
            cuts.append(units[i + 1][0])
            held = 0
    return cuts


def _counts_by_spaces(text: str) -> bool:
    """Whether every unit of a text is a word between spaces: no dense script, no very long word."""
    return max(map(len, text.split()), default=0) <= _LONGEST_WORD and (text.isascii() or not _IS_DENSE.search(text))


def _measured(text: str | None) -> list[tuple[str, list[str], int]]:
    """The pieces of a text with their words and size. Words are split, and their kind is told, once."""
    text = text or ""
    ends = [m.end() for m in _BOUNDARY.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    plain, found = _counts_by_spaces(text), []
    for a, b in zip([0, *ends], ends):
        piece = text[a:b]
        words = piece.split()
        size = _WORD * len(words) if plain else _size(piece)
        if size <= LONG_WORDS * _WORD:
            if piece:
                found.append((piece, words, size))
            continue
        at = [0, *_cuts(piece), len(piece)]
        for part in (piece[x:y] for x, y in zip(at, at[1:]) if x < y):
            words = part.split()
            found.append((part, words, _WORD * len(words) if plain else _size(part)))
    return found


def sentences(text: str | None) -> list[str]:
    """The pieces of a text, ending after sentence marks or line breaks with the space that follows.

    Pieces of more than LONG_WORDS words are cut by ``_cuts``. Joined they are the text again. Null and
    empty texts have none.
    """
    return [piece for piece, _, _ in _measured(text)]


def _key(text: str | None) -> tuple[int, int]:
    digest = hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:16], "big", signed=True)


def _long(start: int) -> "F.Column":
    """Sixteen hex digits of the text's SHA-256 as a signed long, as in ``_key``."""
    digits = F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), start, 16)
    high = F.conv(F.substring(digits, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(digits, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


def runs(pieces: list[tuple[str, list[str], int]], min_sentences: int, min_words: int) -> list[tuple[int, int, bytes]]:
    """``(first, last, digest)`` of the run that starts at each sentence, of the shortest run up to the
    end, and of each sentence of SINGLE_WORDS; runs that the text cannot complete are left out. White
    space does not count."""
    # Pieces without words (blank lines) neither start a run nor count as sentences.
    full = [i for i, (_, words, _) in enumerate(pieces) if words]
    texts = [" ".join(pieces[i][1]).encode("utf-8", "surrogatepass") for i in full]
    counts = [pieces[i][2] for i in full]
    least = min_words * _WORD

    def digest(begin: int, end: int) -> tuple[int, int, bytes]:
        return full[begin], full[end - 1], xxhash.xxh3_128_digest(b"\n".join(texts[begin:end]))

    found, end, held = [], 0, 0
    for begin in range(len(full)):
        while end < len(full) and (held < least or end - begin < min_sentences):
            held += counts[end]
            end += 1
        if held < least or end - begin < min_sentences:
            break
        found.append(digest(begin, end))
        held -= counts[begin]
    if found and found[-1][1] < full[-1]:
        begin, held = len(full), 0
        while held < least or len(full) - begin < min_sentences:
            begin -= 1
            held += counts[begin]
        found.append(digest(begin, len(full)))
    return found + [digest(i, i + 1) for i, n in enumerate(counts) if n >= SINGLE_WORDS * _WORD]


def repeated_spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, k1, k2, n_sentences, removed)`` for every different pair of doc_id and text.

    k1 and k2 are the first 16 bytes of the text's SHA-256 as two longs, removed the sorted numbers
    (from 0) of the sentences to take out. The first occurrence of a run is the one with the smallest
    doc_id (null first), then k1, then place. Equal rows count as one document.
    """
    scratch = Scratch(docs.sparkSession, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, lists, keys = [], [], []
            for text in batch.column("text"):
                pieces = _measured(text.as_py())
                keys.append(_key(text.as_py()))
                counts.append(len(pieces))
                lists.append([
                    {"first": a, "last": b, "high": int.from_bytes(h[:8], "big", signed=True),
                     "low": int.from_bytes(h[8:], "big", signed=True)}
                    for a, b, h in runs(pieces, min_sentences, min_words)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([k[0] for k in keys], pa.int64()),
                 pa.array([k[1] for k in keys], pa.int64()), pa.array(counts, pa.int32()), pa.array(lists, kind)],
                ["doc_id", "k1", "k2", "n_sentences", "runs"])

    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("high", pa.int64()), ("low", pa.int64())]))
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    per_row = scratch.keep(keyed.mapInArrow(
        run, "doc_id bigint, k1 bigint, k2 bigint, n_sentences int, "
             "runs array<struct<first int, last int, high bigint, low bigint>>"), "runs")
    # Equal rows are one document: only their identity is compared, not their runs.
    repeats = per_row.groupBy("doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    single = per_row
    if repeats.head(1):
        same = (per_row.doc_id.eqNullSafe(repeats.doc_id)) & (per_row.k1 == repeats.k1) & (per_row.k2 == repeats.k2)
        again = per_row.join(repeats, same, "left_semi").dropDuplicates(["doc_id", "k1", "k2"])
        single = scratch.keep(per_row.join(repeats, same, "left_anti").union(again), "single")
    # Between documents of one id 64 bits of the digest are enough; each run carries them twice through a shuffle.
    spans = single.select("doc_id", "k1", F.inline("runs"))
    firsts = spans.groupBy("high", "low").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "k1", "first")).alias("kept")).where("n > 1")
    others = spans.join(scratch.keep(firsts.drop("n"), "firsts"), ["high", "low"]).where(
        ~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("first") == F.col("kept.first"))
          & (F.col("k1") == F.col("kept.k1"))))
    # One list per document; it is no longer than the document.
    covered = others.groupBy("doc_id", "k1").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("first", "last"))))).alias("removed"))
    counts = single.select("doc_id", "k1", "k2", "n_sentences")
    return counts.join(covered.toDF("d", "a", "removed"), (
        F.col("doc_id").eqNullSafe(F.col("d"))) & (F.col("k1") == F.col("a")), "left").select(
        "doc_id", "k1", "k2", "n_sentences", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without_repeats(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of ``docs`` with ``n_sentences``, ``n_removed``, ``removed`` and ``kept_text``.

    Nulls: a null text has no sentences and stays null; a null doc_id sorts before all others. An
    empty text is kept empty. A very long text is one row and its runs one list. Ties between equal
    rows: they count as one document, and each gets its result. An empty table gives no rows. Columns
    of docs with the names of the result are replaced, others pass through.
    """
    names = ["n_sentences", "n_removed", "removed", "kept_text"]
    base = docs.drop(*names)
    spans = repeated_spans(docs, min_sentences, min_words).select(
        F.struct(F.col("doc_id").alias("i"), "k1", "k2").alias("_key"), "n_sentences", "removed")
    whole = base.select(
        F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("_row"),
        F.struct(F.col("doc_id").cast("bigint").alias("i"), _long(1).alias("k1"), _long(17).alias("k2")).alias("_key"))
    joined = whole.join(spans, "_key").select("_row", "n_sentences", "removed")
    schema = T.StructType(list(joined.schema.fields) + [T.StructField("kept_text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, gone in zip(batch.column("_row").field("text").to_pylist(), batch.column("removed").to_pylist()):
                drop = set(gone)
                kept.append(text if not drop else "".join(
                    s for i, s in enumerate(sentences(text)) if i not in drop))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.string())],
                                             [f.name for f in schema.fields])

    return joined.mapInArrow(cut, schema).select(
        "_row.*", "n_sentences", F.size("removed").alias("n_removed"), "removed", "kept_text")
