"""Fill-in-the-middle training examples with cuts by code points.

Texts stay UTF-8 bytes. A sparse index records the characters of more than one byte only: where they
stand and how many bytes they have beyond the first. A cut by code points becomes a cut by bytes, and
back, with one ``searchsorted``; between two such characters both counts run alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
# Of 100: from so many on a text stays plain; below so many a cut text has its suffix first.
PLAIN_FROM = 90
SPM_BELOW = 20
SALT = "1:"
# Bytes of text that are indexed at once.
SLICE_BYTES = 16 << 20
ADDED = ("fim_text", "fim_form", "fim_units", "fim_prefix_chars", "fim_middle_chars")
_HASHES = ("h1", "h2", "h3", "h4")


class ExceptionIndex:
    """The characters of more than one byte in a stretch of UTF-8 bytes.

    ``chars`` and ``bytes`` are the positions of these characters counted in code points and in bytes,
    ``excess[i]`` the bytes beyond one per character of the first i of them.
    """

    def __init__(self, data: np.ndarray):
        self.bytes = np.flatnonzero(data >= 0xC0)
        lead = data[self.bytes]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0).astype(np.int64))])
        self.chars = self.bytes - self.excess[:-1]

    def to_bytes(self, chars: np.ndarray) -> np.ndarray:
        """Byte positions of the characters at the given code-point positions."""
        return chars + self.excess[np.searchsorted(self.chars, chars, "left")]

    def to_chars(self, offsets: np.ndarray) -> np.ndarray:
        """Code-point positions of the characters at the given byte positions."""
        return offsets - self.excess[np.searchsorted(self.bytes, offsets, "left")]


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SLICE_BYTES of text, one row at least."""
    for batch in batches:
        offsets = _buffers(batch.column(column))[1] if len(batch) else np.zeros(1, np.int64)
        begin = 0
        while begin < len(batch):
            end = int(np.searchsorted(offsets, offsets[begin] + SLICE_BYTES, "right")) - 1
            end = min(max(end, begin + 1), len(batch))
            yield batch.slice(begin, end - begin)
            begin = end


def _examples(texts: pa.Array, hashes: np.ndarray, plain_from: int, spm_below: int) -> list[pa.Array]:
    """The five added columns for texts without nulls."""
    data, at = _buffers(texts)
    begin, end = at[:-1] - at[0], at[1:] - at[0]
    data = data[at[0]:at[-1]]
    index = ExceptionIndex(data)
    first = index.to_chars(begin)
    units = index.to_chars(end) - first
    h1, h2, h3, h4 = hashes
    one, two = h1 % (units + 1), h2 % (units + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    cut, back = index.to_bytes(first + low), index.to_bytes(first + high)
    marked = np.zeros(len(texts), bool)
    for sign in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.match_substring(texts, sign).to_numpy(zero_copy_only=False)
    plain = (units == 0) | marked | (h3 % 100 >= plain_from)
    form = np.where(plain, PLAIN, np.where(h4 % 100 < spm_below, SPM, PSM))
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    raw, out = data.tobytes(), []
    for kind, a, b, c, d in zip(form, begin.tolist(), cut.tolist(), back.tolist(), end.tolist()):
        if kind == PLAIN:
            out.append(raw[a:d])
        elif kind == PSM:
            out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
        else:
            out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
    return [pa.array(out, pa.binary()).cast(pa.string()), pa.array(form.tolist(), pa.string()), pa.array(units),
            pa.array(low, mask=plain), pa.array(high - low, mask=plain)]


def _numbers(salt: str) -> list[Column]:
    """The first four groups of eight hex digits of the document's digest, as numbers."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(n) for i, n in enumerate(_HASHES)]


def transform(docs: DataFrame, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, salt: str = SALT) -> DataFrame:
    """The documents with ``fim_text``, ``fim_form``, ``fim_units``, ``fim_prefix_chars``, ``fim_middle_chars``.

    A text of n code points is cut at two places drawn from the digest of salt and doc_id, and becomes
    prefix, suffix, middle (psm) or suffix, prefix, middle (spm), each part behind its sign. It stays
    plain if it is empty, holds a sign, or is drawn for it; then both counts are null.

    A null text counts as empty, a null doc_id as no digits. Rows that repeat give equal rows; an empty
    table gives an empty one. Columns of the documents that are named like added ones are replaced.
    Rows are worked on in slices of bounded bytes; no shuffle.
    """
    kept = [c for c in docs.columns if c not in ADDED]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    base = docs.select(row, F.coalesce("text", F.lit("")).alias("body"), *_numbers(salt))
    schema = T.StructType([base.schema["row"], *(T.StructField(n, t) for n, t in zip(
        ADDED, (T.StringType(), T.StringType(), T.LongType(), T.LongType(), T.LongType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1):
            hashes = np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *_examples(batch.column(1), hashes, plain_from, spm_below)], names=["row", *ADDED])

    return base.mapInArrow(run, schema).select("row.*", *ADDED)


def restored(text: Column | str, form: Column | str) -> Column:
    """The text from which an example was made, from the example and its form alone."""
    text, form = (F.col(c) if isinstance(c, str) else c for c in (text, form))
    body = F.substring(text, F.lit(4), F.length(text))
    before = {PSM: SUFFIX, SPM: PREFIX}

    def joined(kind: str) -> Column:
        # A cut text holds no sign of its own, so each sign occurs once behind the first.
        head = F.split_part(body, F.lit(before[kind]), F.lit(1))
        rest = F.split_part(body, F.lit(before[kind]), F.lit(2))
        tail, middle = (F.split_part(rest, F.lit(MIDDLE), F.lit(i)) for i in (1, 2))
        return F.concat(head, middle, tail) if kind == PSM else F.concat(tail, middle, head)

    return F.when(form == PSM, joined(PSM)).when(form == SPM, joined(SPM)).otherwise(text)
