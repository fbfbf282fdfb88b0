"""Language-model scores by a weighted backoff automaton.

The training documents give counts of words and of runs of up to ``order`` words. A run is a state; its
arcs lead to the runs that continue it and weigh the smoothed probability of the next word; its failure
arc leads to the run without its first word and weighs what is left for words that do not continue it.
A text is read once from left to right: the state is carried along, the weights are added up.

No task holds the whole model. Texts are packed into blocks of bounded size; a block sends the hashes
of its distinct runs, sorted and cut by hash range, to parts that add up the counts of all blocks, and
gets the totals back in the same order. These hold every state and arc that its texts can visit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tracemill.llm.scratch import Scratch

ORDER = 2
BLOCK_TOKENS = 2_000_000
# Keys of all blocks that one part adds up, about.
PART_KEYS = 1 << 21
# Bytes of text that are split into words at once; texts go on in the next piece.
PIECE_BYTES = 1 << 20
# Texts are read side by side, in stretches of so many words.
LANE = 4096
HOLD_OUT = (7, 2)
_END = b"\n"
_BUCKETS = 64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32))
_STATS = -1


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether the model must not learn from a document: crc32(doc_id as text) mod 7 is 2."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HOLD_OUT[0] == HOLD_OUT[1]


class _Vocabulary(dict):
    """Numbers words in the order in which they come; the end of a text is 0."""

    def __init__(self):
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _pieces(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, in lists of bounded size."""
    begin = 0
    while begin < len(text):
        cut = _SPACE.search(text, begin + size) if len(text) - begin > size else None
        end = cut.start() if cut else len(text)
        yield text[begin:end].lower().split()
        begin = end


class _Packer:
    """Collects texts until a block is full. A text may go on in the next block, behind its last words."""

    FIELDS = ("rows", "ids", "held", "lengths", "context")

    def __init__(self, order: int, block_tokens: int, piece_bytes: int, schema: pa.Schema):
        self.order, self.most, self.piece_bytes, self.schema = order, block_tokens, piece_bytes, schema
        self.made = 0
        self._begin()

    def _begin(self) -> None:
        self.vocabulary, self.tokens, self.size, self.trained = _Vocabulary(), [], 0, 0
        self.lists: dict[str, list] = {n: [] for n in self.FIELDS}

    def _put(self, row: int, doc_id, held: bool, words: list[bytes], context: int) -> None:
        number = self.vocabulary.__getitem__
        self.tokens.append(np.fromiter(map(number, words), np.int32, len(words)))
        for name, value in zip(self.FIELDS, (row, doc_id, held, len(words), context)):
            self.lists[name].append(value)
        self.size += len(words)
        self.trained += 0 if held else len(words) - context

    def add(self, row: int, doc_id, held: bool, text: bytes) -> Iterator[pa.RecordBatch]:
        tail: list[bytes] = []
        for words in _pieces(text, self.piece_bytes):
            if self.size >= self.most:
                yield self.block()
            self._put(row, doc_id, held, [*tail, *words], len(tail))
            tail += words
            del tail[:max(0, len(tail) - self.order + 1)]
        self._put(row, doc_id, held, [*tail, _END], len(tail))
        if self.size >= self.most:
            yield self.block()

    def block(self) -> pa.RecordBatch:
        number = (TaskContext.get().partitionId() << 24) + self.made
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.vocabulary), np.uint64, len(self.vocabulary))
        row = {"block": number, **self.lists, "trained": self.trained, "words": hashes.tobytes(),
               "tokens": np.concatenate(self.tokens).tobytes() if self.tokens else b""}
        self.made += 1
        self._begin()
        return pa.RecordBatch.from_pylist([row], schema=self.schema)


def _blocks(docs: DataFrame, order: int, block_tokens: int, piece_bytes: int) -> DataFrame:
    """The documents' words as numbers inside blocks. ``docs``: (doc_id, held, text as bytes)."""
    kind = docs.schema["doc_id"].dataType
    schema = T._parse_datatype_string(
        f"block bigint, rows array<bigint>, ids array<{kind.simpleString()}>, held array<boolean>,"
        " lengths array<int>, context array<int>, trained bigint, words binary, tokens binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, row = None, TaskContext.get().partitionId() << 40
        for batch in batches:
            if packer is None:
                lists = {"rows": pa.int64(), "ids": batch.schema.field(0).type, "held": pa.bool_(),
                         "lengths": pa.int32(), "context": pa.int32()}
                packer = _Packer(order, block_tokens, piece_bytes, pa.schema(
                    [("block", pa.int64()), *((n, pa.list_(t)) for n, t in lists.items()), ("trained", pa.int64()),
                     ("words", pa.binary()), ("tokens", pa.binary())]))
            ids, held, texts = batch.columns[0], batch.column(1).to_pylist(), batch.column(2)
            for doc_id, learn_not, text in zip(ids, held, texts):
                yield from packer.add(row, doc_id.as_py(), learn_not, text.as_py())
                row += 1
        if packer is not None and packer.size:
            yield packer.block()

    return docs.mapInArrow(run, schema)


def _planes(values: np.ndarray) -> bytes:
    """The bytes of numbers, all first bytes first: leading zeros then compress well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unplaned(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


class _Runs:
    """The runs of words in a block, for each length: hashes of the distinct ones and where they stand."""

    def __init__(self, block: dict, order: int):
        self.tokens = np.frombuffer(block["tokens"], np.int32)
        self.words = np.frombuffer(block["words"], np.uint64)
        lengths = np.array(block["lengths"], np.int64)
        self.context = np.array(block["context"], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.segment = np.repeat(np.arange(len(lengths)), lengths)
        self.inside = np.arange(len(self.tokens)) - self.starts[self.segment]
        self.new = self.inside >= self.context[self.segment]
        self.learned = self.new & ~np.array(block["held"], bool)[self.segment]
        hashes = self.words[self.tokens]
        self.keys, self.at, self.first = [], [], []
        for k in range(1, order + 1):
            if k > 1:
                longer = np.zeros_like(hashes)
                longer[1:] = hashes[:-1] * _MIX[0] + self.words[self.tokens[1:]]
                longer ^= longer >> _MIX[2]
                longer *= _MIX[1]
                hashes = longer ^ (longer >> _MIX[2])
            here = np.flatnonzero(self.inside >= k - 1)
            keys, first, inverse = np.unique(hashes[here], return_index=True, return_inverse=True)
            at = np.full(len(self.tokens), -1, np.int64)
            at[here] = inverse
            self.keys.append(keys)
            self.at.append(at)
            self.first.append(here[first])

    def counts(self, k: int) -> np.ndarray:
        """How often each distinct run of length k stands in training texts, overlaps of segments once."""
        at = self.at[k - 1]
        return np.bincount(at[self.learned & (at >= 0)], minlength=len(self.keys[k - 1]))


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where sorted keys pass from one hash range to the next."""
    ranges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, ranges, "left"), [len(keys)]])


def _sent(blocks: DataFrame, order: int, bits: int) -> DataFrame:
    """Keys and counts of every block, in a row per length of run and hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                runs = _Runs(block, order)
                for k in range(1, order + 1):
                    keys, counts, out = runs.keys[k - 1], runs.counts(k).astype(np.uint32), []
                    cuts = _cuts(keys, bits)
                    for part in np.flatnonzero(np.diff(cuts)).tolist():
                        low, high = cuts[part], cuts[part + 1]
                        out.append({"length": k, "part": part, "block": block["block"], "counts": _planes(counts[low:high]),
                                    "keys": _planes(np.diff(keys[low:high], prepend=np.uint64(0)))})
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
                        [("length", pa.int32()), ("part", pa.int32()), ("block", pa.int64()),
                         ("keys", pa.binary()), ("counts", pa.binary())]))

    return blocks.mapInArrow(run, "length int, part int, block bigint, keys binary, counts binary")


_TOTALS = "length int, part int, block bigint, totals binary, stats array<bigint>"
_TOTALS_ARROW = pa.schema([("length", pa.int32()), ("part", pa.int32()), ("block", pa.int64()),
                           ("totals", pa.binary()), ("stats", pa.list_(pa.int64()))])


def _added_up(table: pa.Table) -> pa.Table:
    """The totals of one part for each block in the block's own order, and a row of statistics.

    The statistics: distinct runs, runs that occur once, then all occurrences by the binary logarithm of
    the run's count.
    """
    rows = table.to_pylist()
    keys = [np.cumsum(_unplaned(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([_unplaned(r["counts"], np.uint32) for r in rows])
    totals = np.bincount(inverse, weights=counts).astype(np.int64)
    known = totals[totals > 0]
    by_size = np.bincount(np.frexp(known.astype(float))[1] - 1, weights=known, minlength=_BUCKETS).astype(np.int64)
    here = {"length": rows[0]["length"], "part": rows[0]["part"]}
    out = [here | {"block": _STATS, "stats": [len(known), int((known == 1).sum()), *by_size.tolist()]}]
    begin = 0
    for r, k in zip(rows, keys):
        out.append(here | {"block": r["block"], "totals": _planes(totals[inverse[begin:begin + len(k)]])})
        begin += len(k)
    return pa.Table.from_pylist(out, schema=_TOTALS_ARROW)


@dataclass(frozen=True)
class Smoothing:
    """Sizes of the training corpus, and one falling curve per length of context.

    A context of count c leaves ``1 / (1 + a ln(1 + c))`` of its probability to shorter ones. ``a`` is such
    that the contexts together leave the share of runs that occur once (Good-Turing).
    """

    tokens: int
    words: int
    slopes: tuple[float, ...]

    @classmethod
    def of(cls, stats: np.ndarray) -> "Smoothing":
        """From the statistics per length of run."""
        sizes = np.sqrt(2.0) * 2.0 ** np.arange(_BUCKETS)
        slopes = []
        for k in range(1, len(stats)):
            held = stats[k - 1, 2:]
            share = stats[k, 1] / max(1, stats[k, 2:].sum())
            low, high = 0.0, 1e3
            for _ in range(60):
                middle = (low + high) / 2
                left = (held / (1 + middle * np.log1p(sizes))).sum() / max(1, held.sum())
                low, high = (middle, high) if left > share else (low, middle)
            slopes.append(high)
        return cls(int(stats[0, 2:].sum()), int(stats[0, 0]), tuple(slopes))

    def first(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of words without a context; a word that was never seen has count 0."""
        return (counts + 1) / (self.tokens + self.words + 1)

    def left(self, k: int, counts: np.ndarray) -> np.ndarray:
        """What contexts of k words leave to shorter ones."""
        return 1 / (1 + self.slopes[k - 1] * np.log1p(counts))


class Automaton:
    """States, arcs and failure arcs for the texts of one block.

    State 0 is the empty context and has an arc for each word. Arcs of the others are sorted by
    state * words + word.
    """

    def __init__(self, runs: _Runs, totals: list[np.ndarray], smoothing: Smoothing):
        order, self.n_words = len(totals), len(runs.words)
        # The first level by word number: its distinct keys are the words themselves.
        word_of = runs.tokens[runs.first[0]]
        self.counts = np.zeros(self.n_words, np.int64)
        self.counts[word_of] = totals[0]
        probability = smoothing.first(totals[0])
        self.root_weight, self.root_target = np.zeros(self.n_words), np.zeros(self.n_words, np.int64)
        self.root_weight[word_of] = np.log10(probability)
        fail, fail_weight, keys, weights, targets = [np.zeros(1, np.int64)], [np.zeros(1)], [], [], []
        n_states, state_before = 1, None
        for k in range(1, order + 1):
            first, total = runs.first[k - 1], totals[k - 1]
            word, seen = runs.tokens[first], total > 0
            if k > 1:
                prefix, suffix = runs.at[k - 2][first - 1], runs.at[k - 2][first]
                held = np.maximum(totals[k - 2][prefix], 1)
                left = smoothing.left(k - 1, held)
                probability = np.where(seen, (1 - left) * total / held + left * probability[suffix], 0)
                back = state_before[suffix]
            else:
                back = np.zeros(len(first), np.int64)
            state = np.full(len(first), 0, np.int64)
            if k < order:
                # The end of a text is no context.
                lasting = seen & (word != 0)
                state[lasting] = n_states + np.arange(lasting.sum())
                n_states += int(lasting.sum())
                fail.append(back[lasting])
                fail_weight.append(np.log10(smoothing.left(k, total[lasting])))
            else:
                state = back
            if k == 1:
                self.root_target[word] = state if order > 1 else 0
            else:
                keys.append(state_before[prefix[seen]] * self.n_words + word[seen])
                weights.append(np.log10(probability[seen]))
                targets.append(state[seen])
            state_before = state
        self.fail, self.fail_weight = np.concatenate(fail), np.concatenate(fail_weight)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        by_key = np.argsort(keys)
        self.keys = np.append(keys[by_key], np.iinfo(np.int64).max)
        self.weights = np.append(np.concatenate(weights)[by_key] if weights else [], 0.0)
        self.targets = np.append(np.concatenate(targets)[by_key] if targets else [], 0).astype(np.int64)

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of reading one word in each state, failure arcs included, and the states reached."""
        weight, reached = np.zeros(len(states)), np.zeros(len(states), np.int64)
        states, unread = states.copy(), np.arange(len(states))
        while len(unread):
            here, word = states[unread], words[unread]
            key = here * self.n_words + word
            arc = np.searchsorted(self.keys, key)
            found = self.keys[arc] == key
            weight[unread] += np.where(found, self.weights[arc],
                                       np.where(here == 0, self.root_weight[word], self.fail_weight[here]))
            reached[unread] = np.where(found, self.targets[arc], self.root_target[word])
            states[unread] = self.fail[here]
            unread = unread[~found & (here != 0)]
        return weight, reached

    def read(self, runs: _Runs, lane: int = LANE) -> np.ndarray:
        """Log-probability of each segment. Stretches start in the state that the words before them lead to."""
        before = len(runs.keys) - 1
        starts, ends, warm, owner = [], [], [], []
        for i, (begin, end) in enumerate(zip(runs.starts[:-1].tolist(), runs.starts[1:].tolist())):
            own = begin + int(runs.context[i])
            for low in range(own, end, lane):
                starts.append(max(begin, low - before))
                warm.append(low)
                ends.append(min(end, low + lane))
                owner.append(i)
        starts, ends, warm, owner = (np.array(x, np.int64) for x in (starts, ends, warm, owner))
        longest_first = np.argsort(starts - ends, kind="stable")
        starts, ends, warm, owner = (x[longest_first] for x in (starts, ends, warm, owner))
        lengths, sums, states = ends - starts, np.zeros(len(starts)), np.zeros(len(starts), np.int64)
        for t in range(int(lengths.max(initial=0))):
            m = int(np.searchsorted(-lengths, -t, "left"))
            at = starts[:m] + t
            weight, states[:m] = self.step(states[:m], runs.tokens[at].astype(np.int64))
            sums[:m] += np.where(at >= warm[:m], weight, 0)
        return np.bincount(owner, weights=sums, minlength=len(runs.context))


def _scored(order: int, smoothing: Smoothing, fields: list[str], kind):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block in left.to_pylist():
            runs = _Runs(block, order)
            parts = sorted(right.to_pylist(), key=lambda r: (r["length"], r["part"]))
            totals = [np.concatenate([_unplaned(r["totals"], np.int64) for r in parts if r["length"] == k] or
                                     [np.zeros(0, np.int64)]) for k in range(1, order + 1)]
            automaton = Automaton(runs, totals, smoothing)
            scores = automaton.read(runs)
            counts = automaton.counts[runs.tokens]
            n, size = len(runs.context), runs.segment
            own = runs.new.astype(float)
            columns = [block["rows"], block["ids"], block["held"],
                       np.bincount(size, weights=own, minlength=n).astype(np.int64),
                       np.bincount(size, weights=own * (counts > 0), minlength=n).astype(np.int64),
                       np.bincount(size, weights=own * np.log10(smoothing.first(counts)), minlength=n), scores]
            types = [pa.int64(), kind(left), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            out.append(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=fields))
        return pa.concat_tables(out) if out else pa.table({})

    return run


def score(docs: DataFrame, order: int = ORDER, held: Column | None = None, block_tokens: int = BLOCK_TOKENS,
          part_keys: int = PART_KEYS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each document.

    Tokens are the words of the text with A-Z lower-cased, and its end. The model learns from all
    documents where ``held`` (default: ``held_out``) is false. ``base_score`` is the log10 probability by
    single words with one added to each count, ``score`` that by the automaton over runs of up to ``order``
    words; a word that was not learned counts as one further word.

    A null text counts as empty and has its end only; a null doc_id is an empty id. Rows that repeat are
    rows of their own. Without training texts every word has the same probability. An empty table gives
    no rows; other columns are not read. Runs are told apart by 64-bit hashes.

    A long text goes on from block to block, with its last words as the start state, and its parts are
    added up. A run that all texts share is one key per block, not one per occurrence.
    """
    scratch = Scratch(docs.sparkSession, "language-model")
    kind = docs.schema["doc_id"].dataType
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    unlearned = F.coalesce(held_out() if held is None else held, F.lit(False))
    slim = docs.select("doc_id", unlearned.alias("held"), body.alias("text"))
    blocks = scratch.keep(_blocks(slim, order, block_tokens, piece_bytes), "blocks")
    size = blocks.agg(F.sum(F.octet_length("tokens")).alias("n")).first().n or 0
    bits = max(0, int(np.ceil(np.log2(max(1, size / 4 / part_keys)))))
    totals = scratch.keep(_sent(blocks, order, bits).groupBy("length", "part").applyInArrow(_added_up, _TOTALS), "totals")
    stats = np.zeros((order, 2 + _BUCKETS))
    sums = totals.where(F.col("block") == _STATS).select("length", F.posexplode("stats").alias("at", "value"))
    for r in sums.groupBy("length", "at").agg(F.sum("value").alias("value")).collect():
        stats[r.length - 1, r["at"]] = r.value
    smoothing = Smoothing.of(stats)
    fields = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    found = blocks.groupBy("block").cogroup(totals.where(F.col("block") != _STATS).groupBy("block")).applyInArrow(
        _scored(order, smoothing, fields, lambda t: t.schema.field("ids").type.value_type),
        f"row bigint, doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint,"
        " base_score double, score double")
    return found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"),
        *[F.sum(c).alias(c) for c in fields[3:]]).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(smoothing.tokens).cast("bigint").alias("train_tokens"),
        "base_score", "score")
