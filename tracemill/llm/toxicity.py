"""Toxic documents: a lexicon trie run together with Levenshtein automata, and scores of the context.

The lexicon is learned from labelled documents: words, and stems for inflected forms. All its
Levenshtein automata run at once over the trie; the product is made deterministic while words are
read, so a word costs one table look-up per letter. Hits are weighed by what stands around them:
quotation marks and reporting words speak for a quotation, words of address for abuse.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tracemill.llm.scratch import Scratch

# Labelled documents used for fitting; beyond that a hash of the id chooses.
TRAIN_ROWS = 8000
# A term must occur in so many toxic documents, so much more often than in others, and the best are kept.
MIN_DOCS = 5
MIN_ODDS = 20.0
MAX_TERMS = 2000
STEM_LETTERS = (4, 5, 6, 7)
# Terms that count as toxic before any label is seen. Fixed values.
KNOWN_TERMS = ("asshole", "bastard", "bitch", "dumbass", "idiot", "imbecile", "moron", "retard", "scumbag")
# Marks of quotation, verbs that report speech, words that address somebody.
QUOTES = "\"“”„«»‹›"
REPORTING = frozenset("said says say wrote writes called calls call quote quoted term word phrase insult "
                      "sagte schrieb nannte dit écrit appelle dijo escribió llamó".split())
ADDRESS = frozenset("you your you're youre u ur du dein ihr dich tu vous votre tú usted eres".split())
WINDOW = 6
EXACT, MISSPELT, QUOTED, ADDRESSED = 1.0, 0.7, 0.25, 1.5
_CACHE = 200_000
_LONGEST_WORD = 64
_EDGES = re.compile(r"^(?:[^\w$@*!]|_)+|(?:[^\w$@]|_)+$")
_REPEATED = re.compile(r"(.)\1{2,}")
# Words of a token with the punctuation around them; the signs $ @ * ! may stand inside a masked word.
_INNER = re.compile(r"(?:[^\w$@*!]|_)*(?:[^\W_]|[$@*!])+(?:[^\w$@*!]|_)*")
_LETTERS = re.compile(r"[\W_]*[^\W_]+[\W_]*")


def edits_allowed(term: str, stem: bool) -> int:
    """Tolerated typing errors: none in stems and words below five letters, one below nine, else two."""
    return 0 if stem or len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """The trie of all terms, and the product of trie and Levenshtein automata as a lazy table."""

    def __init__(self, words: tuple[str, ...], stems: tuple[str, ...] = ()):
        self.children: list[dict[str, int]] = [{}]
        self.limit = [0]  # most edits that a term below the node allows
        self.ends: list[int | None] = [None]  # edits allowed to the word that ends here
        self.stem = [False]
        for term, stem in [*((w, False) for w in words), *((s, True) for s in stems)]:
            allowed, node = edits_allowed(term, stem), 0
            for letter in term:
                self.limit[node] = max(self.limit[node], allowed)
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.limit.append(0)
                    self.ends.append(None)
                    self.stem.append(False)
                node = self.children[node][letter]
            self.limit[node] = max(self.limit[node], allowed)
            if stem:
                self.stem[node] = True
            else:
                self.ends[node] = allowed
        self._numbers: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self._steps: list[dict[str, int]] = []
        self._accepts: list[int | None] = []
        self._start = self._number({0: 0})
        self._cache: dict[str, int | None] = {}

    def _number(self, edits: dict[int, int]) -> int:
        """The table row for a set of (node, fewest edits); skipped letters of terms are followed."""
        todo = list(edits)
        while todo:
            node = todo.pop()
            if node:  # the first letter of a term is never skipped
                for child in self.children[node].values():
                    if edits[node] + 1 <= self.limit[child] and edits[node] + 1 < edits.get(child, 99):
                        edits[child] = edits[node] + 1
                        todo.append(child)
        key = frozenset(edits.items())
        if key not in self._numbers:
            self._numbers[key] = len(self._sets)
            self._sets.append(key)
            self._steps.append({})
            fits = [e for n, e in key if self.ends[n] is not None and e <= self.ends[n]]
            if any(self.stem[n] and e == 0 for n, e in key):
                fits.append(0)
            self._accepts.append(min(fits, default=None))
        return self._numbers[key]

    def _step(self, row: int, letter: str) -> int:
        edits: dict[int, int] = {}

        def put(node: int, value: int) -> None:
            if value <= self.limit[node] and value < edits.get(node, 99):
                edits[node] = value

        for node, value in self._sets[row]:
            if self.stem[node] and value == 0:
                put(node, 0)  # whatever follows a stem belongs to it
            if letter in self.children[node]:
                put(self.children[node][letter], value)
            if node or not letter.isalpha():  # only a sign may stand for a first letter
                for child in self.children[node].values():
                    put(child, value + 1)
            if node:
                put(node, value + 1)
        found = self._steps[row][letter] = self._number(edits)
        return found

    def edits(self, word: str) -> int | None:
        """Fewest edits to a term that tolerates them, None if there is no such term."""
        row, empty = self._start, self._numbers.get(frozenset())
        for letter in word:
            following = self._steps[row].get(letter)
            row = self._step(row, letter) if following is None else following
            if row == empty:
                return None
            if empty is None:
                empty = self._numbers.get(frozenset())
        return self._accepts[row]

    def token(self, token: str) -> int | None:
        """``edits`` of a token without its punctuation; letters written three times or more count once."""
        if token not in self._cache:
            if len(self._cache) >= _CACHE:
                self._cache.clear()
            word = _EDGES.sub("", token)
            found = self.edits(word) if word else None
            if found is None and (short := _REPEATED.sub(r"\1", word)) != word:
                found = self.edits(short)
            if len(token) > 2 * _LONGEST_WORD:
                return found
            self._cache[token] = found
        return self._cache[token]

    def words(self, token: str) -> list[tuple[str, int | None]]:
        """The token with its ``edits``, or its words with theirs if inner punctuation or signs part terms."""
        if token.isalnum():
            return [(token, self.token(token))]
        inner = _INNER.findall(token)
        out = [part for piece in inner for part in self._unmasked(piece)]
        if len(inner) > 1 and all(e is None for _, e in out):
            return [(token, self.token(token))]
        return out or [(token, None)]

    def _unmasked(self, piece: str) -> list[tuple[str, int | None]]:
        """As ``words``, parted at the signs $ @ * ! as well: if these hide a term that the piece has not."""
        whole, letters = (piece, self.token(piece)), _LETTERS.findall(piece)
        if len(letters) > 1:
            parts = [(p, self.token(p)) for p in letters]
            if sum(e is not None for _, e in parts) > (whole[1] is not None):
                return parts
        return [whole]


def _quoted(tokens: list[str], at: int) -> bool:
    """A quotation mark opens before or at the token, and one closes at or after it, within the window."""
    before = any(t[:1] in QUOTES or t[-1:] in QUOTES for t in tokens[max(0, at - WINDOW):at]) or tokens[at][:1] in QUOTES
    after = any(t[:1] in QUOTES or t.rstrip(".,;:!?")[-1:] in QUOTES for t in tokens[at:at + WINDOW + 1] if len(t) > 1)
    reported = any(t.strip(".,:;!?" + QUOTES) in REPORTING for t in tokens[max(0, at - WINDOW):at])
    return before and after or reported


def features(text: str | None, lexicon: Lexicon) -> tuple[float, float, float, float]:
    """Abuse, quotation, abuse per hundred words and misspelling, each as a logarithm of one plus it."""
    words = [w for t in (text or "").lower().split() for w in lexicon.words(t)]
    tokens = [t for t, _ in words]
    hits = [(i, e) for i, (_, e) in enumerate(words) if e is not None]
    abuse = quoted = misspelt = 0.0
    for at, edits in hits:
        weight = EXACT if edits == 0 else MISSPELT
        misspelt += edits > 0
        if _quoted(tokens, at):
            weight *= QUOTED
            quoted += 1
        elif any(t.strip(".,:;!?") in ADDRESS for t in tokens[max(0, at - WINDOW):at + WINDOW + 1]):
            weight *= ADDRESSED
        abuse += weight
    values = (abuse, quoted, 100 * abuse / max(1, len(tokens)), misspelt)
    return tuple(float(np.log1p(v)) for v in values)


# Weights before any label is seen: bias, then one per feature. Labels move them.
PRIOR = np.array([-2.5, 2.5, -0.2, 0.3, 0.2])
PRIOR_STRENGTH = 1.0


@dataclass(frozen=True)
class Model:
    words: tuple[str, ...]
    stems: tuple[str, ...]
    weights: tuple[float, ...]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton steps, held towards the prior."""
    design, w = np.column_stack([np.ones(len(x)), x]), PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + PRIOR_STRENGTH * (w - PRIOR)
        curvature = design.T @ (design * (p * (1 - p))[:, None]) + PRIOR_STRENGTH * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(column: str = "doc_id") -> "F.Column":
    """Rows that never teach: CRC-32 of the id as text, modulo five, is zero. A null id is held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _terms(sample: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Words and stems of the sample that stand out in toxic documents, at most MAX_TERMS."""
    totals = sample.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    toxic, clean = totals[0] or 0, (totals[1] or 0) - (totals[0] or 0)
    if not toxic:
        return KNOWN_TERMS, ()
    found = F.array_distinct(F.filter(
        F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"), lambda w: F.length(w).between(4, _LONGEST_WORD)))
    words = sample.select("toxic", F.explode(found).alias("word"))
    stems = [F.when(F.length("word") > n, F.concat(F.lit("-"), F.substring("word", 1, n))) for n in STEM_LETTERS]
    # A stem counts once for each document and word; several words of one document with it are few.
    counted = words.groupBy("word").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    spread = counted.select(F.explode(F.array(F.col("word"), *stems)).alias("term"), "t", "n").where(
        "term is not null").groupBy("term").agg(F.sum("t").alias("t"), (F.sum("n") - F.sum("t")).alias("c"))
    odds = (F.col("t") + 0.5) / (toxic + 1) / ((F.col("c") + 0.5) / (clean + 1))
    best = spread.where(F.col("t") >= MIN_DOCS).withColumn("odds", odds).where(
        F.col("odds") >= MIN_ODDS).orderBy(F.desc("odds"), "term").limit(MAX_TERMS).collect()
    terms = {r.term for r in best}
    stems = {t[1:] for t in terms if t[0] == "-"}
    stems = {s for s in stems if not any(s[:n] in stems for n in STEM_LETTERS if n < len(s))}
    # A stem of one known word only is that word cut short.
    whole = {t for t in terms if t[0] != "-"}
    forms: dict[str, int] = {}
    for word in whole:
        for n in STEM_LETTERS:
            forms[word[:n]] = forms.get(word[:n], 0) + 1
    stems = {s for s in stems if forms.get(s, 0) != 1}
    words = {w for w in whole if not any(w[:n] in stems for n in STEM_LETTERS)}
    return tuple(sorted(words | set(KNOWN_TERMS))), tuple(sorted(stems))


def _sample(documents: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``(text, toxic)`` of about ``rows`` labelled ids that are not held out, one row per id however often it stands."""
    known = labels.where(F.col("toxic").isin(0, 1)).where(~held_out()).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    share = rows / max(rows, known.count())
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # About `rows` pairs of two integers: the bound holds for any input.
    taught = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return taught.groupBy("doc_id").agg(F.min_by("text", F.md5("text")).alias("text"), F.max("toxic").alias("toxic")).select(
        "text", "toxic")


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from labelled documents that are not held out, at most about ``rows`` of them.

    Labels other than 0 and 1, null ids and texts teach nothing; of several labels of a document the
    larger counts, and of several texts of an id the one with the smallest digest. Without labels the known
    terms and the prior weights are used. The lexicon holds the ``MAX_TERMS`` best terms; words above
    ``_LONGEST_WORD`` letters are not learned (they are looked up like others).
    """
    scratch = Scratch(documents.sparkSession, "toxicity")
    sample = scratch.keep(_sample(documents, labels, rows), "sample")
    words, stems = _terms(sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(words, stems)
        for batch in batches:
            values = [features(t.as_py(), lexicon) for t in batch.column("text")]
            columns = [pa.array(c, pa.float64()) for c in (zip(*values) if values else [()] * 4)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *columns], ["y", "a", "b", "c", "d"])

    table = np.array([tuple(r) for r in sample.mapInArrow(
        measure, "y int, a double, b double, c double, d double").collect()], float).reshape(-1, 5)
    scratch.drop(sample)
    return Model(words, stems, tuple(_logistic(table[:, 1:], table[:, 0])))


def probability(text: str | None, lexicon: Lexicon, weights: tuple[float, ...]) -> float:
    z = weights[0] + sum(w * f for w, f in zip(weights[1:], features(text, lexicon)))
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def score(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """Every row of ``docs`` with ``column``, the probability that its whole text is toxic.

    Only the text is used. Null and empty texts have no hit and get the score of that. Words of any
    length are read whole, and words inside a token are looked up if punctuation parts them. Equal texts score equally, an empty table gives no rows, other columns
    pass through; one named like ``column`` is replaced.
    """
    out = docs.drop(column)
    schema = T.StructType(list(out.schema.fields) + [T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.words, model.stems)
        for batch in batches:
            scores = [probability(t.as_py(), lexicon, model.weights) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], [f.name for f in schema.fields])

    return out.mapInArrow(run, schema)
