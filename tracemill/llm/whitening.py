"""Whitening of embeddings by the leading eigenvectors of their covariance, found by Jacobi-Davidson.

The covariance is never formed. Its product with a few directions is one pass over blocks of exactly
centred rows: every task multiplies its blocks, Spark adds up the results. The driver holds matrices of
the dimension times a few dozen columns only: a subspace with its Rayleigh-Ritz values, the pairs that
are locked, and the correction equations, which MINRES solves side by side with one pass per step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tracemill.llm.scratch import Scratch

COMPONENTS = 8
SCALE = 1024
OFFSET = 100_000
BLOCK_ROWS = 4096
# Entries of this size and above count as non-finite: sums of a block stay exact.
LIMIT = 2.0 ** 31
INNER_STEPS = 8
# The subspace is cut back to its best directions when it would exceed so many times the components.
SUBSPACE = 8
MAX_ROUNDS = 300
_EPS = float(np.finfo(float).eps)
# Eigenvalues below this share of the trace are rounding, not variance.
_NO_VARIANCE = 1e-13
_BLOCK = "ids array<{}>, cells binary"
_SUMS = "at int, value double"


def _double(x):
    return x.cast("double")


def _clean(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` of the vectors whose entries are all finite numbers."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(_double(x)) & (F.abs(_double(x)) < F.lit(LIMIT)))
    return vectors.where(v.isNotNull()).where(fine).select("vec_id", F.transform(v, _double).alias("v"))


def _packed(clean: DataFrame, dim: int, block_rows: int) -> DataFrame:
    """Blocks of rows: ids, and the whole numbers floor(SCALE * c) + OFFSET. Short vectors end in zeros."""
    kind = clean.schema["vec_id"].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, len(whole), block_rows):
                batch = whole.slice(begin, block_rows)
                lists = batch.column(1)
                lengths = np.diff(lists.offsets.to_numpy())
                cells = np.zeros((len(batch), dim))
                cells[np.arange(dim) < lengths[:, None]] = lists.flatten().to_numpy()
                x = np.floor(SCALE * cells).astype(np.int64) + OFFSET
                yield _one_row(batch.column(0), x.tobytes())

    return clean.mapInArrow(pack, _BLOCK.format(kind.simpleString()))


def _one_row(ids: pa.Array, cells: bytes, *more: list) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    columns = [lists, pa.array([cells], pa.binary()), *(pa.array([m], pa.list_(pa.int64())) for m in more)]
    return pa.RecordBatch.from_arrays(columns, names=["ids", "cells", "deviations"][:len(columns)])


def _matrix(cells: bytes, dim: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(cells, kind).reshape(-1, dim)


def _summed(blocks: DataFrame, dim: int, shape: tuple[int, ...], work: Callable[[np.ndarray], np.ndarray],
            kind=np.float64) -> np.ndarray:
    """The sum over all blocks of ``work(block)``, an array of the given shape."""
    whole = kind is np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            for cells in batch.column(0):
                total += work(_matrix(cells.as_py(), dim, kind))
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)],
                                         names=["at", "value"])

    parts = blocks.select("cells").mapInArrow(run, "at int, value bigint" if whole else _SUMS)
    value = F.col("value").cast("decimal(38,0)") if whole else F.col("value")
    # One row per entry of the result: its size depends on the dimension, not on the rows.
    rows = parts.groupBy("at").agg(F.sum(value).alias("value")).collect()
    out = np.zeros(int(np.prod(shape)), object if whole else kind)
    for r in rows:
        out[r.at] = int(r.value) if whole else r.value
    return out.reshape(shape)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - sums`` in whole numbers, without overflow."""
    peak = max(int(np.abs(x).max(initial=0)), max((abs(int(s)) // n for s in sums), default=0) + 1) * n
    if peak < 1 << 61:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def _squares(d: np.ndarray) -> list[int | None]:
    """Exact sums of squares per row; null where 63 bits do not hold one."""
    peak = int(np.abs(d).max(initial=0))
    if peak * peak * max(1, d.shape[1]) < 1 << 62:
        return (d.astype(np.int64) ** 2).sum(1).tolist()
    exact = (d.astype(object) ** 2).sum(1)
    return [int(s) if s < 1 << 63 else None for s in exact]


def _centred(packed: DataFrame, dim: int, n: int, sums: np.ndarray) -> DataFrame:
    """Blocks with x - S/n, rounded once from the exact n * x - S, and the exact squared deviations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                d = _deviations(_matrix(batch.column(1)[i].as_py(), dim, np.int64), n, sums)
                ids = batch.column(0)[i].values
                yield _one_row(ids, (d / n).astype(np.float64).tobytes(), _squares(d))

    ids = packed.schema["ids"].dataType.elementType.simpleString()
    return packed.mapInArrow(run, _BLOCK.format(ids) + ", deviations array<bigint>")


def _orthogonal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of ``new`` add to the bases; negligible parts are left out."""
    length = np.sqrt((new ** 2).sum(0))
    new = new[:, length > 0] / length[length > 0]
    for _ in range(2):
        for b in bases:
            new = new - b @ (b.T @ new)
    u, s, _ = np.linalg.svd(new, full_matrices=False) if new.size else (new, np.zeros(0), None)
    u = u[:, s > 1e-10]
    for b in bases:
        u = u - b @ (b.T @ u)
    return np.linalg.qr(u)[0] if u.size else u


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, reduction: float) -> np.ndarray:
    """Approximate solutions of symmetric systems, one per column, in step with each other.

    ``apply`` multiplies every column by the matrix of its own system. Ends after ``steps`` products, or
    when all residuals have shrunk to ``reduction``.
    """
    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros(np.broadcast_shapes(a.shape, b.shape)), where=b > 0)

    norm = np.sqrt((right ** 2).sum(0))
    x, v_old, v = np.zeros_like(right), np.zeros_like(right), over(right, norm)
    w_old, w = np.zeros_like(right), np.zeros_like(right)
    eta, beta = norm.copy(), np.zeros_like(norm)
    c_old = c = np.ones_like(norm)
    s_old = s = np.zeros_like(norm)
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * v_old
        following = np.sqrt((p ** 2).sum(0))
        delta = c * alpha - c_old * s * beta
        diagonal = np.hypot(delta, following)
        w_old, w = w, over(v - s_old * beta * w_old - (s * alpha + c_old * c * beta) * w, diagonal)
        c_old, c, s_old, s = c, over(delta, diagonal), s, over(following, diagonal)
        x += c * eta * w
        eta = -s * eta
        v_old, v, beta = v, over(p, following), following
        if (np.abs(eta) <= reduction * norm).all():
            break
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dim: int, k: int, inner_steps: int = INNER_STEPS,
                    seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric operator without negative ones, and their unit eigenvectors.

    A pair is locked when its residual is at the rounding of doubles, 16 sqrt(dim) eps times the largest
    value. Where a residual below 1e-11 of that value stops shrinking for five rounds, it counts as
    reached; without either an error tells so after MAX_ROUNDS rounds.
    """
    k = min(k, dim)
    rng = np.random.default_rng(seed)
    values, locked = np.zeros(0), np.zeros((dim, 0))
    space = _orthogonal(rng.standard_normal((dim, min(dim, 2 * k))))
    image = product(space)
    least, stalled = np.inf, 0
    for _ in range(MAX_ROUNDS):
        inner = space.T @ image
        theta, turn = np.linalg.eigh((inner + inner.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        wanted = min(k - len(values), len(theta))
        residual = image[:, :wanted] - space[:, :wanted] * theta[:wanted]
        size = np.sqrt((residual ** 2).sum(0))
        top = max(float(theta[0]), float(values.max(initial=0)), 0.0)
        stalled, least = (0, size[0]) if size[0] < least / 2 else (stalled + 1, least)
        done = 0
        while done < wanted and (size[done] <= 16 * np.sqrt(dim) * _EPS * top
                                 or stalled >= 5 and size[done] <= 1e-11 * top):
            done += 1
        if done:
            values = np.concatenate([values, theta[:done]])
            locked = np.hstack([locked, space[:, :done]])
            space, image = space[:, done:], image[:, done:]
            theta, residual = theta[done:wanted], residual[:, done:wanted]
            least, stalled = np.inf, 0
            if len(values) == k:
                order = np.argsort(-values, kind="stable")
                return values[order], locked[:, order]
        theta = theta[:residual.shape[1]]
        if space.shape[1] + len(theta) > max(SUBSPACE * k, 3 * k):
            space, image = space[:, :2 * k], image[:, :2 * k]
        known = np.hstack([locked, space[:, :len(theta)]])

        def outside(y: np.ndarray) -> np.ndarray:
            return y - known @ (known.T @ y)

        right = -outside(residual)
        added = minres(lambda v: outside(product(v) - v * theta), right, inner_steps, 0.05) if len(theta) else right
        added = _orthogonal(added, locked, space)
        if not added.size:
            added = _orthogonal(rng.standard_normal((dim, k)), locked, space)
        if added.size:
            space, image = np.hstack([space, added]), np.hstack([image, product(added)])
        else:
            # The subspace is whole: what is left is the rounding of the products, which are renewed.
            space = _orthogonal(space, locked)
            image = product(space)
    raise RuntimeError(f"{k - len(values)} eigenvectors have not converged after {MAX_ROUNDS} rounds")


@dataclass(frozen=True)
class Whitening:
    """The fitted transform: number of rows, exact sums, eigenvalues, and eigenvectors as columns."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def _fit(centred: DataFrame, dim: int, n: int, sums: np.ndarray, k: int) -> Whitening:
    def multiplied(directions: np.ndarray) -> np.ndarray:
        return _summed(centred, dim, directions.shape, lambda x: x.T @ (x @ directions)) / n

    trace = float(_summed(centred, dim, (1,), lambda x: np.array([np.einsum("ij,ij->", x, x)]))[0]) / n
    values, vectors = jacobi_davidson(multiplied, dim, k) if trace > 0 else (np.zeros(0), np.zeros((dim, 0)))
    real = values > _NO_VARIANCE * trace
    return Whitening(n, sums, trace, values[real], vectors[:, real])


def _identity_error(centred: DataFrame, dim: int, model: Whitening) -> float:
    """The largest entry of the whitened rows' covariance minus the identity."""
    k, projection = len(model.values), model.projection
    if not k:
        return 0.0
    mean = _summed(centred, dim, (k,), lambda x: (x @ projection).sum(0)) / model.n

    def products(x: np.ndarray) -> np.ndarray:
        w = x @ projection - mean
        return w.T @ w

    return float(np.abs(_summed(centred, dim, (k, k), products) / model.n - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``, a row per vector and component.

    Each entry c of ``embedding`` becomes x = floor(1024 c) + 100000; all vectors are the fit list.
    ``deviation`` is the exact sum of (n x - S)^2, null where it needs more than 63 bits. ``whitened`` is the
    centred x along the component, in standard deviations; ``explained`` the component's share of the variance.

    Vectors that are null or hold null or non-finite entries take no part, nor do those with entries of
    2^31 and more. Shorter vectors end in zero entries. Repeated rows and null ids are rows like others.
    Components without variance are left out: a table of equal vectors, or of one, gives no rows, as does
    an empty one. Other columns are not read. Components of equal eigenvalue are any basis of their space.
    """
    spark = vectors.sparkSession
    ids = vectors.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("vec_id", ids), *T._parse_datatype_string(
        "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double").fields])
    clean = _clean(vectors)
    size = clean.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    if not size.n or not size.dim:
        return spark.createDataFrame([], schema)
    n, dim = size.n, size.dim
    scratch = Scratch(spark, "whitening")
    packed = scratch.keep(_packed(clean, dim, block_rows), "packed")
    sums = _summed(packed, dim, (dim,), lambda x: x.sum(0), np.int64)
    centred = scratch.keep(_centred(packed, dim, n, sums), "centred")
    scratch.drop(packed)
    model = _fit(centred, dim, n, sums, components)
    error, projection, k = _identity_error(centred, dim, model), model.projection, len(model.values)
    explained = model.values / model.trace if k else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch) if k else 0):
                own = batch.column(0)[i].values
                whitened = _matrix(batch.column(1)[i].as_py(), dim) @ projection
                each = np.repeat(np.arange(len(own)), k)
                yield pa.RecordBatch.from_arrays([
                    own.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))),
                    pa.array(np.full(len(each), n)), batch.column(2)[i].values.take(pa.array(each)),
                    pa.array(whitened.ravel()), pa.array(np.tile(explained, len(own))),
                    pa.array(np.full(len(each), error))], names=schema.names)

    return centred.mapInArrow(run, schema)
