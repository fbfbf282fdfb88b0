"""Exact top-k inner products by a dual-tree search over cover trees.

Vectors are dealt to blocks around pivots, and every block of data and of queries gets a cover tree,
once: centres are vectors of the block, every vector below a node lies within the covering radius of its
centre, children cover half the radius of their node and their centres are farther apart than that.
For a pair of nodes no inner product can exceed ``<c, d> + r |d| + s |c| + r s``. Pairs below the worst
kth score of their query group are pruned, first whole blocks, then tree nodes inside the blocks that
are left. Vectors that lie all equally far from each other leave nothing to prune; results stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tracemill.llm.scratch import Scratch

K = 5
SCALE = 256
# Rows of a block; pivots are a bounded sample, larger cells are split by a hash.
BLOCK_ROWS = 4096
MAX_PIVOTS = 512
LEAF_ROWS = 32
# Children cover this share of their node's radius.
SHRINK = 0.5
_SALTS = 16
_NEVER = -(1 << 62)


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)``: v holds floor(scale * x) as doubles, which are whole numbers.

    Vectors that are null, empty, or hold a null or a non-finite component are left out.
    """
    v = F.col("embedding")
    clean = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                     & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(v.isNotNull() & (F.size(v) > 0)).where(clean).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


class CoverTree:
    """Nodes in arrays, in breadth-first order: centre (a row), covering radius, range of rows, range of children.

    Covering: the rows of a child lie within ``SHRINK`` times the node's radius of the child's centre.
    Separation: centres of children are farther apart than that. Nesting: the node's centre is the first of
    its children's. Centres are taken farthest first until all rows are covered, however many that needs.
    Centres that cover themselves alone are not nodes of their own: they are kept together in a ``loose``
    last child, a leaf as wide as the node, whose rows are bounded one by one.
    """

    def __init__(self, rows: np.ndarray, order: np.ndarray, nodes: np.ndarray):
        self.rows, self.order, self.nodes = rows, order, nodes
        self.points, self.low, self.high, self.first, self.last = (nodes[:, i].astype(np.int64) for i in (0, 2, 3, 4, 5))
        self.loose = nodes[:, 6] > 0
        self.radii, self.centres = nodes[:, 1], rows[self.points]
        self.norms = np.sqrt((self.centres ** 2).sum(1))

    @classmethod
    def build(cls, x: np.ndarray) -> "CoverTree":
        order = np.arange(len(x))
        middle = int(((x - x.mean(0)) ** 2).sum(1).argmin())
        norms = (x ** 2).sum(1)
        # Row of the centre in x, radius, rows from and to, children from and to, whether it is loose.
        nodes = [[middle, np.sqrt(cls._squares(x, norms, x, norms, middle).max()), 0, len(x), 0, 0, 0]]
        for node in nodes:  # grows while it is walked
            centre, radius, low, high = node[:4]
            if high - low <= LEAF_ROWS or radius == 0 or node[6]:
                continue
            kids = cls._children(x, norms, order, int(centre), radius, low, high)
            if kids:
                node[4:6] = len(nodes), len(nodes) + len(kids)
                nodes.extend(kids)
        at = np.empty(len(x), np.int64)
        at[order] = np.arange(len(x))
        table = np.array(nodes, np.float64)
        table[:, 0] = at[table[:, 0].astype(np.int64)]
        return cls(x[order], order, table)

    @staticmethod
    def _squares(rows: np.ndarray, row_norms: np.ndarray, x: np.ndarray, norms: np.ndarray, centre: int) -> np.ndarray:
        """Squared distances to a row; exact, as components are whole numbers."""
        return np.maximum(row_norms + norms[centre] - 2 * (rows @ x[centre]), 0)

    @classmethod
    def _children(cls, x: np.ndarray, norms: np.ndarray, order: np.ndarray, centre: int, radius: float, low: int,
                  high: int) -> list[list]:
        members = order[low:high]
        rows, own, centres, cover = x[members], norms[members], [centre], (radius * SHRINK) ** 2
        near = cls._squares(rows, own, x, norms, centre)
        owner = np.zeros(len(rows), np.int64)
        while True:
            far = int(near.argmax())
            if near[far] <= cover:
                break
            distance = cls._squares(rows, own, x, norms, int(members[far]))
            closer = distance < near
            owner[closer], near = len(centres), np.minimum(near, distance)
            centres.append(int(members[far]))
        sizes = np.bincount(owner, minlength=len(centres))
        if sizes.max() == 1:
            return []
        # Groups of several rows first, then all that stand alone.
        by_owner = np.lexsort((owner, sizes[owner] == 1))
        order[low:high] = members[by_owner]
        groups = np.flatnonzero(sizes > 1)
        ends = low + np.cumsum(sizes[groups])
        kids = []
        for group, end in zip(groups, ends):
            kids.append([centres[group], np.sqrt(near[owner == group].max()), end - sizes[group], end, 0, 0, 0])
        if ends[-1] < high:
            kids.append([centre, radius, ends[-1], high, 0, 0, 1])
        return kids

    def children(self, node: int) -> np.ndarray:
        return np.arange(self.first[node], self.last[node])


def _exact(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles as long as these are exact, else in Python integers."""
    peak = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * q.shape[1]
    if peak < 2 ** 53:
        return (q @ d.T).astype(np.int64)
    wide = np.dot(np.vectorize(int, otypes=[object])(q), np.vectorize(int, otypes=[object])(d).T)
    return np.clip(wide, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, ids: np.ndarray, k: int):
        self.own = ids
        self.scores = np.full((len(ids), k), _NEVER, np.int64)
        self.ids = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)

    def offer(self, low: int, high: int, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.scores.shape[1]
        ids = np.broadcast_to(ids, scores.shape)
        scores = np.where(ids == self.own[low:high, None], _NEVER, scores)
        s = np.hstack([self.scores[low:high], scores])
        i = np.hstack([self.ids[low:high], np.where(scores == _NEVER, np.iinfo(np.int64).max, ids)])
        order = np.lexsort((i, -s), axis=1)[:, :k]
        self.scores[low:high] = np.take_along_axis(s, order, 1)
        self.ids[low:high] = np.take_along_axis(i, order, 1)

    def worst(self, low: int, high: int) -> int:
        return int(self.scores[low:high, -1].min())


def dual_search(queries: CoverTree, data: CoverTree, data_ids: np.ndarray, best: Best) -> int:
    """Offers to ``best`` every data row that may belong to a query's k best. Returns how many pairs were scored."""
    stack, scored = [(0, 0)], 0
    while stack:
        q, d = stack.pop()
        r, s = queries.radii[q], data.radii[d]
        bound = float(queries.centres[q] @ data.centres[d]) + r * data.norms[d] + s * queries.norms[q] + r * s
        low, high = queries.low[q], queries.high[q]
        if bound + 1e-6 * (1 + abs(bound)) < best.worst(low, high):
            continue
        q_kids, d_kids = queries.children(q), data.children(d)
        if not len(q_kids) and not len(d_kids):
            rows = np.arange(data.low[d], data.high[d])
            if data.loose[d]:
                reach = data.rows[rows] @ queries.centres[q] + r * np.sqrt((data.rows[rows] ** 2).sum(1))
                rows = rows[reach + 1e-6 * (1 + np.abs(reach)) >= best.worst(low, high)]
            best.offer(low, high, _exact(queries.rows[low:high], data.rows[rows]), data_ids[rows][None, :])
            scored += int((high - low) * len(rows))
        elif len(d_kids) and (not len(q_kids) or s >= r):
            # The most promising child is taken first, so that the others meet a better kth score.
            promise = data.centres[d_kids] @ queries.centres[q] + data.radii[d_kids] * queries.norms[q]
            stack += [(q, d_kids[i]) for i in np.argsort(promise)]
        else:
            stack += [(c, d) for c in q_kids]
    return scored


def _unpack(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, np.float64).reshape(-1, dim)


_BLOCK = "block string, n int, ids binary, vectors binary, nodes binary, centre binary, radius double"


def _packed(rows: DataFrame, dim: int) -> DataFrame:
    """One row per block: its cover tree, with ids and vectors in the tree's order. ``rows``: (block, vec_id, v)."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        x = np.zeros((len(pdf), dim))
        for i, v in enumerate(pdf["v"]):
            x[i, :len(v)] = v
        tree = CoverTree.build(x)
        return pd.DataFrame([{
            "block": pdf["block"].iloc[0], "n": len(pdf), "ids": pdf["vec_id"].to_numpy(np.int64)[tree.order].tobytes(),
            "vectors": tree.rows.tobytes(), "nodes": tree.nodes.tobytes(), "centre": tree.centres[0].tobytes(),
            "radius": float(tree.radii[0])}])

    return rows.groupBy("block").applyInPandas(pack, _BLOCK)


def _tree(vectors: bytes, nodes: bytes, dim: int) -> CoverTree:
    return CoverTree(_unpack(vectors, dim), np.zeros(0, np.int64), _unpack(nodes, 7))


def _blocks(rows: DataFrame, dim: int, block_rows: int, scratch: Scratch, name: str) -> DataFrame:
    """Rows dealt to the nearest pivot and packed. Cells above ``block_rows`` are split by row, so that neither
    many copies nor a repeated id makes a block larger.
    """
    count = rows.count()
    wanted = max(1, min(MAX_PIVOTS, -(-count // block_rows)))
    # A bounded sample: at most MAX_PIVOTS vectors, chosen by a hash of the id.
    pivots = np.zeros((wanted, dim))
    for i, r in enumerate(rows.orderBy(F.xxhash64("vec_id")).limit(wanted).collect()):
        pivots[i, :len(r.v)] = r.v
    norms = (pivots ** 2).sum(1)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = 0
        for pdf in frames:
            x = np.zeros((len(pdf), dim))
            for i, v in enumerate(pdf["v"]):
                x[i, :len(v)] = v
            yield pdf.assign(pivot=(norms - 2 * x @ pivots.T).argmin(1).astype(np.int32),
                             turn=np.arange(done, done + len(pdf)))
            done += len(pdf)

    # Written once, so that a row keeps its turn if a task is repeated.
    dealt = scratch.keep(rows.mapInPandas(deal, "vec_id bigint, v array<double>, pivot int, turn bigint"), f"{name}-dealt")
    # At most MAX_PIVOTS rows.
    cells = dealt.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).select(
        "pivot", F.ceil(F.col("n") / block_rows).alias("parts"))
    block = F.concat_ws(":", "pivot", F.pmod(F.xxhash64("vec_id", "turn"), F.col("parts")))
    return scratch.keep(_packed(dealt.join(F.broadcast(cells), "pivot").select(
        block.alias("block"), "vec_id", "v"), dim), name)


_FOUND = "query_id bigint, vec_id bigint, score bigint"


def _searched(pairs: DataFrame, dim: int, k: int) -> DataFrame:
    """The k best of every pair of a query block and a data block.

    ``pairs``: (q_ids, q_vectors, q_nodes, d_ids, d_vectors, d_nodes, floor); floor is a score that each query of the
    block is known to reach k times.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple = (None, None)
        for pdf in frames:
            out = []
            for q_ids, q_vectors, q_nodes, d_ids, d_vectors, d_nodes, floor in zip(
                    pdf.q_ids, pdf.q_vectors, pdf.q_nodes, pdf.d_ids, pdf.d_vectors, pdf.d_nodes, pdf.floor):
                if held[0] != q_ids:
                    held = (q_ids, _tree(q_vectors, q_nodes, dim))
                queries, data = held[1], _tree(d_vectors, d_nodes, dim)
                best = Best(np.frombuffer(q_ids, np.int64), k)
                if not pd.isna(floor):
                    # Scores below the floor cannot be among the k best: empty places start just below it.
                    best.scores[:] = int(floor) - 1
                dual_search(queries, data, np.frombuffer(d_ids, np.int64), best)
                real = best.ids != np.iinfo(np.int64).max
                out.append(pd.DataFrame({
                    "query_id": np.repeat(best.own, k).reshape(real.shape)[real], "vec_id": best.ids[real],
                    "score": best.scores[real]}))
            yield pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return pairs.mapInPandas(run, _FOUND)


def _kept(found: DataFrame, k: int) -> DataFrame:
    """The k best per query, ties to the smaller id, over the k best of each of a few salted parts."""
    entry = F.struct((-F.col("score")).alias("s"), "vec_id")
    part = found.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(_SALTS)).alias("salt")).agg(
        F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("best"))
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
    return part.groupBy("query_id").agg(best.alias("best")).select(
        "query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def top_k(queries: DataFrame, data: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS,
          scale: int = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` best data rows by integer inner product.

    Both tables have vec_id and embedding. Components become floor(scale * x); a row never answers a
    query of the same vec_id. Equal scores rank by smaller vec_id. Vectors that are null, empty or hold
    null or non-finite components take no part; shorter ones are filled with zeros; null ids take no
    part. Repeated data rows are candidates of their own; a repeated query id is asked once, with its
    smallest vector. Fewer than k candidates: all of them. An
    empty table gives no rows. Other columns are not read.

    Query blocks first search their most promising data block, which gives each a worst kth score; then
    all pairs of blocks are bounded, and only those that can still matter become rows and are searched.
    """
    scratch = Scratch(data.sparkSession, "topk")
    rows = scratch.keep(quantised(data.where("vec_id is not null"), scale), "rows")
    asked = scratch.keep(quantised(queries.where("vec_id is not null"), scale).groupBy("vec_id").agg(
        F.min("v").alias("v")), "asked")
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    dim = max(dim, asked.agg(F.max(F.size("v"))).first()[0] or 0)
    if not dim:
        return data.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    d_blocks = _blocks(rows, dim, block_rows, scratch, "data")
    q_blocks = _blocks(asked, dim, max(1, block_rows // 8), scratch, "queries")
    met = _meetings(q_blocks, d_blocks)
    firsts = scratch.keep(_bounded(met, False).groupBy("q").agg(F.max_by("d", "promise").alias("d")), "firsts")
    names = ("ids", "vectors", "nodes")
    q_side = q_blocks.select(F.col("block").alias("q"), *[F.col(n).alias(f"q_{n}") for n in names])
    d_side = d_blocks.select(F.col("block").alias("d"), *[F.col(n).alias(f"d_{n}") for n in names])

    def pairs(keys: DataFrame) -> DataFrame:
        # One task per few pairs: a pair is two blocks of bounded size.
        return keys.join(q_side, "q").join(d_side, "d").repartition("q", "d").select(
            *[f"q_{n}" for n in names], *[f"d_{n}" for n in names], "floor")

    none = F.lit(None).cast("bigint")
    first = scratch.keep(_searched(pairs(firsts.withColumn("floor", none)), dim, k), "first")
    worst = first.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    # A query with fewer than k answers so far has no floor, and neither has its block.
    members = q_blocks.select(F.col("block").alias("q"), "ids").mapInPandas(_members, "q string, query_id bigint")
    floors = members.join(worst, "query_id", "left").groupBy("q").agg(F.when(
        F.min(F.coalesce("n", F.lit(0))) >= k, F.min("kth")).alias("floor"))
    left = scratch.keep(_bounded(met.join(floors, "q"), True).join(firsts, ["q", "d"], "left_anti").join(floors, "q").select(
        "q", "d", "floor"), "left")
    return _kept(first.union(_searched(pairs(left), dim, k)), k)


def _members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        lists = [np.frombuffer(b, np.int64) for b in pdf["ids"]]
        yield pd.DataFrame({"q": np.repeat(pdf["q"].to_numpy(), [len(x) for x in lists]),
                            "query_id": np.concatenate(lists) if lists else np.zeros(0, np.int64)})


def _meetings(q_blocks: DataFrame, d_blocks: DataFrame, group: int = 256) -> DataFrame:
    """``(q, centre, radius, nodes)``: every query block beside groups of about ``group`` data blocks.

    Only centres and radii travel; a group is met through its number.
    """
    slim = ["block", "centre", "radius"]
    groups = max(1, -(-d_blocks.count() // group))
    number = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")
    sides = d_blocks.select(*slim, number.alias("group")).groupBy("group").agg(
        F.collect_list(F.struct(*slim)).alias("nodes"))
    asking = q_blocks.select(*slim).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return asking.join(sides, "group").select(F.col("block").alias("q"), "centre", "radius", "nodes")


def _bounded(met: DataFrame, with_floor: bool) -> DataFrame:
    """``(q, d, promise)`` of the data blocks in each group that can matter.

    Without floors only the most promising one of a group; with them all whose bound reaches the floor. So
    no row is made for a pair of blocks that is not searched.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [pd.DataFrame({"q": [], "d": [], "promise": []})]
            for row in pdf.itertuples(index=False):
                a, r = np.frombuffer(row.centre, np.float64), row.radius
                c = np.array([np.frombuffer(n["centre"], np.float64) for n in row.nodes])
                s = np.array([n["radius"] for n in row.nodes])
                inner, length = c @ a, np.sqrt((c ** 2).sum(1))
                if not with_floor:
                    kept = np.array([inner.argmax()])
                else:
                    bound = inner + r * length + s * np.sqrt(a @ a) + r * s
                    bound += 1e-6 * (1 + np.abs(bound))
                    kept = np.arange(len(s)) if pd.isna(row.floor) else np.flatnonzero(bound >= row.floor)
                out.append(pd.DataFrame({"q": row.q, "d": [row.nodes[i]["block"] for i in kept], "promise": inner[kept]}))
            yield pd.concat(out)

    return met.mapInPandas(run, "q string, d string, promise double")
