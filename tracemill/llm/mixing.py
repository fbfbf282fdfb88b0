"""Mixing sources to target weights, with DataFrame functions only.

Weights are the sources' token shares raised to an exponent and normalised. The exponent is searched
so that the mix reaches a target entropy and no source is repeated more often than allowed. The
weights become token budgets; each source fills its budget with permuted passes over its documents,
cut into blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tracemill.llm.scratch import Scratch
from tracemill.llm.sharding import BITS, position

# Share of the largest possible entropy, ln(number of sources), that the mix shall reach.
ENTROPY_SHARE = 0.95
# No document is used more often than this, rounded up.
MAX_REPEATS = 4.0
BLOCK_TOKENS = 1 << 16
# Rows of one source and pass that are sorted together.
RANGE_ROWS = 1 << 13
_DIGITS = (2, 4, 6)


def words() -> "F.Column":
    """Number of white-space separated words of ``text``."""
    return F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def _exponents(shares: DataFrame, total: int, budget: int, entropy_share: float, max_repeats: float) -> float:
    """The searched exponent, on a grid of six decimals.

    Entropy and repetition fall as the exponent rises from 0 (all sources equal) to 1 (natural shares).
    The result is the largest exponent that still reaches the target entropy or, if that repeats a
    source too often, the smallest one that does not. Each round evaluates a hundred exponents in one
    job over the source table and keeps one interval, so three rounds replace twenty bisections.
    """

    def crossing(meets: str, high_wins: bool) -> float:
        low = 0
        for digits in _DIGITS:
            grid = shares.select("share", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("i")).withColumn(
                "a", (low + F.col("i") * 10 ** (6 - digits)) / 1e6)
            curve = grid.groupBy("i").agg(
                F.count(F.lit(1)).alias("k"), F.sum(F.pow("share", "a")).alias("z"),
                F.sum(F.pow("share", "a") * F.ln("share")).alias("s"),
                F.max(F.pow("share", F.col("a") - 1)).alias("r"), F.first("a").alias("a"))
            good = curve.where(meets).agg(F.min("i"), F.max("i")).first()
            if high_wins:  # a falling condition holds from 0 up to the crossing
                if good[1] is None:
                    return 0.0
                if digits == 2 and good[1] == 100:
                    return 1.0
                low += good[1] * 10 ** (6 - digits)
            else:  # a rising condition holds from the crossing up to 1
                if good[0] is None:
                    return 1.0
                if good[0] == 0 and digits == 2:
                    return 0.0
                low += (good[0] - (digits != 6)) * 10 ** (6 - digits)
        return low / 1e6

    entropy = crossing(f"ln(z) - a * s / z >= {entropy_share!r} * ln(k) - 1e-12", True)
    bounded = crossing(f"r / z * {budget / total!r} <= {max_repeats!r} + 1e-12", False)
    return max(entropy, bounded)


def weights(docs: DataFrame, budget: int | None = None, entropy_share: float = ENTROPY_SHARE,
            max_repeats: float = MAX_REPEATS) -> DataFrame:
    """``(source, n_tokens, weight, budget)`` per source that has tokens.

    ``docs`` has source and n_tokens. The budget of the whole mix defaults to the tokens there are. If
    even natural shares repeat too often (a budget above ``max_repeats`` times the tokens), they are
    used as they are. Null is a source of its own. No tokens at all: no rows.
    """
    sums = docs.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens")).where("n_tokens > 0")
    total = sums.agg(F.sum("n_tokens")).first()[0] or 0
    if not total:
        return sums.select("source", "n_tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("bigint").alias("budget"))
    whole = total if budget is None else budget
    shares = sums.withColumn("share", F.col("n_tokens") / F.lit(total))
    exponent = _exponents(shares, total, whole, entropy_share, max_repeats)
    powers = shares.withColumn("power", F.pow("share", F.lit(exponent)))
    scale = powers.agg(F.sum("power")).first()[0]
    weight = F.round(F.col("power") / F.lit(scale), 9)
    return powers.select("source", "n_tokens", weight.alias("weight"),
                         F.floor(weight * F.lit(whole)).cast("bigint").alias("budget"))


def _dealt(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row once per pass of its source, with its place in that pass and the range it falls in."""
    passes = rows.join(plan, "source").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes"))))
    return passes.withColumn("place", position(F.col("epoch"), F.col("who"))).withColumn(
        "range", F.least(F.col("ranges") - 1, F.floor(
            F.col("place") / F.lit(float(1 << BITS)) * F.col("ranges")).cast("bigint")))


def mix(docs: DataFrame, budget: int | None = None, entropy_share: float = ENTROPY_SHARE,
        max_repeats: float = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS, range_rows: int = RANGE_ROWS,
        tokens: str | None = None, content: str | None = None) -> DataFrame:
    """The mixed corpus: rows of ``docs``, repeated or left out, with ``mix_tokens``, ``mix_epoch``,
    ``mix_block`` and ``mix_order``.

    A source passes over its documents as often as its budget holds; the last pass ends before the
    first document that would exceed the budget. Tokens are the words of ``text``, or the numbers in the
    column that ``tokens`` names; then the texts need not be there, and ``content`` may name a digest of
    them. Rows are placed by id and text, so that many rows of one id spread over all ranges. Every pass is a permutation of its own. mix_block
    numbers the pieces of ``block_tokens`` tokens in a source's stream; ordering rows by mix_order
    (place in the stream, in millionths) interleaves all sources evenly. Rows without words spend
    nothing and go along with every pass; a source without any words has weight zero and is left out.
    Null texts count as empty, null is a source of its own, a null doc_id counts as empty, repeated rows
    are used like different documents and follow each other, an empty table gives no rows, other
    columns pass through.

    Running sums are made inside ranges of the permutation and then over one summary row per range,
    so no source has to fit into a task.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    names = ["mix_tokens", "mix_epoch", "mix_block", "mix_order"]
    base = docs.drop(*names)
    size = (words() if tokens is None else F.coalesce(F.col(tokens), F.lit(0)).cast("bigint")).alias("n_tokens")
    counted = base.select(F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("source"), size)
    sums = scratch.keep(counted.groupBy("source").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_rows")), "sums")
    plan = weights(sums, budget, entropy_share, max_repeats).select(
        "source", F.col("n_tokens").alias("whole"), "budget",
        F.floor(F.col("budget") / F.col("n_tokens")).cast("bigint").alias("passes"))
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / F.lit(range_rows))).cast("bigint").alias("ranges")
    plan = scratch.keep(plan.join(sums.select("source", ranges), "source"), "plan")
    whole_row = F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("row")
    source = F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("source")
    digest = (F.md5(F.coalesce("text", F.lit(""))) if content is None and "text" in base.columns
              else F.coalesce(F.col(content or tokens).cast("string"), F.lit("")))
    who = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest).alias("who")
    dealt = _dealt(base.select(whole_row, "doc_id", who, source, size), plan)
    part = ["source", "epoch", "range"]
    slim = _dealt(base.select(who, source, size), plan.where("ranges > 1"))
    earlier = Window.partitionBy("source", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = slim.groupBy(*part).agg(F.sum("n_tokens").alias("held")).withColumn(
        "start", F.coalesce(F.sum("held").over(earlier), F.lit(0))).select(*part, "start")
    inside = Window.partitionBy(*part).orderBy("place", "doc_id", "n_tokens").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumn("running", F.sum("n_tokens").over(inside)).join(
        scratch.keep(starts, "starts"), part, "left").withColumn(
        "running", F.col("running") + F.coalesce("start", F.lit(0)))
    stream = F.col("epoch") * F.col("whole") + F.col("running") - F.col("n_tokens")
    return summed.where((F.col("epoch") < F.col("passes"))
                        | (F.col("running") <= F.col("budget") - F.col("passes") * F.col("whole"))).select(
        "row.*", F.col("n_tokens").alias("mix_tokens"), F.col("epoch").alias("mix_epoch"),
        F.floor(stream / F.lit(block_tokens)).cast("bigint").alias("mix_block"),
        F.floor(stream / F.greatest(F.col("budget"), F.lit(1)) * 1e6).cast("bigint").alias("mix_order"))
