"""Order-dependent computations whose groups may hold any share of the data.

A window function over a whole group sorts that group in one task. Every function here cuts a
group into consecutive order buckets of bounded size, works inside the buckets, and joins the
buckets through a summary table with one row per bucket. The results are exact; the bucket size
only changes how much one task sees.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracemill.session import written

BUCKET_ROWS = 1 << 20


def order_bucket(position: str | Column, rows: int = BUCKET_ROWS) -> Column:
    """Consecutive ranges of a position; each range holds at most ``rows`` distinct positions."""
    column = F.col(position) if isinstance(position, str) else position
    return column - F.pmod(column, F.lit(rows))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    buckets: Sequence[str],
    values: dict[str, tuple[str, Column]],
    totals_of: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive running ``max``, ``sum`` or ``count`` columns along ``order`` per key.

    ``buckets`` name columns that split a key into ranges and sort like ``order`` does. Values
    named in ``totals_of`` also get the value of the whole key, as ``<name>_total``.
    """
    inside_function = {"max": F.max, "sum": F.sum, "count": F.count}
    before_function = {"max": F.max, "sum": F.sum, "count": F.sum}
    groups = [*keys, *buckets]
    inside = (
        Window.partitionBy(*groups).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(*buckets)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = df.groupBy(*groups).agg(
        *[inside_function[kind](column).alias(name) for name, (kind, column) in values.items()]
    )
    carried = totals.select(
        *groups,
        *[before_function[kind](name).over(earlier).alias(f"_before_{name}")
          for name, (kind, _) in values.items()],
        *[before_function[values[name][0]](name).over(Window.partitionBy(*keys)).alias(f"{name}_total")
          for name in totals_of],
    )
    local = df.select(
        "*",
        *[inside_function[kind](column).over(inside).alias(f"_in_{name}")
          for name, (kind, column) in values.items()],
    )
    merged = [
        F.greatest(f"_in_{name}", f"_before_{name}").alias(name) if kind == "max"
        else (F.coalesce(F.col(f"_in_{name}"), F.lit(0))
              + F.coalesce(F.col(f"_before_{name}"), F.lit(0))).alias(name)
        for name, (kind, _) in values.items()
    ]
    return local.join(carried, groups).select(*df.columns, *merged, *[f"{name}_total" for name in totals_of])


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    buckets: Sequence[str],
    values: dict[str, Column],
) -> DataFrame:
    """Add the value each expression had on the row before, along ``order`` per key."""
    groups = [*keys, *buckets]
    inside = Window.partitionBy(*groups).orderBy(*order)
    along = Window.partitionBy(*keys).orderBy(*buckets)
    row = F.struct(*[column.alias(name) for name, column in values.items()])
    last = (
        df.groupBy(*groups).agg(F.max_by(row, F.struct(*order)).alias("_last"))
        .select(*groups, F.lag("_last").over(along).alias("_carried"))
    )
    local = df.select("*", F.lag(row).over(inside).alias("_near"))
    return local.join(last, groups).select(
        *df.columns,
        *[F.when(F.col("_near").isNotNull(), F.col(f"_near.{name}"))
          .otherwise(F.col(f"_carried.{name}")).alias(name) for name in values],
    )


def ranks(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, range_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add the zero-based rank of each row inside its keys along ``order``, whose columns tell rows apart.

    Rows are cut into even ranges of about ``range_rows`` over (keys, order) and sorted inside; then
    only one summary row per key and range is counted up. Ranges are written once, because they come from a
    sample that another run would draw anew.
    """
    along = [*keys, *order]
    ranges = max(1, -(-df.count() // range_rows))
    placed = written(df.repartitionByRange(ranges, *along).sortWithinPartitions(*along).withColumns({
        "_range": F.spark_partition_id(), "_at": F.expr("monotonically_increasing_id() & 8589934591")}), "ranked")
    counted = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select(*keys, "_range", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(before, [*keys, "_range"]).withColumn(
        name, F.col("_before") + F.col("_at") - F.col("_first")).select(*df.columns, name)


def trigram_profile(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    buckets: Sequence[str],
    symbol: str,
    alphabet: Sequence[str],
) -> DataFrame:
    """Count every symbol and every overlapping run of three symbols per key.

    Output columns: the keys, ``<s>_sum`` per symbol, one column per possible trigram.
    Rows are shuffled once by (key, bucket) and counted there per trigram; only bucket summaries,
    which hold each trigram at most once, are shuffled by key.
    """
    groups = [*keys, *buckets]
    grams = ["".join(letters) for letters in product(alphabet, repeat=3)]
    size = len(alphabet)
    inside = Window.partitionBy(*groups).orderBy(*order)
    digit = f"array_position(array({', '.join(repr(s) for s in alphabet)}), {symbol}) - 1"
    marked = df.withColumn("_one", F.expr(digit)).select(
        *groups, "_one", F.col(symbol).alias("_text"),
        F.lead("_one", 1).over(inside).alias("_two"),
        F.lead("_one", 2).over(inside).alias("_three"),
        F.lead(symbol, 1).over(inside).alias("_next"),
        F.lag("_one", 1).over(inside).isNull().alias("_first"),
    )
    # The first symbol of a trigram is its code's leading digit; the last two rows of a bucket
    # start no trigram inside it and count below zero.
    parts = marked.selectExpr(
        *groups,
        f"coalesce(_one * {size * size} + _two * {size} + _three, -1 - _one) AS _code",
        "CASE WHEN _first THEN concat(_text, coalesce(_next, '')) END AS _head",
        "CASE WHEN _two IS NOT NULL AND _three IS NULL THEN concat(_text, _next)"
        " WHEN _two IS NULL AND _first THEN _text END AS _tail",
    ).groupBy(*groups, "_code").agg(
        F.count("*").alias("_n"), F.max("_head").alias("_head"), F.max("_tail").alias("_tail"))
    summaries = parts.groupBy(*groups).agg(
        F.collect_list(F.struct("_code", "_n")).alias("_counts"),
        F.max("_head").alias("_head"), F.max("_tail").alias("_tail"))
    # A trigram that starts in the last two rows of a bucket ends in the following buckets.
    along = Window.partitionBy(*keys).orderBy(*buckets)
    bridged = summaries.select(
        *keys, "_counts", "_tail",
        F.lead("_head", 1).over(along).alias("_near"),
        F.lead("_head", 2).over(along).alias("_far"),
    ).selectExpr(
        *keys, "_counts", "_tail",
        "concat(_tail, substring(concat(coalesce(_near, ''), coalesce(_far, '')), 1, 2)) AS _span",
    ).selectExpr(
        *keys, "_counts", "substring(_span, 1, 3) AS _bridge_one",
        "IF(length(_tail) = 2, substring(_span, 2, 3), '') AS _bridge_two",
    )
    names = f"array({', '.join(map(repr, grams))})"
    # Bridging trigrams are added to the pattern only: their first symbol is counted already.
    counted = bridged.selectExpr(
        *keys,
        "inline(concat(transform(_counts, c -> named_struct('_code', c._code, '_n', c._n, '_bridge', 0L)),"
        " transform(filter(array(_bridge_one, _bridge_two), b -> length(b) = 3),"
        f" b -> named_struct('_code', array_position({names}, b) - 1, '_n', 0L, '_bridge', 1L))))",
    ).groupBy(*keys, "_code").agg(F.sum("_n").alias("_n"), F.sum("_bridge").alias("_bridge"))
    symbol_of = f"IF(_code < 0, -1 - _code, _code div {size * size})"
    return counted.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_code", F.col("_n") + F.col("_bridge")))).alias("_by_code"),
        *[F.expr(f"sum(IF({symbol_of} = {i}, _n, 0L)) AS {s}_sum") for i, s in enumerate(alphabet)],
    ).select(
        *keys, *[f"{s}_sum" for s in alphabet],
        *[F.expr(f"coalesce(_by_code[{i}L], 0L) AS {gram}") for i, gram in enumerate(grams)],
    )
