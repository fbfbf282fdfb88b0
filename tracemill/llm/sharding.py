"""Shards of bounded size by extendible hashing, with DataFrame functions only.

A row's position is a 60-bit hash; a bucket is a prefix of it. The directory is indexed by the
longest prefix in use. Only buckets above the byte limit split on another bit.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tracemill.llm.scratch import Scratch

BITS = 60
# Bits by which the first counting goes beyond the depth that even sizes would need.
SLACK_BITS = 3
SHARD_BYTES = 16 << 20


def position(*columns) -> "F.Column":
    """The first 60 bits of an MD5 over the columns joined with a colon; null counts as empty."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _prefix(bits) -> "F.Column":
    return F.expr(f"shiftright(position, {BITS} - ({bits}))")


def _leaves(sizes: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """For every prefix of ``high`` bits the shallowest depth from ``low`` on whose bucket fits.

    ``sizes``: (position, n_bytes, n_rows) with position cut to ``high`` bits. A prefix whose bucket
    does not fit at any depth gets a null depth.
    """
    levels = sizes.select(
        "position", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), "n_bytes", "n_rows")
    buckets = levels.groupBy("depth", F.expr(f"shiftright(position, {BITS} - depth)").alias("prefix")).agg(
        F.sum("n_bytes").alias("shard_bytes"), F.sum("n_rows").alias("shard_rows"))
    fitting = buckets.where(F.col("shard_bytes") <= limit)
    cells = sizes.select("position", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn(
        "prefix", F.expr(f"shiftright(position, {BITS} - depth)"))
    best = cells.join(fitting, ["depth", "prefix"]).groupBy("position").agg(
        F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("best"))
    return sizes.select("position", "n_bytes", "n_rows").join(best, "position", "left").select(
        "position", "n_bytes", "n_rows", "best.depth", "best.prefix", "best.shard_bytes", "best.shard_rows")


def directory(rows: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """``(cell_bits, cell, depth, prefix, shard_bytes, shard_rows)``: which shard owns a cell.

    ``rows`` has ``position`` and ``n_bytes``. A cell is a prefix of ``cell_bits`` bits that lies in one
    shard. Deeper cells are counted only below prefixes that do not fit. A bucket that is too large
    with all bits used (one oversized row, or repeats of one row) is a shard of its own.
    """
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(1, math.ceil(math.log2(total / limit + 1))) + SLACK_BITS)
    found, open_rows = None, rows
    while True:
        cell = (_prefix(high) * F.lit(1 << (BITS - high))).alias("position")
        sizes = open_rows.groupBy(cell).agg(
            F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_rows"))
        leaves = scratch.keep(_leaves(sizes, low, high, limit), "leaves")
        last = high == BITS
        settled = leaves.where("depth is not null or " + str(last).lower()).select(
            F.lit(high).alias("cell_bits"), _prefix(high).alias("cell"),
            F.coalesce("depth", F.lit(high)).alias("depth"), F.coalesce("prefix", _prefix(high)).alias("prefix"),
            F.coalesce("shard_bytes", "n_bytes").alias("shard_bytes"),
            F.coalesce("shard_rows", "n_rows").alias("shard_rows"))
        found = settled if found is None else found.union(settled)
        crowded = leaves.where("depth is null").select(_prefix(high).alias("cell"))
        if last or not crowded.head(1):
            return found
        open_rows = open_rows.withColumn("cell", _prefix(high)).join(crowded, "cell", "left_semi").drop("cell")
        low, high = high + 1, min(BITS, high + 8)


def shard(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """Every row of ``docs`` with ``shard``, ``shard_depth``, ``shard_bytes``, ``shard_rows`` and ``oversize``.

    shard is the bucket's prefix as a bit string ('' if one shard holds all). The size of a row is its
    text in UTF-8 bytes. Rows are placed by doc_id and text, so a hot doc_id spreads. Nulls count as
    empty. No bit can split repeats of one row: where they exceed the limit they are dealt to numbered
    parts ('…/0', '…/1') of as many rows as fit, with their own bytes and rows. Only a single row above
    the limit is a shard or part above it; that one is ``oversize``. An empty table gives no rows; columns of docs with the names of the result are replaced.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    names = ["shard", "shard_depth", "shard_bytes", "shard_rows", "oversize"]
    base = docs.drop(*names)
    row = F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("row")
    placed = base.select(
        position(F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))).alias("position"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), row)
    slim = scratch.keep(placed.select("position", "n_bytes"), "positions")
    owners = scratch.keep(directory(slim, limit, scratch), "directory")
    depths = [r[0] for r in owners.select("cell_bits").distinct().collect()]  # at most eight
    keys = F.array(*[
        F.struct(F.lit(b).alias("cell_bits"), _prefix(b).alias("cell")) for b in sorted(depths) or [1]])
    if len(depths) > 1:
        # A row has one settled cell; the others of its prefixes are not in the directory.
        cells = slim.select("position", F.inline(keys)).distinct().join(owners, ["cell_bits", "cell"])
        owned = placed.join(cells.drop("cell_bits", "cell"), "position")
    else:
        owned = placed.withColumn("cell", _prefix((depths or [1])[0])).join(owners.drop("cell_bits"), "cell")
    bits = F.when(F.col("depth") == 0, "").otherwise(
        F.expr("lpad(bin(prefix), depth, '0')"))
    over = (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    result = ["row.*", "shard", F.col("depth").alias("shard_depth"), "shard_bytes", "shard_rows",
              (F.col("shard_bytes") > limit).alias("oversize")]
    named = owned.withColumn("shard", bits)
    if not owners.where(over).head(1):
        return named.select(*result)
    return named.where(~over).select(*result).union(_parts(named.where(over), limit, scratch).select(*result))


def _parts(repeats: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """Repeats of one row dealt to numbered parts of as many as fit, one at least.

    Rows are written first, so that their numbers stay if a task is repeated. They are counted inside
    the written partitions, then over one summary row per partition, so no task gets all repeats of a row.
    """
    task = F.shiftright("id", 33)
    stored = scratch.keep(repeats.withColumn("id", F.monotonically_increasing_id()), "repeats").withColumn("task", task)
    counts = stored.groupBy("position", "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("position").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("position", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("position", "task").orderBy("id")
    numbered = stored.withColumn("number", F.row_number().over(inside) - 1).join(before, ["position", "task"])
    fits = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("n_bytes"))).cast("bigint")
    part = F.floor((F.col("before") + F.col("number")) / F.col("fits")).cast("bigint")
    own = F.least(F.col("fits"), F.col("shard_rows") - F.col("part") * F.col("fits"))
    return numbered.withColumn("fits", fits).withColumn("part", part).withColumns({
        "shard": F.concat("shard", F.lit("/"), F.col("part").cast("string")),
        "shard_rows": own, "shard_bytes": own * F.col("n_bytes")})


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """The rows as Parquet files, one folder and (up to the limit) one file per shard.

    Rows of one shard meet in one task, which is bounded by the limit.
    """
    placed = shard(docs, limit)
    placed.repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)
