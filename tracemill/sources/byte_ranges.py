"""Sizes and digests of files of any size, by a data source whose partitions are planned byte ranges.

A task reads its ranges in chunks of one megabyte, so its memory does not depend on the files. The digest
of a whole file needs its bytes in order, so it is one stream; ``block_digests`` spreads one file over
many tasks, and a changed block shows without reading the others.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK_BYTES = 64 << 20
CHUNK_BYTES = 1 << 20
_NAME = "tracemill_byte_ranges"


@dataclass
class ByteRanges(InputPartition):
    """Ranges (path, file size, number of the block, begin, end) that one task reads."""

    ranges: list


class _Reader(DataSourceReader):
    def __init__(self, root: str, pattern: str, block_bytes: int):
        self.root, self.pattern, self.block_bytes = root, pattern, block_bytes

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:") else f"file://{self.root}")

    def partitions(self) -> list[ByteRanges]:
        """Ranges of about a block each; small files share a partition."""
        files, base = self._open()
        found = files.get_file_info(fs.FileSelector(base, recursive=True))
        out, held, size = [], [], 0
        for info in sorted(found, key=lambda i: i.path):
            if info.type != fs.FileType.File or not fnmatch.fnmatch(info.base_name, self.pattern):
                continue
            step = self.block_bytes or max(info.size, 1)
            for number, begin in enumerate(range(0, max(info.size, 1), step)):
                end = min(info.size, begin + step)
                held.append((info.path, info.size, number, begin, end))
                size += end - begin
                if size >= (self.block_bytes or BLOCK_BYTES):
                    out.append(ByteRanges(held))
                    held, size = [], 0
        return out + [ByteRanges(held)] if held or not out else out

    def read(self, partition: ByteRanges) -> Iterator[tuple]:
        files, base = self._open()
        for path, size, number, begin, end in partition.ranges:
            digest = hashlib.sha256()
            with files.open_input_file(path) as stream:
                stream.seek(begin)
                left = end - begin
                while left:
                    chunk = stream.read(min(CHUNK_BYTES, left))
                    if not chunk:
                        raise OSError(f"{path} is shorter than when it was listed")
                    digest.update(chunk)
                    left -= len(chunk)
            yield path[len(base):].lstrip("/"), size, number, end - begin, digest.hexdigest()


class _Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return _NAME

    def schema(self) -> str:
        return "path string, size bigint, block bigint, block_size bigint, sha256 string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("pattern", "*"), int(self.options.get("block_bytes", "0")))


def readable(root: str) -> bool:
    """Whether the workers can open the folder by themselves; other stores are left to Spark's readers."""
    try:
        fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
    except Exception:  # an unknown scheme, or a store without its client library
        return False
    return True


def _load(spark: SparkSession, root: str, pattern: str, block_bytes: int) -> DataFrame:
    spark.dataSource.register(_Source)
    return spark.read.format(_NAME).option("pattern", pattern).option("block_bytes", str(block_bytes)).load(root)


def whole_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``(path, size, sha256)`` of every file below ``root``, empty ones included."""
    return _load(spark, root, pattern, 0).select("path", "size", "sha256")


def block_digests(spark: SparkSession, root: str, pattern: str = "*", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(path, size, block, block_size, sha256)`` of every block of every file."""
    if block_bytes < 1:
        raise ValueError("block_bytes must be positive")
    return _load(spark, root, pattern, block_bytes)


def tree_digests(blocks: DataFrame) -> DataFrame:
    """``(path, size, n_blocks, tree_sha256)``: the digest over the block digests in order, 64 bytes a block."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "sha256"))), lambda b: b["sha256"])
    return blocks.groupBy("path", "size").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sha2(F.array_join(ordered, ""), 256).alias("tree_sha256"))


def changed_blocks(before: DataFrame, after: DataFrame) -> DataFrame:
    """Blocks that differ between two tables of block digests, found without reading any file.

    Trees are compared first, so that only blocks of files whose tree differs are joined.
    """
    ends = ["path", "size", "n_blocks", "tree_sha256"]
    same = tree_digests(before).select(ends).join(tree_digests(after).select(ends), ends, "left_semi").select("path")
    key = ["path", "block"]
    old, new = (b.join(same, "path", "left_anti").select(*key, F.col("sha256").alias(name))
                for b, name in ((before, "before"), (after, "after")))
    return old.join(new, key, "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
