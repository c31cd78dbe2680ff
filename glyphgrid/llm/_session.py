"""Shared folders, block counts and small driver-side helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import leaf_bytes, shared_dir, work_path, written

__all__ = ["block_of", "free_name", "by_key", "by_key2", "give_back", "parts", "shared_dir", "table", "work_path", "written"]

#: Bytes of input files for each block or shard, at most. Texts are about three times as long as their compressed files.
_BLOCK = 64 << 20


def parts(df: DataFrame) -> int:
    """Number of blocks and shards for `df`: the session's shuffle partitions, more where the input's files are so large
    that a block would hold over 64 MB of them."""
    least = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-leaf_bytes(df) // _BLOCK))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, df: DataFrame) -> str:
    """`name`, or one made from it that no column of `df` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def block_of(key, n: int):
    """Block number of a row by the hash of its key."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def give_back() -> None:
    """Returns freed memory to the system, so that a worker that lives on doesn't keep the most it ever needed."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def by_key(fn, **given):
    """`fn(key, table, **given)` in the form that grouped Arrow functions take."""

    def run(key, table):
        out = fn(key, table, **given)
        del table
        give_back()
        return out

    return run


def by_key2(fn, **given):
    """`fn(key, left, right, **given)` in the form that cogrouped Arrow functions take."""

    def run(key, left, right):
        out = fn(key, left, right, **given)
        del left, right
        give_back()
        return out

    return run
