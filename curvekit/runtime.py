"""Session helpers: checkpoint folder, small-table checks, null-safe joins."""
from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def setting(spark: SparkSession, name: str, default: int) -> int:
    """A numeric library setting, read from the session (`curvekit.<name>`)."""
    return int(spark.conf.get(f"curvekit.{name}", str(default)))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in `spark.checkpoint.dir`.

    A folder of our own is made only where none is named, which is the case in local tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder so that later rounds survive lost executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def as_list(names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality of the named columns on both sides."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def attach(df: DataFrame, small: DataFrame, names: list[str], hint: bool = False, grows: bool = False) -> DataFrame:
    """Left join that keeps null keys and drops the right side's copies of them.

    `hint=True` is for right sides whose size has a proven bound, `grows=True` for those with a row per page, line or token:
    Spark's size of such a side is compressed file bytes without what explode adds, so it would be broadcast through the driver
    when it is a hundred times as large in memory. Both sides are sorted and merged instead. Otherwise Spark chooses by size.
    """
    right = small.select(*[F.col(n).alias(f"__r_{n}") for n in names],
                         *[c for c in small.columns if c not in names])
    on = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"__r_{n}")) for n in names])
    if hint:
        right = F.broadcast(right)
    elif grows:
        right = right.hint("merge")
    return df.join(right, on, "left").drop(*[f"__r_{n}" for n in names])


def input_bytes(df: DataFrame) -> int:
    """Bytes of the distinct inputs a plan reads, from Spark's own estimates (file sizes). Join estimates are left out:
    Catalyst multiplies the sizes of both sides, which says nothing about how many rows one key can have."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = {}
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        try:
            size = int(str(leaf.stats().sizeInBytes()))
        except ValueError:  # a checkpoint keeps the estimate of the plan it cut, which may have more digits than can be read
            size = 1 << 62
        sizes[leaf.canonicalized().hashCode()] = size
    return sum(sizes.values())
