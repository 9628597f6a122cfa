"""Folder handling and small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import shared_dir

#: Paths of saved tables by nested scope, innermost last; one stack for each thread.
_scopes = threading.local()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other table has, known to the scope it was made in."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _stack()[-1].append(path)
    return path


def _stack() -> list[list[str]]:
    if not hasattr(_scopes, "stack"):
        _scopes.stack, _scopes.lasting = [[]], set()
    return _scopes.stack


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there,
    and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def lasting(df: DataFrame) -> DataFrame:
    """df, a table from saved(), outlives the scope it was made in: the scope around has it then."""
    _stack()
    _scopes.lasting.add(df.saved_path)
    return df


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables saved within the block are deleted at its end, but for those marked as lasting.

    Every operator works in such a block and leaves only the tables that its lazy result
    reads. Outside of any block they stay until release()."""
    stack = _stack()
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            if path in _scopes.lasting:
                _scopes.lasting.discard(path)
                stack[-1].append(path)
            else:
                _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Delete the tables behind all results that operators have returned so far in this thread
    and scope. For the caller, once those results are written or no longer needed."""
    paths = _stack()[-1]
    while paths:
        _delete(spark, paths.pop())


def drop_saved(df: DataFrame) -> None:
    """Delete a table made by saved() that nothing reads any more."""
    _delete(df.sparkSession, df.saved_path)
    for paths in _stack():
        if df.saved_path in paths:
            paths.remove(df.saved_path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_order(df: DataFrame, order: list, name: str) -> DataFrame:
    """df sorted over all partitions (range partitions, sorted within), saved, with part (the
    number of the range) and row (the place in it)."""
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    # monotonically_increasing_id: the partition's number, then the row's in it.
    placed = saved(ranged.withColumn("at", F.monotonically_increasing_id()), name)
    out = placed.select(*df.columns, F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    out.saved_path = placed.saved_path
    return out


def parts_of(df: DataFrame, **sums: Column) -> DataFrame:
    """From in_order(): one row for each range (part), with its number of rows and the given sums,
    and for each of these the total of the ranges before (`before_...`).

    As large as the number of partitions, whatever the data: one task adds it up, and
    joins may broadcast it."""
    found = df.groupBy("part").agg(F.count("*").alias("rows"), *[c.alias(n) for n, c in sums.items()])
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return found.select("*", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"before_{n}") for n in ("rows", *sums)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
