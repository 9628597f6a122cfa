"""Upserts of micro-batches into a stored table: only the key buckets that a batch touches are
written again, and a batch that comes twice changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import delete

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class BucketedTable:
    """A Parquet table in folders `bucket=0` to `bucket=n-1` by a hash of its key.

    merge(old, new) gives what a bucket holds after new rows; both have the table's columns. It
    may change rows and add some, but not empty a bucket. A bucket's rows carry the number of
    the last batch that the bucket has taken."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, merge: Merge, buckets: int = 64):
        self.spark, self.path, self.key, self.merge, self.buckets = spark, path.rstrip("/"), key, merge, buckets
        self.schema = f"{schema}, batch_id long, bucket int"

    def read(self) -> DataFrame:
        """The table without its own columns."""
        return self._stored().drop("batch_id", "bucket")

    def _stored(self) -> DataFrame:
        if not self._exists(self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data") if self._exists(f"{self.path}/data") else self.spark.createDataFrame([], self.schema)

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Take a batch. Buckets that have it, or a later one, already are left as they are.

        What the touched buckets will hold is written beside the table first. If the job is
        lost while folders are exchanged, the next try takes that instead of merging again,
        with a folder that may be half gone. The list of touched buckets is at most `buckets`
        numbers long."""
        staged = f"{self.path}/staged/batch-{batch_id}"
        if not self._exists(f"{staged}/_SUCCESS"):
            new = batch.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
            old = self._stored()
            taken = {r["bucket"]: r["b"] for r in old.groupBy("bucket").agg(F.max("batch_id").alias("b")).collect()}
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect() if taken.get(r["bucket"], -1) < batch_id]
            if not touched:
                return
            before = old.where(F.col("bucket").isin(touched))
            columns = [c for c in before.columns if c not in ("batch_id", "bucket")]
            merged = self.merge(before.select(columns), new.where(F.col("bucket").isin(touched)).select(columns))
            stamped = merged.select(*columns, F.lit(batch_id).cast("long").alias("batch_id"), F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket"))
            stamped.repartition("bucket").write.mode("overwrite").parquet(staged)
        self._exchange(staged)
        delete(self.spark, staged)

    def _exchange(self, staged: str) -> None:
        held = self.spark.read.schema(self.schema).parquet(staged)
        held.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/data")

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Take all that a stream has now, micro-batch by micro-batch."""
        stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
