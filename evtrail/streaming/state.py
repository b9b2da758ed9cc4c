"""Latest state per key for ``foreachBatch`` jobs, in buckets of keys.

Folder ``_version=<batch id>/_bucket=<b>`` holds the whole state of one
bucket as that batch left it.  A batch reads and writes only the buckets its
keys fall into, so what it writes follows the batch and not the state; a
bucket's state is its newest version.  A batch that is replayed reads the
versions before it and overwrites its own.  Once a batch has read a bucket's
newest earlier version no replay can ask for an older one, and older ones are
removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def bucket_of(key: str, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class BucketedState:
    """State rows of ``schema`` by ``key`` under ``path``."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        jvm = spark.sparkContext._jvm
        self._folder = jvm.org.apache.hadoop.fs.Path
        self._fs = self._folder(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> dict[int, list[int]]:
        """Bucket -> its versions, oldest first (at most two of each bucket)."""
        found: dict[int, list[int]] = {}
        for s in self._fs.globStatus(self._folder(f"{self.path}/_version=*/_bucket=*")) or ():
            at = s.getPath()
            version, bucket = (int(p.getName().split("=")[1]) for p in (at.getParent(), at))
            found.setdefault(bucket, []).append(version)
        return {b: sorted(v) for b, v in found.items()}

    def _read(self, places: list[tuple[int, int]], schema) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/_version={v}/_bucket={b}" for b, v in places]
        return self.spark.read.schema(schema).parquet(*paths)

    def current(self, schema) -> DataFrame:
        """The state of all buckets."""
        return self._read([(b, v[-1]) for b, v in self.versions().items()], schema)

    def merge(self, batch: DataFrame, batch_id: int, schema, step: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the buckets of the batch's keys by ``step(old state)``."""
        bucket = bucket_of(self.key, self.buckets)
        touched = {r[0] for r in batch.select(bucket).distinct().collect()}       # at most ``buckets`` numbers
        held = {b: [v for v in vs if v < batch_id] for b, vs in self.versions().items() if b in touched}
        new = step(self._read([(b, vs[-1]) for b, vs in held.items() if vs], schema))
        (new.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket")
         .parquet(f"{self.path}/_version={batch_id}"))
        for b, vs in held.items():
            for v in vs[:-1]:
                self._fs.delete(self._folder(f"{self.path}/_version={v}/_bucket={b}"), True)
