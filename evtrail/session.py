"""SparkSession construction and cluster-level settings.

The library never hard-codes a scratch location: checkpoints go to the
folder the cluster names in ``spark.checkpoint.dir``.  Only when that is
unset and the master is local (unit tests, a laptop) do we create a private
temporary folder, removed when the interpreter ends; on a cluster an unset
folder is an error, since no other node could read ours.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC wall-clock (timestamps are naive UTC in
# the source data), adaptive execution with skew handling, Arrow transfer.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


_LOCAL_FOLDERS: list[tempfile.TemporaryDirectory] = []


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "evtrail", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "16g"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a private one only if it
    is unset in local mode, and fail on a cluster."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    sc_dir = spark.sparkContext.getCheckpointDir()
    if current:
        if not sc_dir:
            spark.sparkContext.setCheckpointDir(current)
        return current
    if sc_dir:
        return sc_dir
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    holder = tempfile.TemporaryDirectory(prefix="evtrail-ckpt-", ignore_cleanup_errors=True)
    _LOCAL_FOLDERS.append(holder)             # removed with the interpreter
    spark.conf.set("spark.checkpoint.dir", holder.name)
    spark.sparkContext.setCheckpointDir(holder.name)
    return holder.name


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never ``localCheckpoint``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def data_version(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and modification times of the files of a data folder (and
    of the table folders in it), read through the session's file systems."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for entry in fs.listStatus(path):
        for f in fs.listStatus(entry.getPath()) if entry.isDirectory() else [entry]:
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


_MEMO: dict = {}


def memo_checkpoint(fn):
    """Materialise ``fn(spark, sf_dir)`` once per (application, data folder,
    version of its files) as a reliable checkpoint and reuse it: intermediate
    tables that many queries build on (decision table, cases, scored
    candidates, modelling table) are computed once per run, and again when
    the files change."""
    def wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (fn.__module__, fn.__qualname__, spark.sparkContext.applicationId, sf_dir, data_version(spark, sf_dir))
        if key not in _MEMO:
            _MEMO[key] = cut_lineage(fn(spark, sf_dir))
        return _MEMO[key]
    wrap.__wrapped__ = fn
    wrap.__doc__ = fn.__doc__
    wrap.__name__ = fn.__name__
    return wrap
