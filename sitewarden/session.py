"""Session settings that the operators count on."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sitewarden", **options: str) -> SparkSession:
    """A session with UTC times and adaptive execution; options override or add settings."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | options
    return SparkSession.builder.appName(app).config(map=conf).getOrCreate()


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Only a
    single local JVM without that setting, as in tests, gets a temporary folder, which goes
    with the process; a cluster without it is an error."""
    conf = spark.sparkContext.getConf()
    if path := conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    master = conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        kept = tempfile.TemporaryDirectory(prefix="sitewarden-", ignore_cleanup_errors=True)
        atexit.register(kept.cleanup)
        _local_dirs[app] = kept.name
    return "file://" + _local_dirs[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder. Whoever writes to it deletes it."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_kept: list[str] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back, so that it isn't computed again and a
    lost executor takes nothing with it. Lazy results may read it, so it stays until release()."""
    path = scratch(df.sparkSession, name)
    _kept.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_until_release(path: str) -> str:
    """A folder that a lazy result reads; release() deletes it."""
    _kept.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete what saved() wrote and keep_until_release() named. For the caller, once the results
    that read it are written or no longer needed; at the end of a local session it is done anyway."""
    while _kept:
        delete(spark, _kept.pop())


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
