"""Session settings and the shared folder for files that must outlive an executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every operator relies on. AQE splits skewed join partitions; a join feeding an
# aggregate on the same key is only split with forceOptimizeSkewedJoin.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


_staged: list[str] = []  # folders that this process wrote with stage()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else built."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "tallybook", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the runtime settings; ``settings`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir`` when the session was built."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(frame: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Used where a result feeds several later steps: it is computed once, and losing an executor
    costs a re-read instead of the whole lineage.
    """
    path = fresh_dir(frame.sparkSession, label)
    frame.write.option("compression", "zstd").parquet(path)
    _staged.append(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system holds it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a path, none if it is not there."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(found) if f.isDirectory()) if system.exists(found) else []


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def clear_staged(spark: SparkSession) -> None:
    """Delete the staged folders of this process; call it when the results that read them are done with."""
    while _staged:
        delete(spark, _staged.pop())
