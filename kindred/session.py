"""Session settings and the shared folder jobs write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key's join even where the split costs the following operator a shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Stream state on local disk with changelog checkpoints: it may outgrow executor memory.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

# Fixed when the session is built: records no Python call site per column expression, which makes
# building large plans about a fifth faster.
STATIC = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


# Folders handed out by shared_dir.
_WRITTEN: list[str] = []


def build_session(app_name: str = "kindred", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {**STATIC, **DEFAULTS}
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply those runtime settings that a session someone else built leaves open."""
    given = spark.conf.getAll
    for key, value in DEFAULTS.items():
        if key not in given:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that every executor can reach.

    The cluster names that folder in ``spark.checkpoint.dir``. A temporary folder of this
    machine is used only when the session itself is local and the setting is absent.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete every folder this process has settled tables in; call it when no result is read any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    while _WRITTEN:
        path = hadoop(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a (small) intermediate table to the shared folder and read it back.

    The optimizer then knows its real size, so it broadcasts the table only if it is below
    ``spark.sql.autoBroadcastJoinThreshold``; every use sees the same rows, and losing an executor
    costs no recomputation.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
