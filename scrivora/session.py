"""Session construction and the shared folder that every executor can read."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "scrivora", **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` entries override them (``__`` in a key stands for a dot)."""
    defaults = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    defaults |= {k.replace("__", "."): str(v) for k, v in conf.items()}
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only if that is unset and the master is local.

    A machine-local folder would be wrong on a cluster, where a lost executor takes it along, so there an unset
    folder is an error.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = tempfile.mkdtemp(prefix="scrivora-")
    spark.conf.set("spark.checkpoint.dir", found)
    atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found


#: Paths of the intermediate tables that are still there.
_written: set[str] = set()


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: this cuts the lineage, survives the loss
    of executors and costs compressed columnar bytes only. The table goes by :func:`release`, :func:`clear_intermediates`
    or when the driver's Python ends."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that is deleted like an intermediate table."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clear_intermediates, spark)
    _written.add(path)
    return path


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path in _written:
            _delete(table.sparkSession, path)


def clear_intermediates(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process; for long-lived services, between pieces of work."""
    for path in list(_written):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    _written.discard(path)
    local = path.removeprefix("file://").removeprefix("file:")
    if os.path.isdir(local):
        shutil.rmtree(local, ignore_errors=True)
        return
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the gateway is gone when the session was stopped first
        pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of a data directory."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Only a table of at most so many bytes is dealt out anew.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if its files make fewer tasks than half of them and hold at most :data:`SPREAD_BYTES`; a larger
    table stays as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if 2 * df._jdf.rdd().getNumPartitions() >= cores or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(cores)
