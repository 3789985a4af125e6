"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SCRATCH_CONF = "spark.checkpoint.dir"


def get_spark(app: str = "stayline", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; pass ``master`` only for local runs.

    Recording the Python line of every column expression, for error messages, is off: it takes most of the
    time to build a plan with hundreds of expressions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="stayline-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may run without the setting; it gets a temporary folder of its own.
    """
    root = spark.conf.get(SCRATCH_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SCRATCH_CONF} to a folder that all executors share")
        root = _local_folder()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_COPIES: list[str] = []


def copies_made() -> list[str]:
    """Paths of the copies made in this process and not removed."""
    return list(_COPIES)


def remove_copies(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete copies ``materialize`` has made in this process, all or those at ``paths``.

    Call it when results are written: frames that read the copies can't be used afterwards. Returns how many
    there were.
    """
    gone = [p for p in _COPIES if paths is None or p in paths]
    for name in gone:
        remove(spark, name)
        _COPIES.remove(name)
    return len(gone)


def remove(spark: SparkSession, name: str) -> None:
    """Delete a folder on whatever file system it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result is read several times (model fitting, metrics). The copy survives the loss of
    executors and cuts the lineage; ``remove_copies`` deletes it.
    """
    path = scratch_path(df.sparkSession, name)
    _COPIES.append(path)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
