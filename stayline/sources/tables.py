"""Typed tables at rest, as Parquet, with JDBC as an alternative source."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.schema import MODEL_VERSION, TABLES
from stayline.session import materialize

LOADS, COMMITS = "_loads", "_commits"
KEPT_LOADS = 2


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table with its declared schema, as of the last load; nothing is inferred."""
    return spark.read.schema(TABLES[name]).parquet(table_path(spark, root, name))


def read_tables(spark: SparkSession, root: str, *names: str) -> dict[str, DataFrame]:
    """Several tables, all of the same load."""
    places = current_paths(spark, root)
    return {name: spark.read.schema(TABLES[name]).parquet(places.get(name, own_path(root, name))) for name in names or TABLES}


def table_path(spark: SparkSession, root: str, name: str) -> str:
    """Where the rows of a table lie now: in the folder of the last load that had it, else in one of its own."""
    return current_paths(spark, root).get(name, own_path(root, name))


def own_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def read_database_table(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
                        partitions: int, **properties: str) -> DataFrame:
    """A database table read in parallel over ranges of an integer key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=properties)


def append_table(df: DataFrame, root: str, name: str) -> None:
    """Append rows; no rows is not an error and leaves the table readable."""
    _in_declared_order(df, name).write.mode("append").parquet(table_path(df.sparkSession, root, name))


# sort keys of the event tables, for lookups and reductions per encounter
CLUSTER_KEYS = {
    "diagnosis": ("encounter_id", "seq_num"),
    "medication": ("encounter_id", "drug_name"),
    "vital_sign": ("encounter_id", "recorded_at"),
    "lab_result": ("encounter_id", "chart_time"),
}


def reload_tables(tables: dict[str, DataFrame], root: str, cluster: bool = False, keep: int = KEPT_LOADS) -> None:
    """Replace whole tables in one step, event tables optionally clustered by encounter.

    The rows are written to a folder of their own; readers see them, all at once, when the load is committed. A load that
    fails before leaves all tables as they were, and one that another load has overtaken fails. Tables that aren't in ``tables``
    stay. Old rows can be read for ``keep`` - 1 further loads, so a query that began before a load ends well.
    """
    spark = next(iter(tables.values())).sparkSession
    number = last_load(spark, root) + 1
    places = current_paths(spark, root)
    folder = f"{root.rstrip('/')}/{LOADS}/{number:010d}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        rows = _in_declared_order(df, name)
        if cluster and name in CLUSTER_KEYS:
            rows = clustered(rows, *CLUSTER_KEYS[name])
        rows.write.parquet(f"{folder}/{name}")
    commit_load(spark, root, number, places | {name: f"{folder}/{name}" for name in tables})
    expire_loads(spark, root, keep)


def clustered(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in ranges of the keys, sorted within each file.

    Takes the place of secondary indexes: a lookup by the first key skips all other row groups, and reductions
    per key are nearly done before their shuffle. Further keys let a range end inside a key with many rows.
    """
    # the copy is what Spark samples for the ranges: whatever made the rows, parsing above all, runs once
    return materialize(df, "unclustered").repartitionByRange(*keys).sortWithinPartitions(*keys)


def reload_partitions(df: DataFrame, path: str, *partition_by: str) -> None:
    """Replace only the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def append_predictions(scored: DataFrame, root: str, version: str = MODEL_VERSION) -> None:
    """Append scored rows to the prediction log: scores rounded to 4 places, stamped with the time."""
    scores = {c: F.round(c, 4) for c in ("xgb_score", "lstm_score", "cnn_score", "fusion_score")}
    log = scored.withColumns(scores).withColumns(
        {"model_version": F.lit(version), "predicted_at": F.current_timestamp()}
    )
    columns = TABLES["risk_prediction"].names
    log.select(*columns).write.mode("append").partitionBy("model_version").parquet(
        table_path(scored.sparkSession, root, "risk_prediction")
    )


def _in_declared_order(df: DataFrame, name: str) -> DataFrame:
    """Cast to the declared types; columns the rows do not have are NULL."""
    return df.select([
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in TABLES[name]
    ])


# --- loads -----------------------------------------------------------------------------------
# A commit is one small file, ``<root>/_commits/<number>``, with the place of every table. It is written under another name
# and then renamed, which fails if the number is taken; the highest number counts.


def _files(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def _numbers(spark: SparkSession, root: str) -> list[int]:
    system, path = _files(spark, f"{root.rstrip('/')}/{COMMITS}")
    names = [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []
    return sorted(int(n) for n in names if n.isdigit())


def last_load(spark: SparkSession, root: str) -> int:
    """Number of the last committed load, 0 without any."""
    return max(_numbers(spark, root), default=0)


def current_paths(spark: SparkSession, root: str) -> dict[str, str]:
    """Places of the tables that were ever loaded, by the last commit."""
    number = last_load(spark, root)
    return _committed(spark, root, number) if number else {}


def _committed(spark: SparkSession, root: str, number: int) -> dict[str, str]:
    system, path = _files(spark, f"{root.rstrip('/')}/{COMMITS}/{number:010d}")
    stream = system.open(path)
    try:
        reader = spark.sparkContext._jvm.java.io.InputStreamReader(stream, "UTF-8")
        return json.loads(spark.sparkContext._jvm.java.io.BufferedReader(reader).readLine())
    finally:
        stream.close()


def commit_load(spark: SparkSession, root: str, number: int, places: dict[str, str]) -> None:
    """Make ``places`` the current ones, if no other load has taken ``number``."""
    folder = f"{root.rstrip('/')}/{COMMITS}"
    system, target = _files(spark, f"{folder}/{number:010d}")
    _, draft = _files(spark, f"{folder}/draft-{uuid.uuid4().hex}")
    stream = system.create(draft, True)
    try:
        stream.write(bytearray(json.dumps(places).encode()))
    finally:
        stream.close()
    if system.exists(target) or not system.rename(draft, target):
        system.delete(draft, False)
        raise RuntimeError(f"another load of {root} was committed as number {number}")


def expire_loads(spark: SparkSession, root: str, keep: int = KEPT_LOADS) -> int:
    """Delete the commits before the last ``keep``, and folders of loads that no commit left and no later load uses."""
    numbers = _numbers(spark, root)
    kept = numbers[-keep:]
    used = {place.rsplit("/", 2)[1] for n in kept for place in _committed(spark, root, n).values()}
    for n in numbers[:-keep]:
        system, path = _files(spark, f"{root.rstrip('/')}/{COMMITS}/{n:010d}")
        system.delete(path, False)
    system, path = _files(spark, f"{root.rstrip('/')}/{LOADS}")
    gone = 0
    for status in system.listStatus(path) if system.exists(path) else []:
        name = status.getPath().getName()
        # folders of the newest number may belong to a load that is still running
        if name not in used and int(name.split("-")[0]) < kept[-1]:
            system.delete(status.getPath(), True)
            gone += 1
    return gone
