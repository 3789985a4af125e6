"""Event extracts that arrive as files, loaded as a stream, and hourly vitals with a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, IntegerType, LongType, StructField, StructType

from stayline.functions.temporal import hour_of
from stayline.operators.loading import load_labs, load_vitals
from stayline.operators.sequences import hourly_vitals
from stayline.schema import SEQUENCE_VITALS
from stayline.sources.tables import reload_partitions

READINGS, HOURS = "readings", "hours"
# how Spark names the folder of a NULL
NO_DATE = "__HIVE_DEFAULT_PARTITION__"


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet table, take what is available now, and stop.

    The checkpoint makes a restarted run continue where the last one ended, without loss or repetition.
    """
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_vitals(raw: DataFrame, path: str, checkpoint: str, kept: DataFrame | None = None) -> StreamingQuery:
    """Load chart events: the batch loader as it is, with the cohort as the static side of its semi join."""
    return append_stream(load_vitals(raw, kept), path, checkpoint)


def stream_labs(raw: DataFrame, path: str, checkpoint: str, kept: DataFrame | None = None) -> StreamingQuery:
    return append_stream(load_labs(raw, kept), path, checkpoint)


def hourly_vitals_stream(vitals: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Hourly means of the six vitals per encounter over a stream.

    An hour is emitted once the watermark has passed its end; readings later than ``delay`` are dropped.
    """
    means = [F.avg(F.when(F.col("vital_type") == v, F.col("value"))).alias(v) for v in SEQUENCE_VITALS]
    # a watermark needs a zoned timestamp; the session runs in UTC
    timed = vitals.where(F.col("vital_type").isin(SEQUENCE_VITALS)).withColumn(
        "recorded_at", F.col("recorded_at").cast("timestamp")
    )
    windowed = timed.withWatermark("recorded_at", delay).groupBy(
        "encounter_id", F.window("recorded_at", "1 hour").alias("w")
    )
    return windowed.agg(*means).select(
        "encounter_id", F.col("w.start").cast("timestamp_ntz").alias("hour"), *SEQUENCE_VITALS
    )


def publish_hours(vitals: DataFrame, root: str, checkpoint: str, identity: Sequence[str] = (), period: str = "day",
                  parts: int = 16) -> StreamingQuery:
    """Hourly means of the six vitals as a table that later readings correct, however late they come.

    Takes what is available now and stops. Every batch keeps its readings by period (a unit of ``trunc``, or ``day``), part
    and batch number, and computes the periods' parts it touches again from all readings of them. Parts hold whole hours of
    encounters, and the hours of one encounter are spread over them. Both writes replace partitions only, so a batch
    that is run again, after a crash between them too, leaves what one run leaves.

    Readings that agree in ``identity`` are one: that of the latest batch counts, in a batch the greatest value. Without
    ``identity`` every reading counts. Readings without a time are an hour of their own. See ``published_hours``.
    """
    readings = f"{root.rstrip('/')}/{READINGS}"
    schema = StructType([*vitals.schema, StructField("period", DateType()), StructField("part", IntegerType()),
                         StructField("batch", LongType())])
    hour = hour_of(F.col("recorded_at"))
    date = F.to_date("recorded_at") if period == "day" else F.trunc("recorded_at", period)

    def publish(batch: DataFrame, number: int) -> None:
        placed = batch.where(F.col("vital_type").isin(SEQUENCE_VITALS)).withColumns({
            "period": date, "part": F.pmod(F.xxhash64("encounter_id", hour), F.lit(parts)).cast("int"),
            "batch": F.lit(number).cast("long")}).persist()
        try:
            reload_partitions(placed.repartition("period", "part"), readings, "period", "part", "batch")
            touched = placed.select("period", "part").distinct()
            # periods of the calendar, not rows: they tell which folders are listed
            periods = [row["period"] for row in touched.select("period").distinct().collect()]
            if periods:
                folders = [f"{readings}/period={NO_DATE if p is None else p}" for p in periods]
                stored = batch.sparkSession.read.schema(schema).option("basePath", readings).parquet(*folders)
                hours = _hours(stored, touched, identity)
                reload_partitions(hours.repartition("period", "part"), f"{root.rstrip('/')}/{HOURS}", "period", "part")
        finally:
            placed.unpersist()

    return (vitals.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _hours(stored: DataFrame, touched: DataFrame, identity: Sequence[str]) -> DataFrame:
    """The pivot of the stored readings of the touched periods' parts, with period and part."""
    place = ["period", "part"]
    named = touched.toDF("touched_period", "touched_part")
    again = stored.join(named, F.col("period").eqNullSafe(F.col("touched_period"))
                        & (F.col("part") == F.col("touched_part")), "left_semi")
    if identity:
        columns = dict.fromkeys([*place, "encounter_id", "recorded_at", "vital_type", *identity])
        again = (again.groupBy(*columns).agg(F.max(F.struct("batch", "value")).alias("last"))
                 .withColumn("value", F.col("last.value")))
    return hourly_vitals(again, keep=place)


def published_hours(spark: SparkSession, root: str) -> DataFrame:
    """encounter_id, hour and the six means as of the last batch; there is no table before the first reading."""
    means = ", ".join(f"`{v}` double" for v in SEQUENCE_VITALS)
    schema = f"encounter_id long, hour timestamp_ntz, {means}, period date, part int"
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{HOURS}").drop("period", "part")
