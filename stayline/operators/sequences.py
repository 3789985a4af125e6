"""Hourly vital sequences: build, resolve, gather, fill, pad and scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions import arrays
from stayline.functions.scores import finite_or
from stayline.functions.temporal import hour_of, seconds_between
from stayline.schema import SEQUENCE_HOURS, SEQUENCE_VITALS
from stayline.session import materialize

FLAT = 1e-3


def _hourly_means() -> list[Column]:
    return [F.avg(F.when(F.col("vital_type") == v, F.col("value"))).alias(v) for v in SEQUENCE_VITALS]


def first_stays(icu_stays: DataFrame) -> DataFrame:
    """Each encounter's first ICU stay by (start, stay id); stays without a start are ignored."""
    start = F.struct("icu_intime", "icu_stay_id")
    return (
        icu_stays.where(F.col("icu_intime").isNotNull() & F.col("encounter_id").isNotNull())
        .groupBy("encounter_id").agg(F.min(start).alias("first"))
        .select("encounter_id", "first.icu_stay_id", "first.icu_intime")
    )


def vital_sequence(icu_stays: DataFrame, vitals: DataFrame, labels: DataFrame) -> DataFrame:
    """Hourly means of the six vitals over the first 48 hours of each encounter's first ICU stay.

    ``hour_offset`` counts whole hours since the start of the stay. A reading at the start belongs to it, one
    exactly 48 hours later does not. Encounters without a label drop out. The labelled stays are written out
    first: their size is then known, so Spark either broadcasts them, and the readings, by far the largest
    table, are not shuffled before they are averaged, or sort-merges both.
    """
    stays = materialize(
        first_stays(icu_stays).join(labels.select("encounter_id", "readmitted_30d"), "encounter_id"), "stays"
    )
    readings = vitals.where(
        F.col("vital_type").isin(SEQUENCE_VITALS) & F.col("icu_stay_id").isNotNull()
    ).select("icu_stay_id", "vital_type", "value", "recorded_at")
    hour = F.floor(seconds_between(F.col("icu_intime"), F.col("recorded_at")) / 3600).cast("int")
    window = F.make_dt_interval(hours=F.lit(SEQUENCE_HOURS))
    return (
        readings.join(stays, "icu_stay_id")
        .where((F.col("recorded_at") >= F.col("icu_intime")) & (F.col("recorded_at") < F.col("icu_intime") + window))
        .groupBy("encounter_id", "readmitted_30d", hour.alias("hour_offset"))
        .agg(*_hourly_means())
    )


def hourly_vitals(vitals: DataFrame, only_sequence_vitals: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Means of the six vitals per encounter and clock hour.

    With ``only_sequence_vitals`` off, hours that hold only other vital types give a row of NULLs. ``keep`` names
    columns that follow from encounter and hour and stay.
    """
    if only_sequence_vitals:
        vitals = vitals.where(F.col("vital_type").isin(SEQUENCE_VITALS))
    return vitals.groupBy("encounter_id", hour_of(F.col("recorded_at")).alias("hour"), *(keep or [])).agg(*_hourly_means())


def latest_steps(rows: DataFrame, step: str, length: int = SEQUENCE_HOURS) -> DataFrame:
    """The last ``length`` rows of every encounter; a NULL step counts as the latest.

    Spark keeps the top rows of each key on the map side as well, so a key with many rows sends few.
    """
    latest = Window.partitionBy("encounter_id").orderBy(F.col(step).desc_nulls_first())
    return rows.withColumn("_rank", F.row_number().over(latest)).where(F.col("_rank") <= length).drop("_rank")


def resolve_sequences(sequences: DataFrame, vitals: DataFrame, policy: str = "api",
                      parity_order: bool = False) -> DataFrame:
    """(encounter_id, step, six vitals, source): the ICU sequence, or else the latest 48 clock hours.

    Policy ``api`` takes only hours with one of the six vitals, ``offline`` any hour. Steps ascend in time;
    ``parity_order`` numbers the clock hours newest first instead.
    """
    hourly = hourly_vitals(vitals, only_sequence_vitals=policy == "api")
    missing = hourly.join(sequences.select("encounter_id"), "encounter_id", "left_anti")
    newest_first = Window.partitionBy("encounter_id").orderBy(F.col("hour").desc_nulls_first())
    oldest_first = Window.partitionBy("encounter_id").orderBy(F.col("hour").asc_nulls_last())
    fallback = latest_steps(missing, "hour").withColumn(
        "step", F.row_number().over(newest_first if parity_order else oldest_first) - 1
    )
    primary = sequences.select("encounter_id", F.col("hour_offset").alias("step"), *SEQUENCE_VITALS,
                               F.lit("vital_sequence").alias("source"))
    return primary.unionByName(
        fallback.select("encounter_id", "step", *SEQUENCE_VITALS, F.lit("vital_sign").alias("source"))
    )


def gather(rows: DataFrame, step: str = "step", *keep: str) -> DataFrame:
    """One row per encounter: ``steps``, the last 48 steps in order, each an array of the six vitals.

    ``keep`` names columns that are constant within an encounter.
    """
    values = F.array(*[F.col(v).cast("double") for v in SEQUENCE_VITALS])
    return (
        latest_steps(rows, step)
        .groupBy("encounter_id")
        .agg(
            F.sort_array(F.collect_list(F.struct(F.col(step).isNull().alias("late"), F.col(step).alias("at"),
                                                 values.alias("values")))).alias("steps"),
            *[F.first(c).alias(c) for c in keep],
        )
        .withColumn("steps", F.col("steps")["values"])
        .withColumn("n_rows", F.size("steps"))
    )


def fill_zero(steps: Column) -> Column:
    """Missing and non-finite values become 0."""
    return arrays.map_cells(steps, lambda v, i: F.coalesce(finite_or(v), F.lit(0.0)))


def fill_column_mean(steps: Column, means: Column | None = None) -> Column:
    """Missing values become the encounter's mean of that vital, 0 when it has none."""
    means = arrays.column_means(steps) if means is None else means
    return arrays.bound(means, lambda own: arrays.map_cells(steps, lambda v, i: F.coalesce(v, own[i])))


def training_sequences(sequences: DataFrame) -> DataFrame:
    """(encounter_id, label, n_rows, steps): 48 x 6 training arrays.

    Missing values are 0; shorter sequences are padded in front with the mean of their real rows. Sequences
    whose cells sum to 0 are dropped, but only full ones: padding is still undefined when that is checked.
    """
    gathered = gather(sequences, "hour_offset", "readmitted_30d").withColumn("steps", fill_zero(F.col("steps")))
    full = F.col("n_rows") >= SEQUENCE_HOURS
    sum_is_zero = arrays.total(arrays.cells(F.col("steps"))) == 0
    return gathered.where(~(full & sum_is_zero)).select(
        "encounter_id",
        F.col("readmitted_30d").alias("label"),
        "n_rows",
        arrays.pad_front(F.col("steps"), arrays.column_means(F.col("steps"))).alias("steps"),
    )


def column_statistics(rows: DataFrame) -> DataFrame:
    """One row per encounter: number of rows, and count, mean and variance of each vital over all of them."""
    stats = [
        F.struct(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var")) for v in SEQUENCE_VITALS
    ]
    return rows.groupBy("encounter_id").agg(F.count(F.lit(1)).alias("rows"), F.array(*stats).alias("stats"))


def _filled_spread(rows: Column, stats: Column) -> Column:
    """Standard deviation over all cells once each vital's gaps hold its mean (0 without values)."""
    means = F.transform(stats, lambda s: F.coalesce(s["mean"], F.lit(0.0)))
    middle = arrays.total(means) / arrays.WIDTH
    between = arrays.total(F.transform(means, lambda m: (m - middle) * (m - middle))) * rows
    within = arrays.total(F.transform(stats, lambda s: F.coalesce(s["var"] * s["n"], F.lit(0.0))))
    return F.sqrt((between + within) / (rows * arrays.WIDTH))


def inference_sequences(resolved: DataFrame, policy: str = "api") -> DataFrame:
    """(encounter_id, source, n_rows, flat, steps): 48 x 6 arrays for scoring, zeros in front.

    ``api`` fills gaps with the encounter's mean of the vital and calls a sequence flat when its cells hardly
    vary before padding. ``offline`` fills with 0; its flatness is judged after scaling, see ``offline_flat``.
    """
    zero = arrays.constant_step(0.0)
    if policy == "offline":
        return gather(resolved, "step", "source").select("encounter_id", "source", "n_rows", F.lit(None).cast("boolean").alias("flat"),
                               arrays.pad_front(fill_zero(F.col("steps")), zero).alias("steps"))
    means = F.transform("stats", lambda s: F.coalesce(s["mean"], F.lit(0.0)))
    filled = arrays.map_cells(fill_column_mean(F.col("steps"), means), lambda v, i: finite_or(v))
    resolved = materialize(resolved, "resolved")  # read twice; the means are those of all rows, not of the last 48
    return gather(resolved, "step", "source").join(column_statistics(resolved), "encounter_id").select(
        "encounter_id", "source", "n_rows",
        (_filled_spread(F.col("rows"), F.col("stats")) < FLAT).alias("flat"),
        arrays.pad_front(filled, zero).alias("steps"),
    )


def offline_flat(steps: Column) -> Column:
    """Whether a padded and scaled sequence hardly varies or never rises above zero."""
    return arrays.bound(arrays.cells(steps), lambda values: (arrays.spread(values) < FLAT) | (F.array_max(values) < FLAT))


def fit_scaler(sequences: DataFrame) -> DataFrame:
    """One row per vital: position, name, population mean and standard deviation over all cells."""
    cells = sequences.select(F.explode("steps").alias("step")).select(
        *[F.col("step")[i].alias(v) for i, v in enumerate(SEQUENCE_VITALS)]
    )
    stats = cells.agg(*[
        F.struct(F.lit(i).alias("position"), F.lit(v).alias("vital"), F.avg(v).alias("mean"),
                 F.stddev_pop(v).alias("std")).alias(v)
        for i, v in enumerate(SEQUENCE_VITALS)
    ])
    return stats.select(F.inline(F.array(*SEQUENCE_VITALS)))


def scale(sequences: DataFrame, scaler: DataFrame, epsilon: float | None = None) -> DataFrame:
    """Subtract each vital's mean and divide by its standard deviation.

    With ``epsilon`` the divisor is ``std + epsilon`` (the global z-score); without it a vital that does not
    vary is divided by 1.
    """
    stats = scaler.agg(F.sort_array(F.collect_list(F.struct("position", "mean", "std")))).scalar()  # six rows

    def scaled(value: Column, i: int) -> Column:
        std = F.col("_stats")[i]["std"]
        divisor = std + F.lit(epsilon) if epsilon is not None else F.when(std == 0, 1.0).otherwise(std)
        return (value - F.col("_stats")[i]["mean"]) / divisor

    attached = sequences.withColumn("_stats", stats)  # a subquery may not stand inside the array function
    return attached.withColumn("steps", arrays.map_cells(F.col("steps"), scaled)).drop("_stats")
