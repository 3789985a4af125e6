"""The readmission label, prior admissions and reproducible samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.operators.ranking import RANGE_ROWS, in_ranges, running_totals
from stayline.session import materialize
from stayline.schema import READMISSION_WINDOW_DAYS

SEED = 42
UNKNOWN_PATIENT = -(2**63)


def patient_timeline(stays: DataFrame, rows_each: int = RANGE_ROWS) -> DataFrame:
    """``stays`` in order of patient, admit time (NULL last) and encounter id, cut into ranges (``_range``).

    ``_who`` is the patient, unknown ones being one key. Ranges hold about ``rows_each`` rows whatever the
    patient: one with many stays, many in the same hour or without a time is cut by encounter id.
    """
    keyed = stays.withColumns({
        "_who": F.coalesce("patient_id", F.lit(UNKNOWN_PATIENT)), "_late": F.col("admit_time").isNull()})
    return in_ranges(keyed, ["_who", "_late", "admit_time", "encounter_id"], rows_each)


def readmission_label(encounters: DataFrame, rows_each: int = RANGE_ROWS) -> DataFrame:
    """One row per discharged encounter with the 30-day readmission flag.

    The next admission is the patient's next discharged encounter by (admit time, encounter id), NULL times
    last. Flag 1 when it starts at most 30 days after this discharge, also when the stays overlap; 0 when it
    starts later or there is none.
    """
    stays = patient_timeline(encounters.where(F.col("discharge_time").isNotNull()).select(
        "encounter_id", "patient_id", "admit_time", "discharge_time"), rows_each)
    in_order = Window.partitionBy("_who", "_range").orderBy("_late", "admit_time", "encounter_id")
    linked = stays.select(
        "*",
        F.lead("admit_time").over(in_order).alias("_next"),
        F.lead(F.lit(True), 1, False).over(in_order).alias("_has_next"),
    )
    # a patient's last row of a range continues with their first row of the next one
    by_range = Window.partitionBy("_who").orderBy("_range")
    carried = (
        stays.groupBy("_who", "_range").agg(F.min("admit_time").alias("_first"))
        .select("_who", "_range", F.lead("_first").over(by_range).alias("_carried"))
    )
    joined = linked.join(carried, ["_who", "_range"])
    next_admit = F.when(F.col("_has_next"), F.col("_next")).otherwise(F.col("_carried"))
    window = F.make_dt_interval(days=F.lit(READMISSION_WINDOW_DAYS))
    return joined.select(
        "encounter_id",
        "patient_id",
        F.to_date("admit_time").alias("admit_date"),
        F.to_date("discharge_time").alias("discharge_date"),
        F.to_date(next_admit).alias("next_admit_date"),
        F.when(next_admit - F.col("discharge_time") <= window, 1).otherwise(0).alias("readmitted_30d"),
    )


def prior_admissions(encounters: DataFrame, rows_each: int = RANGE_ROWS) -> DataFrame:
    """Add ``num_prior_admissions``: the patient's strictly earlier admissions.

    Counts all encounters, discharged or not. No patient or no admit time gives 0. Equal times of a patient travel
    as one row with a count.
    """
    times = encounters.where(F.col("patient_id").isNotNull() & F.col("admit_time").isNotNull()).groupBy(
        "patient_id", "admit_time").agg(F.count(F.lit(1)).alias("n"))
    before = running_totals(times, "admit_time", ["n"], "patient_id", rows_each)
    return encounters.join(before.drop("n"), ["patient_id", "admit_time"], "left").select(
        *encounters.columns, F.coalesce("n_before", F.lit(0)).cast("bigint").alias("num_prior_admissions"))


def draw_order(key: Column, seed: int = SEED) -> Column:
    """A pseudo-random sort key that any engine with md5 can reproduce."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def stratified_sample(encounters: DataFrame, cap: int, seed: int = SEED,
                      stratum: str = "admission_type", key: str = "encounter_id") -> DataFrame:
    """About ``cap`` rows, drawn from every stratum in proportion to its size.

    A stratum of n of all N rows gets ``min(n, floor(cap * n / N) + 1)`` rows; strata are then filled in
    name order until ``cap`` rows are reached. Rows without a stratum count in N but are never drawn. The
    draw sorts by md5, cut first by its leading digits: whole prefixes are taken by comparison, and only the
    prefix in which the quota ends is ranked. The table of cuts, one row per stratum, is written out first: its
    size is then known, and Spark broadcasts it only if it is small.
    """
    drawn = encounters.withColumn("_draw", draw_order(F.col(key), seed)).withColumn(
        "_prefix", F.substring("_draw", 1, 4)
    )
    total = encounters.agg(F.count(F.lit(1)).alias("n")).scalar()
    histogram = drawn.where(F.col(stratum).isNotNull()).groupBy(stratum, "_prefix").agg(
        F.count(F.lit(1)).alias("n")
    )
    # a stratum's quota is at least 1, so only the first `cap` strata can be drawn from
    quotas = (
        histogram.groupBy(stratum).agg(F.sum("n").alias("n"))
        .withColumn("quota", F.least("n", F.floor(F.lit(float(cap)) * F.col("n") / total) + 1))
        .orderBy(stratum).limit(cap)
    )
    before = Window.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1)
    takes = quotas.select(
        stratum,
        F.least("quota", F.greatest(F.lit(cap) - F.coalesce(F.sum("quota").over(before), F.lit(0)), F.lit(0)))
        .alias("take"),
    )
    upto = Window.partitionBy(stratum).orderBy("_prefix")
    cuts = (
        histogram.withColumn("_end", F.sum("n").over(upto))
        .join(takes, stratum)
        .where((F.col("_end") - F.col("n") < F.col("take")) & (F.col("_end") >= F.col("take")))
        .select(stratum, F.col("_prefix").alias("_cut"), (F.col("take") - F.col("_end") + F.col("n")).alias("_left"))
    )
    in_prefix = Window.partitionBy(stratum).orderBy("_draw", key)
    joined = drawn.join(materialize(cuts, "strata"), stratum)
    whole = joined.where(F.col("_prefix") < F.col("_cut"))
    ended = joined.where(F.col("_prefix") == F.col("_cut")).withColumn("_rank", F.row_number().over(in_prefix))
    return whole.select(*encounters.columns).unionByName(
        ended.where(F.col("_rank") <= F.col("_left")).select(*encounters.columns))


def random_encounters(encounters: DataFrame, limit: int = 30, seed: int = SEED) -> DataFrame:
    """``limit`` discharged encounters in a seeded random order."""
    return (
        encounters.where(F.col("discharge_time").isNotNull())
        .orderBy(draw_order(F.col("encounter_id"), seed), "encounter_id")
        .limit(limit)
    )


def cap_rows(df: DataFrame, n: int, key: str, rows_each: int = RANGE_ROWS) -> DataFrame:
    """The rows of the first keys that hold ``n`` rows together, in ascending order of ``key``.

    Like a loader that checks its row cap after each chunk, the result keeps whole keys and may overshoot ``n``.
    ``df`` is read once for the rows per key and once for the result. Rows without a key come last.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(counts.where(F.col(key).isNotNull()), key, ["n"], rows_each=rows_each)
    cut = placed.where(F.col("n_before") < n).agg(
        F.max(key).alias("key"), F.max(F.col("n_before") + F.col("n")).alias("rows")).first()
    within = F.lit(False) if cut["key"] is None else F.col(key) <= cut["key"]
    return df.where(F.coalesce(within, F.lit((cut["rows"] or 0) < n)))
