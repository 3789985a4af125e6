"""Per-encounter features and the training matrix."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.scores import zero_to_missing
from stayline.functions.temporal import age_at, male_flag, stay_days
from stayline.operators.cohort import prior_admissions
from stayline.operators.ranking import RANGE_ROWS, running_totals
from stayline.schema import MODEL_FEATURES

# half-width, as a share of the rows, of the bracket around a median, and the accuracy of the sketch that finds it
MEDIAN_BAND = 1e-3
SKETCH_ACCURACY = 10_000


def diagnosis_counts(diagnoses: DataFrame) -> DataFrame:
    return diagnoses.groupBy("encounter_id").agg(F.count(F.lit(1)).alias("num_diagnoses"))


def medication_counts(medications: DataFrame) -> DataFrame:
    """Distinct drug names per encounter; NULL names are not counted."""
    return medications.groupBy("encounter_id").agg(F.count_distinct("drug_name").alias("num_medications"))


def vital_features(vitals: DataFrame) -> DataFrame:
    """Mean heart rate, highest systolic pressure and mean temperature in one pass."""
    value, kind = F.col("value"), F.col("vital_type")
    return (
        vitals.where(kind.isin("heart_rate", "bp_systolic", "temperature_f"))
        .groupBy("encounter_id")
        .agg(
            F.avg(F.when(kind == "heart_rate", value)).alias("avg_hr"),
            F.max(F.when(kind == "bp_systolic", value)).alias("max_bp_sys"),
            F.avg(F.when(kind == "temperature_f", value)).alias("avg_temp"),
        )
    )


def lab_features(labs: DataFrame) -> DataFrame:
    """Highest creatinine and white blood cell values in one pass."""
    value, name = F.col("valuenum"), F.col("lab_name")
    return (
        labs.where(name.isin("Creatinine", "White Blood Cells"))
        .groupBy("encounter_id")
        .agg(
            F.max(F.when(name == "Creatinine", value)).alias("max_creatinine"),
            F.max(F.when(name == "White Blood Cells", value)).alias("max_wbc"),
        )
    )


def encounter_features(tables: dict[str, DataFrame]) -> DataFrame:
    """The feature table: one row per encounter with a patient, an admit and a discharge time.

    Every event table is reduced to one row per encounter before it is joined, on the key it was reduced by,
    so that the joins add no shuffle to that of the reductions. What an encounter has no events for is 0.
    """
    columns = ["encounter_id", "patient_id", "admit_time", "discharge_time"]
    stays = prior_admissions(tables["encounter"].select(*columns))
    joined = stays.where(F.col("admit_time").isNotNull() & F.col("discharge_time").isNotNull()).join(
        tables["patient"].select("patient_id", "gender", "anchor_age", "anchor_year"), "patient_id"
    )
    for reduced in (
        diagnosis_counts(tables["diagnosis"]),
        medication_counts(tables["medication"]),
        vital_features(tables["vital_sign"]),
        lab_features(tables["lab_result"]),
    ):
        joined = joined.join(reduced, "encounter_id", "left")

    def or_zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).alias(name)

    return joined.select(
        "encounter_id",
        "admit_time",
        F.to_date("admit_time").alias("admit_date"),
        age_at(F.col("admit_time"), F.col("anchor_age"), F.col("anchor_year")).alias("age_at_admission"),
        male_flag(F.col("gender")).alias("gender"),
        F.coalesce(stay_days(F.col("admit_time"), F.col("discharge_time")), F.lit(0.0)).alias("length_of_stay"),
        or_zero("num_diagnoses"),
        or_zero("num_medications"),
        or_zero("avg_hr"),
        or_zero("max_bp_sys"),
        or_zero("avg_temp"),
        or_zero("max_creatinine"),
        or_zero("max_wbc"),
        or_zero("num_prior_admissions"),
    )


def training_set(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features with their label, for stays longer than zero."""
    return features.where(F.col("length_of_stay") > 0).join(
        labels.select("encounter_id", F.col("readmitted_30d").alias("label")), "encounter_id"
    )


def exact_medians(df: DataFrame, columns: list[str] = MODEL_FEATURES, band: float = MEDIAN_BAND,
                  rows_each: int = RANGE_ROWS) -> DataFrame:
    """One row with the exact median of every column, interpolated as usual; NULL and NaN are ignored.

    A quantile sketch first brackets each median. Only values inside the bracket are
    then shuffled, counted per distinct value, and ranked behind the number of smaller values. Should a bracket
    miss the middle, which the sketch's error bound rules out, all values are ranked. ``df`` is read a few times,
    so it should be a table.
    """
    value = {c: F.col(c).cast("double") for c in columns}
    wide = df.select([F.when(~F.isnan(value[c]), value[c]).alias(c) for c in columns])
    brackets = _brackets(wide, columns, band)
    inside = F.lit(False)
    for c in columns:
        inside = inside | ((F.col("feature") == c) & F.col("value").between(brackets[c].low, brackets[c].high))
    counts = (
        wide.unpivot([], columns, "feature", "value").where(inside)
        .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    placed = running_totals(counts, "value", ["n"], "feature", rows_each)

    def middle(c: str) -> Column:
        low, high = (brackets[c].size - 1) // 2 - brackets[c].below, brackets[c].size // 2 - brackets[c].below
        parts = [
            F.when((F.col("n_before") <= p) & (p < F.col("n_before") + F.col("n")), F.col("value") / 2)
            for p in (low, high)
        ]
        return (F.sum(F.when(F.col("feature") == c, parts[0])) + F.sum(F.when(F.col("feature") == c, parts[1]))).alias(c)

    return placed.agg(*[middle(c) for c in columns])


class Bracket(NamedTuple):
    """Limits that enclose a column's median, the number of smaller values, and of all values."""

    low: float
    high: float
    below: int
    size: int


def _brackets(wide: DataFrame, columns: list[str], band: float) -> dict[str, Bracket]:
    everything = {c: (float("-inf"), float("inf")) for c in columns}
    probabilities = [0.5 - band, 0.5 + band]
    ends = wide.agg(*[F.percentile_approx(c, probabilities, SKETCH_ACCURACY).alias(c) for c in columns]).first()
    limits = {c: tuple(ends[c] or everything[c]) for c in columns}
    counted = wide.agg(*[
        F.struct(
            F.count(c).alias("size"),
            F.count_if(F.col(c) < limits[c][0]).alias("below"),
            F.count_if(F.col(c) <= limits[c][1]).alias("upto"),
        ).alias(c) for c in columns
    ]).first()
    found = {}
    for c in columns:
        size, below, upto = counted[c]
        holds = below <= (size - 1) // 2 and size // 2 < upto
        found[c] = Bracket(*limits[c], below, size) if holds else Bracket(*everything[c], 0, size)
    return found


def training_medians(train: DataFrame, columns: list[str] = MODEL_FEATURES) -> DataFrame:
    """Medians of the training rows with zeros taken as missing."""
    return exact_medians(train.select([zero_to_missing(F.col(c)).alias(c) for c in columns]), columns)


def fill_from(df: DataFrame, fills: DataFrame, columns: list[str] = MODEL_FEATURES,
              where: Column | None = None) -> DataFrame:
    """Zeros and NULLs of the columns replaced by the one row of ``fills``.

    Rows outside ``where`` keep zeros and get 0 for NULL. A column without any fill value stays as it is.
    """
    fill = fills.select(F.struct(*columns).alias("fill")).scalar()
    rows = F.lit(True) if where is None else where

    def filled(name: str) -> Column:
        plain = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        return F.when(rows, F.coalesce(zero_to_missing(F.col(name)), fill[name], plain)).otherwise(plain)

    return df.withColumns({c: filled(c) for c in columns})
