"""Report queries over whole tables. Point lookups become optional key filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from stayline.functions.scores import band_label, percent
from stayline.functions.temporal import stay_days
from stayline.operators.cohort import random_encounters


def only(df: DataFrame, key: str, keys: int | Iterable[int] | DataFrame | None) -> DataFrame:
    """Rows with the given keys: one, a short list, or a DataFrame with the key column."""
    if keys is None:
        return df
    if isinstance(keys, DataFrame):
        return df.join(keys.select(key), key, "left_semi")
    return df.where(F.col(key).isin(keys if isinstance(keys, int) else list(keys)))


def lookup(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Every wanted key with its row and ``found``; an absent key is reported, not dropped."""
    return wanted.select(key).join(table.withColumn("found", F.lit(True)), key, "left").fillna(False, ["found"])


def los_days() -> Column:
    return stay_days(F.col("admit_time"), F.col("discharge_time")).alias("los_days")


def encounters_per_patient(encounters: DataFrame) -> DataFrame:
    return encounters.groupBy("patient_id").agg(F.count("encounter_id").alias("total_encounters"))


def list_patients(patients: DataFrame, encounters: DataFrame) -> DataFrame:
    """Patients with their number of encounters, 0 when they have none."""
    counts = encounters_per_patient(encounters)
    return patients.join(counts, "patient_id", "left").fillna(0, ["total_encounters"])


def top_patients(patients: DataFrame, encounters: DataFrame, limit: int = 50) -> DataFrame:
    """The patients with most encounters, most first; ties by patient id."""
    ranked = list_patients(patients, encounters).orderBy(F.col("total_encounters").desc(), "patient_id")
    return ranked.limit(limit)


def patient_encounters(encounters: DataFrame, patient_ids=None) -> DataFrame:
    """Encounters per patient, newest first, with their length in days."""
    return (
        only(encounters, "patient_id", patient_ids)
        .select("patient_id", "encounter_id", "admit_time", "discharge_time", "admission_type",
                "discharge_location", "hospital_expire_flag", los_days())
        .orderBy("patient_id", F.col("admit_time").desc_nulls_first(), "encounter_id")
    )


def encounter_listing(encounters: DataFrame) -> DataFrame:
    """Discharged encounters with dates and length in days."""
    return encounters.where(F.col("discharge_time").isNotNull()).select(
        "encounter_id", "patient_id", F.to_date("admit_time").alias("admit_date"),
        F.to_date("discharge_time").alias("discharge_date"), "admission_type", "discharge_location", los_days(),
    )


def random_listing(encounters: DataFrame, limit: int = 30, seed: int = 42) -> DataFrame:
    return encounter_listing(random_encounters(encounters, limit, seed))


def encounter_detail(encounters: DataFrame, patients: DataFrame, encounter_ids=None) -> DataFrame:
    """Encounters with their patient's gender and anchor age."""
    people = patients.select("patient_id", "gender", "anchor_age")
    return only(encounters, "encounter_id", encounter_ids).join(people, "patient_id").select(
        *encounters.columns, "gender", "anchor_age", los_days()
    )


def diagnoses_in_order(diagnoses: DataFrame, encounter_ids=None) -> DataFrame:
    return (
        only(diagnoses, "encounter_id", encounter_ids)
        .select("encounter_id", "icd_code", "icd_version", "description", "seq_num")
        .orderBy("encounter_id", F.col("seq_num").asc_nulls_last())
    )


def vitals_in_order(vitals: DataFrame, encounter_ids=None) -> DataFrame:
    return (
        only(vitals, "encounter_id", encounter_ids)
        .select("encounter_id", "vital_type", "value", "unit", "recorded_at")
        .orderBy("encounter_id", F.col("recorded_at").asc_nulls_last())
    )


def distinct_medications(medications: DataFrame, encounter_ids=None) -> DataFrame:
    return (
        only(medications, "encounter_id", encounter_ids)
        .select("encounter_id", "drug_name", "drug_type", "route").distinct()
        .orderBy("encounter_id", F.col("drug_name").asc_nulls_last())
    )


def lab_summary(labs: DataFrame, encounter_ids=None) -> DataFrame:
    """Per encounter and lab: extremes, mean, unit, flag and number of numeric readings."""
    return (
        only(labs, "encounter_id", encounter_ids)
        .where(F.col("valuenum").isNotNull())
        .groupBy("encounter_id", "lab_name")
        .agg(
            F.max("valuenum").alias("max_value"),
            F.min("valuenum").alias("min_value"),
            F.avg("valuenum").alias("avg_value"),
            F.max("valueuom").alias("unit"),
            F.max("flag").alias("flag"),
            F.count(F.lit(1)).alias("num_readings"),
        )
    )


def abnormal_labs(labs: DataFrame, encounter_ids=None) -> DataFrame:
    """Results flagged abnormal, newest first within an encounter."""
    return (
        only(labs, "encounter_id", encounter_ids)
        .where(F.col("flag") == "abnormal")
        .select("encounter_id", "lab_name", "valuenum", "valueuom", "flag", "chart_time")
        .orderBy("encounter_id", F.col("chart_time").desc_nulls_first())
    )


def admission_type_counts(encounters: DataFrame) -> DataFrame:
    """Encounters per admission type; those without a type are not counted."""
    return encounters.where(F.col("admission_type").isNotNull()).groupBy("admission_type").agg(
        F.count(F.lit(1)).alias("n")
    )


def readmission_check(labels: DataFrame) -> DataFrame:
    """One row: labels, readmissions, rate in percent, first and last admission date."""
    return labels.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("readmitted_30d").alias("readmitted"),
        F.round(F.avg("readmitted_30d") * 100, 2).alias("rate_pct"),
        F.min("admit_date").alias("first_date"),
        F.max("admit_date").alias("last_date"),
    )


def readmission_by_type(encounters: DataFrame, labels: DataFrame) -> DataFrame:
    """Readmission rate per admission type."""
    kinds = encounters.select("encounter_id", "admission_type")
    return kinds.join(labels.select("encounter_id", "readmitted_30d"), "encounter_id").groupBy("admission_type").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("readmitted_30d").alias("readmitted"),
        F.round(F.avg("readmitted_30d") * 100, 2).alias("rate_pct"),
    )


def sequence_check(sequences: DataFrame) -> DataFrame:
    """One row: sequence rows, encounters and the readmission rate over encounters."""
    per_encounter = sequences.groupBy("encounter_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("readmitted_30d", "hour_offset").alias("label")
    )
    return per_encounter.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("encounters"),
        F.avg("label").alias("readmission_rate"),
    )


def prediction_history(log: DataFrame, encounter_ids=None) -> DataFrame:
    """Logged predictions, newest first within an encounter."""
    return only(log, "encounter_id", encounter_ids).orderBy(
        "encounter_id", F.col("predicted_at").desc_nulls_first()
    )


def latest_predictions(log: DataFrame) -> DataFrame:
    """Each encounter's newest prediction; ties go to the higher fusion score, then to the higher other columns."""
    first = ["encounter_id", "predicted_at", "fusion_score"]
    rest = [c for c in log.columns if c not in first and not isinstance(log.schema[c].dataType, MapType)]
    newest = Window.partitionBy("encounter_id").orderBy(
        F.col("predicted_at").desc_nulls_first(), *[F.col(c).desc_nulls_last() for c in ("fusion_score", *rest)]
    )
    return log.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") == 1).drop("_rank")


def prediction_summary(log: DataFrame) -> DataFrame:
    """One row; over an empty log the count is 0 and everything else NULL."""
    def in_band(band: str) -> Column:
        return F.sum(F.when(F.col("risk_level") == band, 1).otherwise(0))

    return log.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.avg("fusion_score").alias("avg_risk_score"),
        in_band("HIGH").alias("high_risk_count"),
        in_band("MEDIUM").alias("medium_risk_count"),
        in_band("LOW").alias("low_risk_count"),
    )


def display_scores(predictions: DataFrame) -> DataFrame:
    """Scores as whole percentages, the weights above 0 as percentages, and the band's label."""
    scores = [percent(F.col(c)).alias(c.replace("_score", "_pct"))
              for c in ("xgb_score", "lstm_score", "cnn_score", "fusion_score")]
    used = F.map_filter("weights_used", lambda name, weight: weight > 0)
    return predictions.select(
        "encounter_id", *scores, F.transform_values(used, lambda name, weight: percent(weight)).alias("weights_pct"),
        band_label(F.col("risk_level")).alias("risk_label"),
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, n) for every table."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n") for name, df in tables.items()]
    result = counts[0]
    for count in counts[1:]:
        result = result.unionByName(count)
    return result
