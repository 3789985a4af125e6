"""Clinical tables derived from the star-schema test tables, so that every operator has real input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.operators.loading import describe_diagnoses

_CLOCK = "yyyy-MM-dd HH:mm:ss"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- typed tables ----------------------------------------------------------------------------


def patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS patient_id",
        "CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender",
        "CAST(20 + c_custkey % 70 AS INT) AS anchor_age",
        "1995 AS anchor_year",
        "CASE WHEN c_custkey % 17 = 0 THEN DATE '2002-01-01' END AS dod",
    )


def encounter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS encounter_id",
        "o_custkey AS patient_id",
        "o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 AS INT) AS admit_time",
        "CASE WHEN o_orderkey % 97 <> 0 THEN o_orderdate + INTERVAL '1' HOUR * "
        "CAST(o_orderkey % 24 + 1 + o_orderkey % 400 AS INT) END AS discharge_time",
        "o_orderpriority AS admission_type",
        "CASE o_orderkey % 3 WHEN 0 THEN 'EMERGENCY ROOM' WHEN 1 THEN 'CLINIC REFERRAL' "
        "ELSE 'TRANSFER' END AS admission_location",
        "o_orderstatus AS discharge_location",
        "CASE o_orderkey % 4 WHEN 0 THEN 'Medicare' WHEN 1 THEN 'Medicaid' WHEN 2 THEN 'Private' END AS insurance",
        "CASE o_orderkey % 3 WHEN 0 THEN 'SINGLE' WHEN 1 THEN 'MARRIED' ELSE 'WIDOWED' END AS marital_status",
        "CONCAT('GROUP-', CAST(o_orderkey % 7 AS STRING)) AS race",
        "CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS hospital_expire_flag",
    )


def icu_stay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth user has no stay, which leaves encounters for the hourly fallback."""
    users = _read(spark, sf_dir, "events").where("user_id % 5 <> 0").select("user_id").distinct()
    return users.selectExpr(
        "300000 + user_id AS icu_stay_id",
        "user_id AS encounter_id",
        "user_id * 7 % 2000 AS patient_id",
        "CASE WHEN user_id % 2 = 0 THEN 'MICU' ELSE 'SICU' END AS first_careunit",
        "CASE WHEN user_id % 3 = 0 THEN 'MICU' ELSE 'SICU' END AS last_careunit",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(user_id % 24 AS INT) AS icu_intime",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(user_id % 24 + user_id % 90 AS INT) "
        "AS icu_outtime",
        "CAST(user_id % 90 AS DOUBLE) / 24 AS los_hours",
    )


def _vital_case(column: str) -> str:
    return (
        f"CASE {column} % 10 WHEN 0 THEN 'heart_rate' WHEN 1 THEN 'bp_systolic' WHEN 2 THEN 'bp_diastolic' "
        "WHEN 3 THEN 'temperature_f' WHEN 4 THEN 'respiratory_rate' WHEN 5 THEN 'spo2' "
        "WHEN 6 THEN 'gcs_eye' WHEN 7 THEN 'gcs_verbal' ELSE 'gcs_motor' END"
    )


def vitals_of(events: DataFrame) -> DataFrame:
    """Vital signs from events; stateless, so also for a stream."""
    return events.where("event_id % 10 <> 9").selectExpr(
        "user_id AS encounter_id",
        "300000 + user_id AS icu_stay_id",
        f"{_vital_case('event_id')} AS vital_type",
        "value",
        "CASE event_id % 10 WHEN 0 THEN 'bpm' WHEN 1 THEN 'mmHg' WHEN 2 THEN 'mmHg' WHEN 3 THEN 'F' "
        "WHEN 4 THEN 'br/min' WHEN 5 THEN '%' ELSE 'points' END AS unit",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST(event_id * 37 % 4320 AS INT) AS recorded_at",
    )


def vital_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings over 72 hours, some before the ICU stay and some after its first 48 hours."""
    return vitals_of(_read(spark, sf_dir, "events"))


def lab_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").where("l_partkey % 15 <> 14").selectExpr(
        "l_orderkey AS encounter_id",
        "l_suppkey AS patient_id",
        "CASE l_partkey % 15 WHEN 0 THEN 'Creatinine' WHEN 1 THEN 'Blood Urea Nitrogen' "
        "WHEN 2 THEN 'White Blood Cells' WHEN 3 THEN 'Hemoglobin' ELSE 'Sodium' END AS lab_name",
        "CAST(l_partkey % 15 AS INT) AS itemid",
        "CAST(l_quantity AS STRING) AS value",
        "CASE WHEN l_partkey % 23 <> 0 THEN l_quantity END AS valuenum",
        "CASE WHEN l_partkey % 2 = 0 THEN 'mg/dL' ELSE 'K/uL' END AS valueuom",
        "CASE WHEN l_returnflag = 'R' THEN 'abnormal' END AS flag",
        "l_shipdate AS chart_time",
    )


def icd_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the codes in use is missing."""
    return _read(spark, sf_dir, "part").where("p_partkey % 10 <> 0").selectExpr(
        "CAST(p_partkey AS STRING) AS icd_code", "CAST(9 + p_partkey % 2 AS INT) AS icd_version",
        "p_name AS description",
    )


def coded_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS encounter_id", "CAST(l_partkey AS STRING) AS icd_code",
        "CAST(9 + l_partkey % 2 AS INT) AS icd_version", "l_linenumber AS seq_num",
    )


def medication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS encounter_id",
        "CASE WHEN l_partkey % 41 = 0 THEN 'Unknown' ELSE CONCAT('drug-', CAST(l_partkey % 40 AS STRING)) END "
        "AS drug_name",
        "l_returnflag AS drug_type",
        "l_linestatus AS route",
        "l_shipdate AS start_time",
        "l_shipdate + INTERVAL '1' DAY * l_linenumber AS stop_time",
    )


def score_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model scores in all patterns of missing values, and image paths."""
    return _read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS encounter_id",
        "CAST(o_orderkey * 37 % 1001 AS DOUBLE) / 1000 AS xgb_score",
        "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey * 53 % 1001 AS DOUBLE) / 1000 END AS lstm_score",
        "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey * 71 % 1001 AS DOUBLE) / 1000 END AS cnn_score",
        "CASE WHEN o_orderkey % 3 = 0 THEN CONCAT(CASE o_orderkey % 4 WHEN 0 THEN 'scan/PNEUMONIA_' "
        "WHEN 1 THEN 'scan/normal_' WHEN 2 THEN 'scan/Virus_normal_' ELSE 'scan/other_' END, "
        "CAST(o_orderkey AS STRING), '.png') END AS image_path",
    )


def risk_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction log with several predictions per encounter."""
    score = "CAST(l_partkey * 37 % 1001 AS DOUBLE) / 1000"
    return _read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS encounter_id",
        "CAST(l_suppkey * 53 % 1001 AS DOUBLE) / 1000 AS xgb_score",
        f"{score} AS fusion_score",
        f"CASE WHEN {score} < 0.50 THEN 'LOW' WHEN {score} < 0.54 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level",
        "'v2_mimic' AS model_version",
        "l_shipdate + INTERVAL '1' MINUTE * l_linenumber AS predicted_at",
    )


def embedding_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").selectExpr(
        "CAST(vec_id AS STRING) AS encounter_id",
        "CASE WHEN label % 2 = 0 THEN 'cnn' ELSE 'bert' END AS embedding_type", "embedding AS vector",
    )


def note_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS postgres_encounter_id", "source AS note_type", "text",
    )


def image_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels in the shape of Spark's image source: document bytes as one channel, bright ones, four channels with a dark alpha,
    and some that can't be decoded."""
    return _read(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "named_struct('nChannels', CASE WHEN doc_id % 11 = 0 THEN -1 WHEN doc_id % 5 = 1 THEN 4 ELSE 1 END, 'data', "
        "CAST(CASE doc_id % 5 WHEN 1 THEN repeat('zzz!', length(text)) WHEN 2 THEN repeat('\u00ff', length(text)) ELSE text END "
        "AS BINARY)) AS image",
    )


# --- raw extracts: text columns with missing markers and values that do not parse -------------


def raw_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encounter(spark, sf_dir).selectExpr(
        "CAST(patient_id AS STRING) AS subject_id",
        "CAST(encounter_id AS STRING) AS hadm_id",
        f"CASE WHEN encounter_id % 211 = 0 THEN 'unknown' ELSE date_format(admit_time, '{_CLOCK}') END AS admittime",
        f"COALESCE(date_format(discharge_time, '{_CLOCK}'), 'NA') AS dischtime",
        "CASE WHEN encounter_id % 301 = 0 THEN 'NULL' ELSE admission_type END AS admission_type",
        "admission_location", "discharge_location", "COALESCE(insurance, 'None') AS insurance", "marital_status",
        "race", "CAST(hospital_expire_flag AS STRING) AS hospital_expire_flag",
    )


def raw_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patient(spark, sf_dir).selectExpr(
        "CAST(patient_id AS STRING) AS subject_id", "gender", "CAST(anchor_age AS STRING) AS anchor_age",
        "CAST(anchor_year AS STRING) AS anchor_year", "COALESCE(CAST(dod AS STRING), 'nan') AS dod",
    )


def raw_icustays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icu_stay(spark, sf_dir).selectExpr(
        "CAST(patient_id AS STRING) AS subject_id", "CAST(encounter_id AS STRING) AS hadm_id",
        "CAST(icu_stay_id AS STRING) AS stay_id", "first_careunit", "last_careunit",
        f"date_format(icu_intime, '{_CLOCK}') AS intime",
        f"CASE WHEN encounter_id % 13 = 0 THEN 'later' ELSE date_format(icu_outtime, '{_CLOCK}') END AS outtime",
        "CAST(los_hours AS STRING) AS los",
    )


def raw_diagnoses_icd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_diagnosis(spark, sf_dir).selectExpr(
        "CAST(encounter_id AS STRING) AS hadm_id", "icd_code", "CAST(icd_version AS STRING) AS icd_version",
        "CAST(seq_num AS STRING) AS seq_num",
    )


def raw_d_icd_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icd_dictionary(spark, sf_dir).selectExpr(
        "icd_code", "CAST(icd_version AS STRING) AS icd_version", "description AS long_title"
    )


def raw_prescriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr(
        "CASE WHEN l_partkey % 31 = 0 THEN 'NaN' ELSE CONCAT(CAST(l_orderkey AS STRING), '.0') END AS hadm_id",
        "CASE WHEN l_partkey % 41 = 0 THEN '' ELSE CONCAT('drug-', CAST(l_partkey % 40 AS STRING)) END AS drug",
        "l_returnflag AS drug_type", "l_linestatus AS route",
        f"date_format(l_shipdate, '{_CLOCK}') AS starttime",
        f"CASE WHEN l_linenumber = 3 THEN '??' ELSE date_format(l_shipdate + INTERVAL '1' DAY * l_linenumber, "
        f"'{_CLOCK}') END AS stoptime",
    )


def chartevents_of(events: DataFrame) -> DataFrame:
    """Chart events from events; stateless, so also for a stream."""
    return events.selectExpr(
        "CASE WHEN event_id % 101 = 0 THEN 'NA' ELSE CAST(user_id AS STRING) END AS hadm_id",
        "CAST(300000 + user_id AS STRING) AS stay_id",
        "CAST(CASE event_id % 10 WHEN 0 THEN 220045 WHEN 1 THEN 220179 WHEN 2 THEN 220180 WHEN 3 THEN 223761 "
        "WHEN 4 THEN 220210 WHEN 5 THEN 220277 WHEN 6 THEN 220739 WHEN 7 THEN 223900 WHEN 8 THEN 223901 "
        "ELSE 999999 END AS STRING) AS itemid",
        "CASE WHEN event_id % 107 = 0 THEN 'soon' ELSE date_format(TIMESTAMP_NTZ '2024-01-01 00:00:00' + "
        f"INTERVAL '1' MINUTE * CAST(event_id * 37 % 4320 AS INT), '{_CLOCK}') END AS charttime",
        "CASE WHEN event_id % 103 = 0 THEN 'high' ELSE CAST(value AS STRING) END AS valuenum",
    )


def raw_chartevents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chartevents_of(_read(spark, sf_dir, "events"))


def raw_labevents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_suppkey AS STRING) AS subject_id",
        "CASE WHEN l_partkey % 29 = 0 THEN 'NA' ELSE CAST(l_orderkey AS STRING) END AS hadm_id",
        "CAST(CASE l_partkey % 15 WHEN 0 THEN 50912 WHEN 1 THEN 51006 WHEN 2 THEN 51301 WHEN 3 THEN 51222 "
        "WHEN 4 THEN 50983 WHEN 5 THEN 50971 WHEN 6 THEN 50931 WHEN 7 THEN 51003 WHEN 8 THEN 50813 "
        "WHEN 9 THEN 50862 WHEN 10 THEN 51265 WHEN 11 THEN 50882 WHEN 12 THEN 50893 WHEN 13 THEN 50902 "
        "ELSE 99999 END AS STRING) AS itemid",
        f"date_format(l_shipdate, '{_CLOCK}') AS charttime",
        "CAST(l_quantity AS STRING) AS value",
        "CASE WHEN l_partkey % 23 = 0 THEN '___' ELSE CAST(l_quantity AS STRING) END AS valuenum",
        "'mg/dL' AS valueuom",
        "CASE WHEN l_returnflag = 'R' THEN 'abnormal' ELSE '' END AS flag",
    )


RAW = {
    "admissions": raw_admissions,
    "patients": raw_patients,
    "icustays": raw_icustays,
    "diagnoses_icd": raw_diagnoses_icd,
    "d_icd_diagnoses": raw_d_icd_diagnoses,
    "prescriptions": raw_prescriptions,
    "chartevents": raw_chartevents,
    "labevents": raw_labevents,
}


def raw_extracts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: make(spark, sf_dir) for name, make in RAW.items()}


def diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_diagnoses(coded_diagnosis(spark, sf_dir), icd_dictionary(spark, sf_dir))


TYPED = {
    "patient": patient,
    "encounter": encounter,
    "icu_stay": icu_stay,
    "diagnosis": diagnosis,
    "medication": medication,
    "lab_result": lab_result,
    "vital_sign": vital_sign,
}


def typed_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: make(spark, sf_dir) for name, make in TYPED.items()}


def audited_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The typed tables with violations of every kind of constraint."""
    tables = typed_tables(spark, sf_dir)
    people = tables["patient"].where("patient_id % 37 <> 0")
    nameless = people.where("patient_id % 50 = 2").selectExpr(
        "CAST(NULL AS BIGINT) AS patient_id", "'MALE' AS gender", "anchor_age", "anchor_year", "dod")
    stays = tables["encounter"].where("encounter_id % 41 <> 0").withColumns({
        "race": F.expr("CASE WHEN encounter_id % 29 = 0 THEN repeat(race, 20) ELSE race END")})
    return tables | {
        "patient": people.unionByName(people.where("patient_id % 100 = 1")).unionByName(nameless),
        "encounter": stays.unionByName(stays.where("encounter_id % 300 = 5")),
        "icu_stay": tables["icu_stay"].withColumn("encounter_id", F.expr("CASE WHEN encounter_id % 17 <> 0 THEN encounter_id END")),
        "medication": tables["medication"].withColumn(
            "route", F.expr("CASE WHEN encounter_id % 31 = 0 THEN repeat(route, 60) ELSE route END")),
    }
