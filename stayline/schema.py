"""Table schemas, item dictionaries and model column lists."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _I, _S, _D = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()
_NTZ, _DATE = T.TimestampNTZType(), T.DateType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# ---------------------------------------------------------------------------------------------
# Tables, item codes, column lists, thresholds and weights that results depend on.
# ---------------------------------------------------------------------------------------------

TABLES: dict[str, T.StructType] = {
    "patient": _table(patient_id=_L, gender=_S, anchor_age=_I, anchor_year=_I, dod=_DATE),
    "encounter": _table(
        encounter_id=_L, patient_id=_L, admit_time=_NTZ, discharge_time=_NTZ, admission_type=_S,
        admission_location=_S, discharge_location=_S, insurance=_S, marital_status=_S, race=_S,
        hospital_expire_flag=_I,
    ),
    "icu_stay": _table(
        icu_stay_id=_L, encounter_id=_L, patient_id=_L, first_careunit=_S, last_careunit=_S,
        icu_intime=_NTZ, icu_outtime=_NTZ, los_hours=_D,
    ),
    "diagnosis": _table(encounter_id=_L, icd_code=_S, icd_version=_I, description=_S, seq_num=_I),
    "medication": _table(
        encounter_id=_L, drug_name=_S, drug_type=_S, route=_S, start_time=_NTZ, stop_time=_NTZ,
    ),
    "lab_result": _table(
        encounter_id=_L, patient_id=_L, lab_name=_S, itemid=_I, value=_S, valuenum=_D, valueuom=_S,
        flag=_S, chart_time=_NTZ,
    ),
    "vital_sign": _table(
        encounter_id=_L, icu_stay_id=_L, vital_type=_S, value=_D, unit=_S, recorded_at=_NTZ,
    ),
    "risk_prediction": _table(
        encounter_id=_L, xgb_score=_D, lstm_score=_D, cnn_score=_D, fusion_score=_D, risk_level=_S,
        model_version=_S, predicted_at=T.TimestampType(),
    ),
}

# chart item id -> (vital type, unit)
VITAL_ITEMS: dict[int, tuple[str, str]] = {
    220045: ("heart_rate", "bpm"),
    220179: ("bp_systolic", "mmHg"),
    220180: ("bp_diastolic", "mmHg"),
    223761: ("temperature_f", "F"),
    220210: ("respiratory_rate", "br/min"),
    220277: ("spo2", "%"),
    220739: ("gcs_eye", "points"),
    223900: ("gcs_verbal", "points"),
    223901: ("gcs_motor", "points"),
}

# lab item id -> lab name
LAB_ITEMS: dict[int, str] = {
    50912: "Creatinine",
    51006: "Blood Urea Nitrogen",
    51301: "White Blood Cells",
    51222: "Hemoglobin",
    50983: "Sodium",
    50971: "Potassium",
    50931: "Glucose",
    51003: "Troponin T",
    50813: "Lactate",
    50862: "Albumin",
    51265: "Platelet Count",
    50882: "Bicarbonate",
    50893: "Calcium Total",
    50902: "Chloride",
}

# the six vitals of a sequence, in model order, and the hours of one sequence
SEQUENCE_VITALS = [
    "heart_rate", "bp_systolic", "bp_diastolic", "temperature_f", "respiratory_rate", "spo2",
]
SEQUENCE_HOURS = 48

# the tabular model's features, in model order
MODEL_FEATURES = [
    "age_at_admission", "length_of_stay", "num_diagnoses", "num_medications", "avg_hr", "max_bp_sys",
    "avg_temp", "max_creatinine", "max_wbc", "num_prior_admissions",
]

# features the scoring service reads; those of MODEL_FEATURES not listed are served as 0
SERVED_FEATURES = [
    "age_at_admission", "length_of_stay", "num_diagnoses", "num_medications", "max_creatinine",
    "max_wbc", "num_prior_admissions",
]

# share of rows up to which a row is training, validation; the rest is test
SPLIT_SHARES = (0.70, 0.85)

READMISSION_WINDOW_DAYS = 30
MODEL_VERSION = "v2_mimic"

# markers a CSV reader of data frames takes for a missing value
MISSING_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# declared text lengths, for the constraint audit
TEXT_LIMITS: dict[str, dict[str, int]] = {
    "patient": {"gender": 1},
    "encounter": {
        "admission_type": 100, "admission_location": 100, "discharge_location": 100,
        "insurance": 50, "marital_status": 50, "race": 100,
    },
    "icu_stay": {"first_careunit": 50, "last_careunit": 50},
    "diagnosis": {"icd_code": 20},
    "medication": {"drug_type": 50, "route": 50},
    "lab_result": {"lab_name": 100, "valueuom": 20, "flag": 20},
    "vital_sign": {"vital_type": 50, "unit": 20},
}
PRIMARY_KEYS = {"patient": "patient_id", "encounter": "encounter_id", "icu_stay": "icu_stay_id"}
FOREIGN_KEYS = [
    ("encounter", "patient_id", "patient"),
    ("icu_stay", "encounter_id", "encounter"),
    ("icu_stay", "patient_id", "patient"),
    ("diagnosis", "encounter_id", "encounter"),
    ("medication", "encounter_id", "encounter"),
]
