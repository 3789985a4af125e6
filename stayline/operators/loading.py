"""Raw extracts to typed tables. Each loader works on any DataFrame with the extract's columns.

``kept`` is the sampled cohort (encounter_id, patient_id); None keeps everything. Membership is a semi join,
so no set of ids ever exists outside a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.parsing import PARSERS, select_present
from stayline.schema import LAB_ITEMS, TABLES, VITAL_ITEMS

# Raw column name -> table column name.
RENAMES: dict[str, dict[str, str]] = {
    "patient": {"subject_id": "patient_id"},
    "encounter": {
        "subject_id": "patient_id", "hadm_id": "encounter_id", "admittime": "admit_time",
        "dischtime": "discharge_time",
    },
    "icu_stay": {
        "subject_id": "patient_id", "hadm_id": "encounter_id", "stay_id": "icu_stay_id",
        "intime": "icu_intime", "outtime": "icu_outtime", "los": "los_hours",
    },
    "diagnosis": {"hadm_id": "encounter_id"},
    "medication": {"hadm_id": "encounter_id", "drug": "drug_name", "starttime": "start_time", "stoptime": "stop_time"},
    "vital_sign": {"hadm_id": "encounter_id", "stay_id": "icu_stay_id", "valuenum": "value", "charttime": "recorded_at"},
    "lab_result": {"subject_id": "patient_id", "hadm_id": "encounter_id", "charttime": "chart_time"},
}

def typed(raw: DataFrame, table: str) -> DataFrame:
    """The table's columns that the extract has, renamed and parsed to the table's types."""
    names = {table_name: raw_name for raw_name, table_name in RENAMES[table].items()}
    return raw.selectExpr(*[
        f"{PARSERS[field.dataType.simpleString()](names.get(field.name, field.name))} AS {field.name}"
        for field in TABLES[table] if names.get(field.name, field.name) in raw.columns
    ])


def members(df: DataFrame, kept: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key is in the cohort."""
    return df if kept is None else df.join(kept.select(key), key, "left_semi").select(*df.columns)


def load_admissions(raw: DataFrame) -> DataFrame:
    """Encounters with both times known."""
    return typed(raw, "encounter").dropna(subset=["admit_time", "discharge_time"])


def load_patients(raw: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    return members(typed(raw, "patient"), kept, "patient_id")


def load_icu_stays(raw: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """``los`` keeps its value under the name ``los_hours``; the source counts it in days."""
    return members(typed(raw, "icu_stay"), kept, "encounter_id")


def describe_diagnoses(diagnoses: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Attach descriptions by (code, version); codes the dictionary lacks are ``Unknown``."""
    texts = dictionary.select("icd_code", "icd_version", "description")
    return diagnoses.join(texts, ["icd_code", "icd_version"], "left").fillna("Unknown", ["description"])


def load_diagnoses(raw: DataFrame, dictionary: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    texts = typed(dictionary.withColumnRenamed("long_title", "description"), "diagnosis")
    rows = members(typed(raw, "diagnosis"), kept, "encounter_id")
    return select_present(describe_diagnoses(rows, texts), TABLES["diagnosis"].names)


def load_medications(raw: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    rows = typed(raw, "medication").dropna(subset=["encounter_id"])
    return members(rows, kept, "encounter_id").fillna("Unknown", ["drug_name"])


def with_vital_items(df: DataFrame, itemid: str = "itemid") -> DataFrame:
    """Keep the known vital items and add ``vital_type`` and ``unit``. Stateless, so it also runs on a stream."""
    code = F.trim(F.col(itemid).cast("string"))
    types = _dictionary({item: kind for item, (kind, _) in VITAL_ITEMS.items()})
    units = _dictionary({item: unit for item, (_, unit) in VITAL_ITEMS.items()})
    known = df.where(code.isin([str(item) for item in VITAL_ITEMS]))
    return known.withColumns({"vital_type": types[code], "unit": units[code]})


def with_lab_items(df: DataFrame, itemid: str = "itemid") -> DataFrame:
    """Keep the known lab items and add ``lab_name``."""
    code = F.trim(F.col(itemid).cast("string"))
    known = df.where(code.isin([str(item) for item in LAB_ITEMS]))
    return known.withColumn("lab_name", _dictionary(LAB_ITEMS)[code])


def _dictionary(entries: dict[int, str]) -> Column:
    """A constant map from item code, as text; a lookup in it needs no join."""
    return F.create_map(*[F.lit(str(x)) for entry in entries.items() for x in entry])


def load_vitals(raw: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Known items first, on the raw text: the other columns are parsed only for the rows that stay."""
    known = typed(with_vital_items(raw), "vital_sign").dropna(subset=["value", "encounter_id"])
    return members(known, kept, "encounter_id")


def load_labs(raw: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    known = typed(with_lab_items(raw), "lab_result").dropna(subset=["encounter_id"])
    return members(known, kept, "encounter_id")
