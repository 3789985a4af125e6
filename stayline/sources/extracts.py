"""Raw CSV extracts. Columns are read by header name, as text; typing is the loaders' work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stayline.sources.records import read_records

# The extracts of the source dataset and the columns in use.
EXTRACTS: dict[str, tuple[str, list[str]]] = {
    "admissions": ("hosp", [
        "subject_id", "hadm_id", "admittime", "dischtime", "admission_type", "admission_location",
        "discharge_location", "insurance", "marital_status", "race", "hospital_expire_flag",
    ]),
    "patients": ("hosp", ["subject_id", "gender", "anchor_age", "anchor_year", "dod"]),
    "icustays": ("icu", [
        "subject_id", "hadm_id", "stay_id", "first_careunit", "last_careunit", "intime", "outtime", "los",
    ]),
    "diagnoses_icd": ("hosp", ["hadm_id", "icd_code", "icd_version", "seq_num"]),
    "d_icd_diagnoses": ("hosp", ["icd_code", "icd_version", "long_title"]),
    "prescriptions": ("hosp", ["hadm_id", "drug", "drug_type", "route", "starttime", "stoptime"]),
    "chartevents": ("icu", ["hadm_id", "stay_id", "itemid", "charttime", "valuenum"]),
    "labevents": ("hosp", [
        "subject_id", "hadm_id", "itemid", "charttime", "value", "valuenum", "valueuom", "flag",
    ]),
}

#: Extracts of numbers only, whose records are single lines.
ONE_LINE = {"chartevents"}


def find_extract(spark: SparkSession, root: str, name: str) -> str:
    """Path of an extract: ``<root>/<folder>/<name>.csv.gz``, else ``.csv``; either a file or a folder.

    A single gzip file is read by one task. Deliver large extracts as a folder of part files.
    """
    folder = EXTRACTS[name][0]
    jvm = spark.sparkContext._jvm
    for suffix in (".csv.gz", ".csv"):
        path = f"{root.rstrip('/')}/{folder}/{name}{suffix}"
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        if hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path):
            return path
    raise FileNotFoundError(f"no {name}.csv.gz or {name}.csv in {root}/{folder}")


def read_extract(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The columns in use that the extract has, as text.

    Files of one extract may differ in column order and carry extra columns: columns are matched by name. Quoted values may
    hold line breaks, but for those in ``ONE_LINE``. Files are read in splits, unless compressed with gzip.
    """
    return read_records(spark, find_extract(spark, root, name), EXTRACTS[name][1], name in ONE_LINE)


def read_extracts(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: read_extract(spark, root, name) for name in EXTRACTS}


def write_extract(df: DataFrame, root: str, name: str, compressed: bool = True) -> str:
    """Write an extract as a folder of part files, for exports and tests."""
    suffix, codec = (".csv.gz", "gzip") if compressed else (".csv", "none")
    path = f"{root.rstrip('/')}/{EXTRACTS[name][0]}/{name}{suffix}"
    df.write.csv(path, header=True, compression=codec, escape='"', emptyValue="")
    return path
