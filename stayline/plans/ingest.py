"""The ingest job: raw extracts to typed tables, of all encounters or a sampled cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stayline.operators import loading
from stayline.operators.cohort import SEED, cap_rows, stratified_sample
from stayline.operators.reports import table_counts
from stayline.session import materialize
from stayline.sources.extracts import read_extracts
from stayline.sources.tables import read_tables, reload_tables


def build_tables(raw: dict[str, DataFrame], cap: int | None = None, seed: int = SEED,
                 max_vitals: int | None = None) -> dict[str, DataFrame]:
    """The seven tables; ``cap`` restricts them to a stratified sample of about so many encounters.

    Admissions are parsed and written out before they are sampled, as sampling reads them more than once. The
    sample is written out once and then semi-joined with every extract. Its size is known by then, so
    Spark broadcasts it when it is small and the event extracts are filtered without a shuffle. ``max_vitals``
    keeps whole encounters, in key order, until that many readings are reached.
    """
    encounters = loading.load_admissions(raw["admissions"])
    if cap is not None:
        encounters = stratified_sample(materialize(encounters, "admissions"), cap, seed)
    encounters = materialize(encounters, "cohort")
    vitals = loading.load_vitals(raw["chartevents"], encounters)
    if max_vitals is not None:
        vitals = cap_rows(vitals, max_vitals, "encounter_id")
    return {
        "patient": loading.load_patients(raw["patients"], encounters),
        "encounter": encounters,
        "icu_stay": loading.load_icu_stays(raw["icustays"], encounters),
        "diagnosis": loading.load_diagnoses(raw["diagnoses_icd"], raw["d_icd_diagnoses"], encounters),
        "medication": loading.load_medications(raw["prescriptions"], encounters),
        "vital_sign": vitals,
        "lab_result": loading.load_labs(raw["labevents"], encounters),
    }


def run_ingest(spark: SparkSession, raw_root: str, table_root: str, cap: int | None = None,
               seed: int = SEED, max_vitals: int | None = None, cluster: bool = True) -> DataFrame:
    """Load all extracts below ``raw_root`` into Parquet tables, clustered by encounter; returns the load summary."""
    tables = build_tables(read_extracts(spark, raw_root), cap, seed, max_vitals)
    reload_tables(tables, table_root, cluster)
    return table_counts(read_tables(spark, table_root, *tables))
