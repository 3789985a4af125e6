"""The scoring job: bundles loaded, wanted encounters scored and fused, the log appended, records returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.operators import metrics, modelling, scoring
from stayline.operators.fusion import prediction_record
from stayline.plans.training import Trained
from stayline.schema import MODEL_VERSION
from stayline.session import materialize, remove
from stayline.sources.bundles import exists, load_bundle
from stayline.sources.tables import append_predictions, read_table, reload_partitions, table_path

MARKS = "_scored_to"


def record_scores(fused: DataFrame, table_root: str, version: str = MODEL_VERSION) -> DataFrame:
    """Append what could be scored to the prediction log; returns a record per scored encounter.

    The scores are written out first, so the log and the records agree.
    """
    rows = materialize(scoring.scored_only(fused), "fused-scores")
    append_predictions(rows, table_root, version)
    return prediction_record(rows, version=version)


def run_scoring(spark: SparkSession, wanted: DataFrame, tables: dict[str, DataFrame], table_root: str,
                tabular_path: str, sequence_path: str, images: DataFrame | None = None, policy: str = "api",
                cnn_available: bool = False, version: str = MODEL_VERSION) -> DataFrame:
    """Score the encounters of ``wanted`` with the saved bundles; a missing bundle is a model that isn't available.

    ``tables`` has ``features``, ``sequences`` and ``vital_sign``.
    """
    fused = scoring.score_batch(
        wanted, tables["features"], tables["sequences"], tables["vital_sign"], load_bundle(spark, tabular_path),
        load_bundle(spark, sequence_path), images=images, policy=policy, cnn_available=cnn_available)
    return record_scores(fused, table_root, version)


def run_incremental(spark: SparkSession, encounters: DataFrame, tables: dict[str, DataFrame], table_root: str,
                    tabular_path: str, sequence_path: str, lateness: str = scoring.LATENESS, version: str = MODEL_VERSION,
                    **how) -> DataFrame:
    """``run_scoring`` for the encounters (encounter_id, admit_time) that this model version hasn't scored yet.

    A mark per version holds the time up to which encounters were looked at; it is written last. If a run ends between the log
    and the mark, the next one looks again at what the log has already, and appends none of it twice. Encounters that can't
    be scored stay out of the log and are tried again while ``lateness`` lasts.
    """
    log = read_log(spark, table_root, version)
    fresh = materialize(scoring.unscored(encounters, log, read_mark(spark, table_root, version), lateness).select(
        "encounter_id", "admit_time"), "unscored")
    records = run_scoring(spark, fresh.select("encounter_id").distinct(), tables, table_root, tabular_path, sequence_path,
                          version=version, **how)
    write_mark(fresh, table_root, version)
    return records


def read_log(spark: SparkSession, table_root: str, version: str) -> DataFrame | None:
    """The log of one model version; only its partition is read. None without any log."""
    path = table_path(spark, table_root, "risk_prediction")
    return read_table(spark, table_root, "risk_prediction").where(F.col("model_version") == version) if exists(spark, path) else None


def read_mark(spark: SparkSession, table_root: str, version: str):
    path = f"{table_root.rstrip('/')}/{MARKS}"
    if not exists(spark, path):
        return None
    marks = spark.read.schema("scored_to timestamp_ntz, model_version string").parquet(path)
    return marks.where(F.col("model_version") == version).agg(F.max("scored_to")).first()[0]


def write_mark(looked_at: DataFrame, table_root: str, version: str) -> None:
    """Move the mark of ``version`` to the last admission of ``looked_at``; it never moves back."""
    spark = looked_at.sparkSession
    last, before = looked_at.agg(F.max("admit_time")).first()[0], read_mark(spark, table_root, version)
    if last is not None and (before is None or last > before):
        row = spark.createDataFrame([(last, version)], "scored_to timestamp_ntz, model_version string")
        reload_partitions(row.coalesce(1), f"{table_root.rstrip('/')}/{MARKS}", "model_version")


def forget_mark(spark: SparkSession, table_root: str) -> None:
    """Drop all marks: the next run looks at every encounter again."""
    remove(spark, f"{table_root.rstrip('/')}/{MARKS}")


def evaluation(spark: SparkSession, trained: Trained) -> dict[str, DataFrame]:
    """A fitted tabular model in figures: report, confusion matrix, baseline, overfit gap and importances."""
    test = trained.scored.where(F.col("split") == "test")
    return {
        "classification_report": metrics.classification_report(test),
        "confusion_matrix": metrics.confusion_matrix(test),
        "baseline": metrics.baseline_comparison(test),
        "overfit": metrics.overfit_check(trained.train_metrics, trained.test_metrics),
        "importances": modelling.feature_importances(spark, trained.bundle.model),
    }
