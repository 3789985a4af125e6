from __future__ import annotations

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from stayline.operators import scoring
from stayline.operators.boosting import BoostedTrees
from stayline.plans import scoring as job
from stayline.schema import MODEL_FEATURES
from stayline.sources import tables
from stayline.sources.bundles import Bundle, save_bundle


@pytest.fixture
def job_of(spark, tmp_path):
    """A function that runs the job for encounters (id, day of admission) and gives the log's ids."""
    root = str(tmp_path / "tables")
    save_bundle(spark, Bundle(BoostedTrees([], MODEL_FEATURES), "none", MODEL_FEATURES), f"{root}/bundle")
    features = spark.range(100).select(F.col("id").alias("encounter_id"), *[F.lit(1.0).alias(c) for c in MODEL_FEATURES])
    steps = spark.createDataFrame([], "encounter_id long, hour_offset int, heart_rate double, bp_systolic double, bp_diastolic double, "
                                      "temperature_f double, respiratory_rate double, spo2 double, readmitted_30d int")
    vitals = spark.createDataFrame([], "encounter_id long, icu_stay_id long, vital_type string, value double, recorded_at timestamp_ntz")

    def run(rows, **how):
        df = spark.createDataFrame(rows, "encounter_id long, day int").selectExpr(
            "encounter_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '1' DAY * day AS admit_time")
        given = {"features": features, "sequences": steps, "vital_sign": vitals}
        job.run_incremental(spark, df, given, root, f"{root}/bundle", f"{root}/none", **how)
        return sorted(r[0] for r in tables.read_table(spark, root, "risk_prediction").select("encounter_id").collect())

    run.root = root
    return run


def test_overlapping_batches_are_scored_once(job_of):
    assert job_of([(1, 0), (2, 1), (2, 1)]) == [1, 2]
    assert job_of([(1, 0), (2, 1), (3, 2)]) == [1, 2, 3]
    assert job_of([(1, 0), (2, 1), (3, 2)]) == [1, 2, 3]


def test_late_encounters_within_the_lateness(job_of):
    assert job_of([(1, 100)]) == [1]
    assert job_of([(2, 80), (3, 60), (4, None)]) == [1, 2, 4]  # 30 days late at most
    assert job_of([(3, 60)], lateness="INTERVAL '50' DAY") == [1, 2, 3, 4]


def test_a_run_that_ended_before_its_mark(spark, job_of, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(job, "write_mark", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            job_of([(1, 0), (2, 1)])
    assert job.read_mark(spark, job_of.root, "v2_mimic") is None
    assert job_of([(1, 0), (2, 1), (3, 5)]) == [1, 2, 3]


def test_versions_have_logs_and_marks_of_their_own(spark, job_of):
    assert job_of([(1, 3)]) == [1]
    assert job_of([(1, 3), (2, 1)], version="v3") == [1, 1, 2]
    assert str(job.read_mark(spark, job_of.root, "v3")) == "2024-01-04 00:00:00"
    assert job_of([(2, 1)], version="v3") == [1, 1, 2]


def test_encounters_without_features_are_tried_again(job_of):
    assert job_of([(1, 0), (500, 0)]) == [1]
    assert job_of([(500, 0)]) == [1]


def test_a_log_of_small_files_is_not_broadcast(spark, tmp_path):
    """Keys in a row take next to no room in files, so their size says little about their number."""
    spark.range(1000).select(F.col("id").alias("encounter_id")).write.parquet(str(tmp_path / "log"))
    encounters = spark.range(900, 1100).select(F.col("id").alias("encounter_id"), F.lit(None).cast("timestamp_ntz").alias("admit_time"))
    found = scoring.unscored(encounters, spark.read.parquet(str(tmp_path / "log")))
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        found.explain()
    assert "Broadcast" not in said.getvalue() and "SortMergeJoin" in said.getvalue()
    assert found.count() == 100
