from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stayline.operators import modelling, scoring
from stayline.operators.boosting import Settings
from stayline.plans import catalog, training
from stayline.plans import scoring as scoring_job
from stayline.schema import MODEL_FEATURES, SEQUENCE_VITALS
from stayline.sources.bundles import load_bundle, save_bundle


@pytest.fixture(scope="module")
def planted(spark):
    """Readmission follows the number of prior admissions, with some noise."""
    noise = F.pmod(F.xxhash64("encounter_id"), F.lit(100))
    rows = spark.range(1500).select(
        F.col("id").alias("encounter_id"),
        F.expr("TIMESTAMP_NTZ '2020-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(id AS INT)").alias("admit_time"),
        F.expr("DATE '2020-01-01' + CAST(id / 24 AS INT)").alias("admit_date"),
    )
    others = [F.pmod(F.xxhash64("encounter_id", F.lit(c)), F.lit(50)).cast("double").alias(c) for c in MODEL_FEATURES[:-1]]
    prior = F.pmod(F.xxhash64("encounter_id", F.lit("p")), F.lit(10))
    df = rows.select("*", *others, prior.cast("double").alias(MODEL_FEATURES[-1]), noise.alias("_noise"))
    readmitted = (F.col(MODEL_FEATURES[-1]) >= 7) != (F.col("_noise") < 5)
    return df.withColumn("label", F.when(readmitted, 1).otherwise(0)).drop("_noise")


@pytest.fixture(scope="module")
def trained(planted):
    return training.train_tabular(planted, Settings(rounds=30))


def test_tabular_model_finds_the_signal(trained):
    scored = trained.scored
    bad = scored.where(~F.col("score").between(0, 1)).count()
    assert bad == 0 and scored.count() == 1500
    assert trained.test_metrics.first()["roc_auc"] > 0.85
    assert trained.bundle.test_auc == trained.test_metrics.first()["roc_auc"]


def test_training_is_reproducible(planted, trained):
    again = training.train_tabular(planted, Settings(rounds=30))
    assert again.bundle.test_auc == pytest.approx(trained.bundle.test_auc)


def test_importances(spark, trained):
    top = modelling.feature_importances(spark, trained.bundle.model).collect()
    assert top[0]["feature"] == "num_prior_admissions" and sum(r["importance"] for r in top) == pytest.approx(1.0)


def test_bundle_round_trip_and_missing_bundle(spark, planted, trained, tmp_path):
    path = str(tmp_path / "bundle")
    assert load_bundle(spark, path) is None
    save_bundle(spark, trained.bundle, path)
    loaded = load_bundle(spark, path)
    assert (loaded.version, loaded.feature_cols) == ("xgb_mimic_v1", MODEL_FEATURES)
    assert loaded.test_auc == pytest.approx(trained.bundle.test_auc)
    wanted = spark.range(1490, 1510).withColumnRenamed("id", "encounter_id")
    before, after = (
        [tuple(r) for r in scoring.tabular_scores(wanted, planted, b).select("encounter_id", "xgb_score", "status")
         .orderBy("encounter_id").collect()] for b in (trained.bundle, loaded)
    )
    assert before == after
    assert {s for e, _, s in after if e >= 1500} == {"no features"} and {s for e, _, s in after if e < 1500} == {"ok"}
    offline = scoring.tabular_scores(wanted, planted, loaded, "offline").where("encounter_id >= 1500").collect()
    assert {(r["xgb_score"], r["status"]) for r in offline} == {(0.5, "ok")}


def test_class_weight(frame):
    rows = modelling.class_weight(frame([(1,), (0,), (0,), (0,)], label="int")).first()
    assert tuple(rows) == (1, 3, 3.0)
    assert modelling.class_weight(frame([(0,), (0,)], label="int")).first()["scale_pos_weight"] == 1.0


@pytest.fixture(scope="module")
def planted_sequences(spark):
    """High heart rates go with readmission; the number of hours varies."""
    hours = F.explode(F.sequence(F.lit(0), F.pmod(F.col("id"), F.lit(48)).cast("int")))
    rows = spark.range(300).select(F.col("id").alias("encounter_id"), (F.xxhash64("id") % 2 == 0).cast("int").alias("readmitted_30d"), hours.alias("hour_offset"))
    wobble = F.pmod(F.xxhash64("encounter_id", "hour_offset"), F.lit(10))
    values = [(70 + wobble + (F.col("readmitted_30d") * 15 if v == "heart_rate" else 0)).cast("double").alias(v) for v in SEQUENCE_VITALS]
    return rows.select("*", *values)


def test_sequence_model_and_batch(spark, planted, trained, planted_sequences):
    fitted = training.train_sequences(planted_sequences)
    assert fitted.test_metrics.first()["roc_auc"] > 0.9
    splits = fitted.scored.groupBy("encounter_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count()
    assert splits == 0 and fitted.scored.count() == 300
    vitals = spark.createDataFrame([], "encounter_id long, icu_stay_id long, vital_type string, value double, recorded_at timestamp_ntz")
    wanted = spark.range(1600).withColumnRenamed("id", "encounter_id")
    rows = scoring.score_batch(wanted, planted, planted_sequences, vitals, trained.bundle, fitted.bundle)
    got = {r["encounter_id"]: r for r in rows.collect()}
    assert len(got) == 1600
    assert got[10]["weights_used"] == {"xgb": 0.6, "lstm": 0.4, "cnn": 0.0} and 0 <= got[10]["lstm_score"] <= 1
    assert got[700]["weights_used"]["xgb"] == 1.0 and got[700]["lstm_score"] is None
    assert (got[1550]["status"], got[1550]["fusion_score"]) == ("no features", None)
    assert scoring.scored_only(rows).count() == 1500
    offline = scoring.score_batch(wanted, planted, planted_sequences, vitals, trained.bundle, fitted.bundle, policy="offline")
    assert offline.where("encounter_id = 1550").first()["fusion_score"] == 0.5
    assert offline.where("fusion_score IS NULL").count() == 0


def test_without_models(spark, planted, planted_sequences):
    vitals = spark.createDataFrame([], "encounter_id long, icu_stay_id long, vital_type string, value double, recorded_at timestamp_ntz")
    rows = scoring.score_batch(planted, planted, planted_sequences, vitals, None, None)
    assert {r["status"] for r in rows.select("status").distinct().collect()} == {"no model"}


def test_scoring_job(spark, planted, trained, planted_sequences, tmp_path):
    path = str(tmp_path / "bundle")
    save_bundle(spark, trained.bundle, path)
    vitals = spark.createDataFrame([], "encounter_id long, icu_stay_id long, vital_type string, value double, recorded_at timestamp_ntz")
    tables = {"features": planted, "sequences": planted_sequences, "vital_sign": vitals}
    wanted = spark.range(1490, 1510).withColumnRenamed("id", "encounter_id")
    records = scoring_job.run_scoring(spark, wanted, tables, str(tmp_path / "tables"), path, str(tmp_path / "none"))
    assert sorted(r["encounter_id"] for r in records.collect()) == list(range(1490, 1500))
    log = spark.read.parquet(str(tmp_path / "tables" / "risk_prediction"))
    assert log.count() == 10 and log.where("fusion_score IS NULL OR predicted_at IS NULL").count() == 0
    result = scoring_job.evaluation(spark, trained)
    assert result["classification_report"].count() == 5 and result["importances"].first()["feature"] == "num_prior_admissions"
    assert {r["model"] for r in result["baseline"].collect()} == {"baseline", "model"} and result["overfit"].count() == 1


def test_only_wanted_encounters_are_scored(spark, planted, trained, planted_sequences):
    vitals = spark.createDataFrame([], "encounter_id long, icu_stay_id long, vital_type string, value double, recorded_at timestamp_ntz")
    wanted = spark.createDataFrame([(3,), (3,), (9_999,)], "encounter_id long")
    rows = scoring.score_batch(wanted, planted, planted_sequences, vitals, trained.bundle, None).collect()
    assert sorted((r["encounter_id"], r["status"]) for r in rows) == [(3, "ok"), (3, "ok"), (9999, "no features")]


def test_model_bundle_computes_the_features_once(spark, planted, monkeypatch):
    """Training and scoring read one copy of the feature table."""
    calls, fitted = [], []

    def table(*args):
        calls.append(args)
        return planted.drop("label")

    def short(training_rows):
        fitted.append((training_rows.count(), any("/features-" in f for f in training_rows.inputFiles())))
        bundle = training.Bundle(modelling.BoostedTrees([], MODEL_FEATURES), "none", MODEL_FEATURES)
        return training.Trained(bundle, *[training_rows] * 3)

    monkeypatch.setattr(catalog, "feature_table", table)
    monkeypatch.setattr(catalog, "labels", lambda *_: planted.select("encounter_id", F.col("label").alias("readmitted_30d")))
    monkeypatch.setattr(catalog.testdata, "encounter", lambda *_: spark.range(1490, 1510).withColumnRenamed("id", "encounter_id"))
    monkeypatch.setattr(catalog, "_TRAINED", {})
    monkeypatch.setattr(training, "train_tabular", short)
    rows = {r["status"]: (r["rows"], r["changed"]) for r in catalog.model_bundle(spark, "own rows").collect()}
    assert rows == {"ok": (10, 0), "no features": (10, 0)}
    assert len(calls) == 1 and fitted == [(planted.where("length_of_stay > 0").count(), True)]
