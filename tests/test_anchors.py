"""Figures two engines agreed on before this library existed (sf0.01)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stayline.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def run(spark, name):
    return QUERIES[name](spark, SF_DIR)


def test_table_counts(spark):
    counts = {r["tbl"]: r["n"] for r in run(spark, "table_counts").collect()}
    assert counts == {"patient": 1500, "encounter": 15000, "icu_stay": 120, "vital_sign": 9000,
                      "lab_result": 56126, "diagnosis": 60000, "medication": 60000}


def test_label(spark):
    row = run(spark, "readmission_check").first()
    assert (row["total"], row["readmitted"], row["rate_pct"]) == (14845, 2108, 14.20)


def test_feature_sums(spark):
    columns = ("age_at_admission", "gender", "length_of_stay", "num_diagnoses", "num_medications", "avg_hr",
               "max_bp_sys", "max_creatinine", "max_wbc", "num_prior_admissions")
    row = run(spark, "encounter_features").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in columns]).first()
    assert row["n"] == 14845
    expected = (842025, 7370, 123202.0833, 59414, 56598, 7072.5474, 17702.64, 91307, 92885, 74439)
    for column, value in zip(columns, expected):
        assert row[column] == pytest.approx(value, abs=1e-3), column


def test_vital_sequence(spark):
    row = run(spark, "vital_sequence").agg(
        F.count("*"), F.count_distinct("encounter_id"), F.min("hour_offset"), F.max("hour_offset"), F.count("heart_rate")
    ).first()
    assert tuple(row) == (2469, 119, 0, 47, 512)


def test_sample(spark):
    row = run(spark, "stratified_sample").agg(F.count("*"), F.sum("encounter_id")).first()
    assert tuple(row) == (3000, 22461954)


def test_metrics(spark):
    row = run(spark, "ranking_metrics").first()
    assert (row["roc_auc"], row["average_precision"]) == (0.496612, 0.143086)


def test_fusion(spark):
    df = run(spark, "fused_scores")
    assert df.agg(F.round(F.sum("fusion_score"), 2)).first()[0] == 7497.51
    bands = {r["risk_level"]: r["count"] for r in df.groupBy("risk_level").count().collect()}
    assert bands == {"LOW": 7506, "MEDIUM": 987, "HIGH": 6507}


def test_image_paths(spark):
    row = run(spark, "image_path_scores").agg(F.count("cnn_score"), F.round(F.sum("cnn_score") * 10, 6)).first()
    assert tuple(row) == (5000, 31250.0)


def test_unknown_diagnoses_and_embeddings(spark):
    assert run(spark, "diagnoses_in_order").where("description = 'Unknown'").count() == 6011
    assert run(spark, "embedding_lookup").count() == 244
