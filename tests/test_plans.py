"""Physical plans: what is pushed down, what is shuffled, and how skew is met."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from stayline.operators import features, reports
from stayline.operators import sequences as seq
from stayline.plans import testdata
from stayline.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return plan(df)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


PLANNED = ["encounter_features", "training_set", "readmission_label", "stratified_sample", "vital_sequence",
           "resolved_sequences", "inference_sequences", "scaled_sequences", "ranking_metrics", "feature_medians",
           "constraint_audit", "loaded_labs", "latest_predictions"]


@pytest.mark.parametrize("name", PLANNED)
def test_no_cross_join(spark, no_broadcast, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_what_is_needed(spark, tmp_path):
    path = str(tmp_path / "labs")
    testdata.lab_result(spark, SF_DIR).write.parquet(path)
    text = plan(features.lab_features(spark.read.parquet(path)))
    assert "ReadSchema: struct<encounter_id:bigint,lab_name:string,valuenum:double>" in text
    assert "In(lab_name, [Creatinine,White Blood Cells])" in text
    text = plan(reports.abnormal_labs(spark.read.parquet(path), encounter_ids=[5, 6]))
    assert "EqualTo(flag,abnormal)" in text and "In(encounter_id, [5,6])" in text


def test_feature_joins_reuse_the_partitioning_of_the_reductions(spark, no_broadcast):
    tables = testdata.typed_tables(spark, SF_DIR) | {"diagnosis": testdata.coded_diagnosis(spark, SF_DIR)}
    text = plan(features.encounter_features(tables))
    # one exchange per source by encounter, with rows already reduced except for the encounters themselves
    assert len(re.findall(r"Exchange hashpartitioning\(encounter_id#\d+L, \d+\)", text)) == 5
    assert text.count("SortMergeJoin") == 7


def test_latest_rows_are_cut_before_the_shuffle(spark):
    text = plan(reports.latest_predictions(testdata.risk_prediction(spark, SF_DIR)))
    assert re.search(r"WindowGroupLimit.*Partial", text)
    hourly = seq.hourly_vitals(testdata.vital_sign(spark, SF_DIR))
    assert re.search(r"WindowGroupLimit.*48, Partial", plan(seq.latest_steps(hourly, "hour")))


def test_hot_join_keys_are_split(spark, no_broadcast):
    """A third of the vitals belong to one stay: adaptive execution splits its partition of the join."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        start = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST(id % 2880 AS INT)")
        key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).cast("bigint")
        vitals = spark.range(0, 150_000, 1, 8).select(
            key.alias("encounter_id"), key.alias("icu_stay_id"), F.lit("spo2").alias("vital_type"),
            F.rand(1).alias("value"), start.alias("recorded_at"))
        stays = spark.range(500).select(
            F.col("id").alias("icu_stay_id"), F.col("id").alias("encounter_id"),
            F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'").alias("icu_intime"))
        labels = stays.select("encounter_id", F.lit(1).alias("readmitted_30d"))
        df = seq.vital_sequence(stays, vitals, labels)
        assert "skew=true" in final_plan(df)
        assert df.where("encounter_id = 7").count() == 48
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
