from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stayline.functions import scores
from stayline.operators import fusion, quality, reports, scoring

SCORES = dict(encounter_id="bigint", xgb_score="double", lstm_score="double", cnn_score="double")


def by_id(df, *columns):
    return {r["encounter_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_api_policy(frame):
    df = frame([
        (1, 0.5, 0.5, 0.5), (2, 0.4, 0.9, None), (3, 0.4, None, 0.9), (4, 0.123456, None, None),
        (5, 0.49996, None, None), (6, 0.54, None, None), (7, None, 0.4, None),
    ], **SCORES)
    fused = fusion.fuse(df, "api")
    got = by_id(fused, "fusion_score", "risk_level")
    assert got[1] == (0.5, "MEDIUM")
    assert got[2] == (0.6, "HIGH")
    assert got[3] == (0.55, "HIGH")
    assert got[4] == (0.1235, "LOW")
    assert got[5] == (0.5, "MEDIUM")  # the band is that of the rounded score
    assert got[6] == (0.54, "HIGH")
    assert got[7] == (None, None)
    weights = by_id(fused, "weights_used")
    assert weights[1][0] == {"xgb": 0.5, "lstm": 0.3, "cnn": 0.2}
    assert weights[3][0] == {"xgb": 0.7, "lstm": 0.0, "cnn": 0.3}


def test_offline_policy(frame):
    df = frame([(1, 0.3, 0.3, None), (2, 0.69999, 0.69999, None), (3, 1.0, 1.0, 1.0), (4, 1.0, 1.0, None)], **SCORES)
    without = by_id(fusion.fuse(df, "offline"), "fusion_score", "risk_level")
    assert without == {1: (0.3, "MEDIUM"), 2: (0.7, "MEDIUM"), 3: (1.0, "HIGH"), 4: (1.0, "HIGH")}
    with_model = by_id(fusion.fuse(df, "offline", cnn_available=True), "fusion_score", "risk_level")
    assert with_model[3] == (1.0, "HIGH")
    assert with_model[4] == (0.2, "LOW")  # no image: its weight is not given to the others


def test_sequence_score(frame):
    nan = float("nan")
    df = frame([(1, 0.7), (2, None), (3, nan), (4, 0.005), (5, 0.9), (6, 1.5)], encounter_id="bigint", raw="double")
    flat = F.col("encounter_id") == 1
    api = by_id(df.withColumn("s", fusion.sequence_score(F.col("raw"), "api", flat)), "s")
    assert [api[i][0] for i in range(1, 7)] == [None, None, None, 0.005, 0.9, 1.0]
    offline = by_id(df.withColumn("s", fusion.sequence_score(F.col("raw"), "offline", flat)), "s")
    assert [offline[i][0] for i in range(1, 7)] == [0.5, 0.5, 0.5, 0.5, 0.9, 1.0]
    loud = by_id(df.withColumn("s", fusion.sequence_score(F.col("raw"), "offline", flat, True)), "s")
    assert loud[5][0] == pytest.approx(1.0) and loud[2][0] == 0.5


@pytest.mark.parametrize("path,score", [
    ("a/PNEUMONIA_normal.png", 0.9), ("a/Virus.png", 0.9), ("a/NORMAL.png", 0.2), ("a/x.png", 0.5), (None, None),
])
def test_path_score(frame, path, score):
    df = frame([(path,)], p="string")
    assert df.select(scores.path_score(F.col("p"))).first()[0] == score
    assert df.select(scores.path_score(F.col("p"), model_available=False)).first()[0] is None


def test_display(frame):
    df = fusion.fuse(frame([(1, 0.125, 0.005, None), (2, None, None, None)], **SCORES), "api")
    shown = by_id(reports.display_scores(df), "xgb_pct", "lstm_pct", "cnn_pct", "risk_label", "weights_pct")
    assert shown[1] == (13, 1, None, "Low Risk", {"xgb": 60, "lstm": 40})
    assert shown[2][3] == "Unknown"


def test_empty_prediction_log(frame):
    log = frame([], fusion_score="double", risk_level="string")
    assert tuple(reports.prediction_summary(log).first()) == (0, None, None, None, None)


def test_alignment(frame):
    df = frame([(1, 5, None)], encounter_id="bigint", age_at_admission="int", avg_hr="double")
    row = scoring.align_features(df).first()
    assert (row["age_at_admission"], row["avg_hr"], row["max_wbc"]) == (5.0, 0.0, 0.0)
    served = scoring.align_features(df.withColumn("avg_hr", F.lit(80.0)), serving_defaults=True).first()
    assert served["avg_hr"] == 0.0


def test_quality(frame):
    people = frame([(1, "M"), (1, "F"), (2, "??")], patient_id="bigint", gender="string")
    stays = frame([(10, 1), (11, 9), (12, None)], encounter_id="bigint", patient_id="bigint")
    assert [r["encounter_id"] for r in quality.orphans(stays, "patient_id", people).collect()] == [11]
    assert [tuple(r) for r in quality.duplicate_keys(people, "patient_id").collect()] == [(1, 2)]


def test_listing_counts_patients_without_encounters(frame):
    people = frame([(1,), (2,), (3,)], patient_id="bigint")
    stays = frame([(10, 3), (11, 3), (12, 1), (13, 9)], encounter_id="bigint", patient_id="bigint")
    top = reports.top_patients(people, stays, 2).collect()
    assert [tuple(r) for r in top] == [(3, 2), (1, 1)]
    assert reports.list_patients(people, stays).where("patient_id = 2").first()["total_encounters"] == 0


def test_lookup_and_filters(frame):
    people = frame([(1, "a"), (2, "b")], patient_id="bigint", name="string")
    wanted = frame([(2,), (7,)], patient_id="bigint")
    found = {r["patient_id"]: (r["name"], r["found"]) for r in reports.lookup(wanted, people, "patient_id").collect()}
    assert found == {2: ("b", True), 7: (None, False)}
    assert [reports.only(people, "patient_id", k).count() for k in (None, 1, [1, 2], wanted)] == [2, 1, 2, 1]
