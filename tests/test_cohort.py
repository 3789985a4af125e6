from __future__ import annotations

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stayline.operators import cohort

ENCOUNTER = dict(encounter_id="bigint", patient_id="bigint", admit_time="timestamp_ntz", discharge_time="timestamp_ntz")
# thresholds that make every patient hot, and none


def flags(df):
    return {r["encounter_id"]: r["readmitted_30d"] for r in df.collect()}


@pytest.mark.parametrize("limits", [{}, dict(rows_each=2)])
def test_label_edges(frame, limits):
    stays = frame([
        # exactly 30 days, then 30 days and an hour, then nothing
        (1, 1, "2020-01-01 00:00:00", "2020-01-02 00:00:00"),
        (2, 1, "2020-02-01 00:00:00", "2020-02-02 00:00:00"),
        (3, 1, "2020-03-03 01:00:00", "2020-03-04 00:00:00"),
        # overlap
        (4, 2, "2020-01-01 00:00:00", "2020-03-01 00:00:00"),
        (5, 2, "2020-01-15 00:00:00", "2020-01-16 00:00:00"),
        # tie on the admit time: the lower id comes first
        (7, 3, "2020-01-01 00:00:00", "2020-01-01 05:00:00"),
        (6, 3, "2020-01-01 00:00:00", "2020-01-02 00:00:00"),
        # NULL admit time sorts last and is no next admission
        (8, 4, "2020-01-01 00:00:00", "2020-01-02 00:00:00"),
        (9, 4, None, "2020-01-03 00:00:00"),
        # an encounter without discharge is left out before the next one is looked up
        (10, 5, "2020-01-01 00:00:00", "2020-01-02 00:00:00"),
        (11, 5, "2020-01-03 00:00:00", None),
        (12, 5, "2020-06-01 00:00:00", "2020-06-02 00:00:00"),
    ], **ENCOUNTER)
    assert flags(cohort.readmission_label(stays, **limits)) == {
        1: 1, 2: 0, 3: 0, 4: 1, 5: 0, 6: 1, 7: 0, 8: 0, 9: 0, 10: 0, 12: 0,
    }


def random_stays(n=400, seed=3):
    rng = random.Random(seed)
    start = datetime(2020, 1, 1)
    rows = []
    for i in range(n):
        # patient 1 holds a third of all rows; unknown patients hold a few
        patient = 1 if i % 3 == 0 else (None if i % 29 == 0 else rng.randrange(2, 30))
        admit = None if i % 37 == 0 else start + timedelta(hours=rng.randrange(0, 2000) // 2)
        discharge = None if i % 23 == 0 else (admit or start) + timedelta(hours=rng.randrange(1, 300))
        rows.append((i, patient, admit, discharge))
    return rows


def as_frame(frame, rows):
    return frame([(i, p, a and str(a), d and str(d)) for i, p, a, d in rows], **ENCOUNTER)


@pytest.mark.parametrize("limits", [{}, dict(rows_each=50), dict(rows_each=7)])
def test_label_and_prior_admissions_against_brute_force(frame, limits):
    rows = random_stays()
    by_patient = {}
    for row in rows:
        if row[3] is not None:
            by_patient.setdefault(row[1], []).append(row)
    expected = {}
    for stays in by_patient.values():
        stays.sort(key=lambda r: (r[2] is None, r[2] or datetime.min, r[0]))
        for this, following in zip(stays, stays[1:] + [None]):
            near = following and following[2] and following[2] - this[3] <= timedelta(days=30)
            expected[this[0]] = 1 if near else 0
    df = as_frame(frame, rows)
    assert flags(cohort.readmission_label(df, **limits)) == expected

    earlier = {
        i: sum(1 for _, q, b, _ in rows if p is not None and q == p and a and b and b < a) for i, p, a, _ in rows
    }
    counted = cohort.prior_admissions(df, **limits)
    assert {r["encounter_id"]: r["num_prior_admissions"] for r in counted.collect()} == earlier
    assert counted.columns == [*df.columns, "num_prior_admissions"]


def test_ranges_are_small_for_one_hour_and_without_times(frame):
    stays = [(i, 1, "2020-01-01 05:00:00" if i % 2 else None, None) for i in range(3_000)]
    placed = cohort.patient_timeline(frame(stays, **ENCOUNTER), rows_each=100)
    assert placed.groupBy("_range").count().agg(F.max("count")).first()[0] <= 300


def brute_sample(rows, cap, seed=42):
    strata = {}
    for key, kind in rows:
        if kind is not None:
            strata.setdefault(kind, []).append(key)
    picked = []
    for kind in sorted(strata):
        keys = sorted(strata[kind], key=lambda k: hashlib.md5(f"{seed}:{k}".encode()).hexdigest())
        picked += keys[: min(len(keys), cap * len(keys) // len(rows) + 1)]
    return sorted(picked[:cap])


@pytest.mark.parametrize("cap", [1, 5, 37, 200, 10_000])
def test_stratified_sample(frame, cap):
    rows = [(i, "single" if i == 0 else None if i % 11 == 0 else "abcd"[i % 4] * 2) for i in range(500)]
    df = frame(rows, encounter_id="bigint", admission_type="string")
    sample = cohort.stratified_sample(df, cap)
    assert sorted(r["encounter_id"] for r in sample.collect()) == brute_sample(rows, cap)
    assert sample.columns == df.columns


def test_random_encounters_are_reproducible(frame):
    df = as_frame(frame, random_stays())
    first = [r["encounter_id"] for r in cohort.random_encounters(df, 20).collect()]
    again = [r["encounter_id"] for r in cohort.random_encounters(df.repartition(3), 20).collect()]
    other = [r["encounter_id"] for r in cohort.random_encounters(df, 20, seed=7).collect()]
    assert first == again != other and len(first) == 20


def test_cap_rows_keeps_ties(frame):
    df = frame([(k,) for k in (5, 1, 3, 3, 3, 2)], k="bigint")
    kept = cohort.cap_rows(df, 3, "k", rows_each=2)
    assert sorted(r["k"] for r in kept.collect()) == [1, 2, 3, 3, 3]
    assert cohort.cap_rows(df, 60, "k").count() == 6


def test_empty_input(frame):
    df = frame([], **ENCOUNTER).withColumn("admission_type", F.lit("x"))
    assert cohort.readmission_label(df).count() == 0
    assert cohort.prior_admissions(df).count() == 0
    assert cohort.stratified_sample(df, 10).count() == 0
