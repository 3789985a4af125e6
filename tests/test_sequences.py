from __future__ import annotations

import math
import statistics
import time

import pytest
from pyspark.sql import functions as F

from stayline.functions import arrays
from stayline.operators import sequences as seq
from stayline.schema import SEQUENCE_VITALS

N = len(SEQUENCE_VITALS)
SEQUENCE = dict(encounter_id="bigint", readmitted_30d="int", hour_offset="int", **{v: "double" for v in SEQUENCE_VITALS})
VITAL = dict(encounter_id="bigint", icu_stay_id="bigint", vital_type="string", value="double", recorded_at="timestamp_ntz")
STAY = dict(icu_stay_id="bigint", encounter_id="bigint", icu_intime="timestamp_ntz")


def steps(df):
    return {r["encounter_id"]: r["steps"] for r in df.collect()}


def hours(encounter, values, label=0):
    return [(encounter, label, h, *([v] * N if not isinstance(v, tuple) else v)) for h, v in enumerate(values)]


def test_window_edges_and_first_stay(frame):
    stays = frame([
        (11, 1, "2020-01-05 00:30:00"), (10, 1, "2020-01-01 00:30:00"), (12, 1, "2020-01-01 00:30:00"),
        (20, 2, "2020-01-01 00:00:00"), (30, 3, None),
    ], **STAY)
    vitals = frame([
        (1, 10, "heart_rate", 1.0, "2020-01-01 00:29:59"),   # before the stay
        (1, 10, "heart_rate", 2.0, "2020-01-01 00:30:00"),   # its start
        (1, 10, "heart_rate", 4.0, "2020-01-01 01:29:59"),   # still hour 0
        (1, 10, "spo2", 9.0, "2020-01-03 00:29:59"),         # hour 47
        (1, 10, "spo2", 9.0, "2020-01-03 00:30:00"),         # exactly 48 hours later
        (1, 10, "gcs_eye", 9.0, "2020-01-01 05:00:00"),      # no sequence vital
        (1, 11, "heart_rate", 7.0, "2020-01-05 01:00:00"),   # a later stay
        (1, 12, "heart_rate", 7.0, "2020-01-01 01:00:00"),   # same start, higher stay id
        (2, 20, "heart_rate", 7.0, "2020-01-01 01:00:00"),   # no label
        (3, 30, "heart_rate", 7.0, "2020-01-01 01:00:00"),   # stay without a start
    ], **VITAL)
    labels = frame([(1, 1), (3, 0)], encounter_id="bigint", readmitted_30d="int")
    rows = [(r["encounter_id"], r["readmitted_30d"], r["hour_offset"], r["heart_rate"], r["spo2"])
            for r in seq.vital_sequence(stays, vitals, labels).orderBy("hour_offset").collect()]
    assert rows == [(1, 1, 0, 3.0, None), (1, 1, 47, None, 9.0)]


def test_null_hour_counts_as_latest(frame):
    vitals = frame([(1, 1, "spo2", float(h), f"2020-01-01 {h:02}:10:00") for h in range(5)]
                   + [(1, 1, "spo2", 99.0, None)], **VITAL)
    hourly = seq.hourly_vitals(vitals)
    latest = seq.latest_steps(hourly, "hour", 3).orderBy("spo2").collect()
    assert [r["spo2"] for r in latest] == [3.0, 4.0, 99.0]


def test_any_type_keeps_hours_without_sequence_vitals(frame):
    vitals = frame([(1, 1, "gcs_eye", 3.0, "2020-01-01 00:10:00"), (1, 1, "spo2", 5.0, "2020-01-01 01:10:00")], **VITAL)
    assert seq.hourly_vitals(vitals).count() == 1
    assert seq.hourly_vitals(vitals, only_sequence_vitals=False).count() == 2


def test_resolve_prefers_the_sequence(frame):
    sequences = frame(hours(1, [5.0, 6.0]), **SEQUENCE)
    vitals = frame(
        [(e, e, "spo2", float(h), f"2020-01-0{1 + h // 24} {h % 24:02}:00:00") for e in (1, 2) for h in range(60)], **VITAL
    )
    ascending = seq.resolve_sequences(sequences, vitals).where("encounter_id = 2").orderBy("step").collect()
    assert [r["spo2"] for r in ascending] == [float(h) for h in range(12, 60)]
    descending = seq.resolve_sequences(sequences, vitals, parity_order=True).where("encounter_id = 2")
    assert [r["spo2"] for r in descending.orderBy("step").collect()] == [float(h) for h in range(59, 11, -1)]
    assert seq.resolve_sequences(sequences, vitals).where("encounter_id = 1").count() == 2


def test_training_sequences(frame):
    rows = (
        hours(1, [2.0])                                     # one row: padded with itself
        + hours(2, [float(h) for h in range(60)])           # too long: the last 48
        + hours(3, [0.0] * 48)                              # full and all zero: dropped
        + hours(4, [0.0] * 47)                              # all zero but padded: kept
        + hours(5, [(1.0, None, *[3.0] * 4), (None, None, *[5.0] * 4)])  # gaps are 0 before the mean is taken
        + hours(6, [float("nan"), float("inf")])
    )
    got = steps(seq.training_sequences(frame(rows, **SEQUENCE)))
    assert sorted(got) == [1, 2, 4, 5, 6] and all(len(s) == 48 for s in got.values())
    assert got[1] == [[2.0] * N] * 48
    assert [s[0] for s in got[2]] == [float(h) for h in range(12, 60)]
    assert got[5][0] == [0.5, 0.0, 4.0, 4.0, 4.0, 4.0]
    assert got[5][46:] == [[1.0, 0.0, 3.0, 3.0, 3.0, 3.0], [0.0, 0.0, 5.0, 5.0, 5.0, 5.0]]
    assert got[6] == [[0.0] * N] * 48


def resolved(frame, rows):
    return frame(rows, **SEQUENCE).withColumnRenamed("hour_offset", "step").withColumn("source", F.lit("x"))


def test_inference_fills_with_the_mean_over_all_rows(frame):
    rows = hours(1, [(1.0, None, *[3.0] * 4), (None, None, *[5.0] * 4)])
    # 60 rows: the gap in the last row takes the mean of all rows, not only of the 48 kept
    rows += hours(2, [float(h) for h in range(59)] + [(None, *[59.0] * 5)])
    got = {r["encounter_id"]: r for r in seq.inference_sequences(resolved(frame, rows)).collect()}
    assert got[1]["steps"][:46] == [[0.0] * N] * 46
    assert got[1]["steps"][46:] == [[1.0, 0.0, 3.0, 3.0, 3.0, 3.0], [1.0, 0.0, 5.0, 5.0, 5.0, 5.0]]
    assert got[2]["steps"][47][0] == statistics.mean(range(59)) and got[2]["steps"][0] == [12.0] * N
    assert not got[1]["flat"]


def test_flatness(frame):
    rows = hours(1, [7.0] * 3) + hours(2, [7.0, 7.001, 7.0]) + hours(3, [7.0, 7.01, 7.0]) + hours(4, [None] * 2)
    got = {r["encounter_id"]: r["flat"] for r in seq.inference_sequences(resolved(frame, rows)).collect()}
    values = [7.0] * 6 + [7.001] * 6 + [7.0] * 6
    assert statistics.pstdev(values) < 1e-3
    assert got == {1: True, 2: True, 3: False, 4: True}


def test_offline_flatness(frame):
    rows = hours(1, [7.0] * 48) + hours(2, [-1.0, -2.0]) + hours(3, [1.0])
    prepared = seq.inference_sequences(resolved(frame, rows), "offline")
    got = {r["encounter_id"]: r["flat"]
           for r in prepared.select("encounter_id", seq.offline_flat(F.col("steps")).alias("flat")).collect()}
    # padding varies a sequence; one that never rises above zero is flat too
    assert got == {1: True, 2: True, 3: False}


def test_scaling(frame):
    rows = hours(1, [(1.0, 5.0, *[0.0] * 4)] * 48) + hours(2, [(3.0, 5.0, *[0.0] * 4)] * 48)
    prepared = seq.training_sequences(frame(rows, **SEQUENCE))
    scaler = seq.fit_scaler(prepared)
    first, second = scaler.orderBy("position").limit(2).collect()
    assert tuple(first) == (0, "heart_rate", pytest.approx(2.0), pytest.approx(1.0))
    assert tuple(second) == (1, "bp_systolic", 5.0, 0.0)
    got = steps(seq.scale(prepared, scaler))
    assert (got[1][0][:2], got[2][0][:2]) == (pytest.approx([-1.0, 0.0]), pytest.approx([1.0, 0.0]))
    z = steps(seq.scale(prepared, scaler, epsilon=1e-6))
    assert math.isclose(z[2][0][0], 1 / (1 + 1e-6)) and z[2][0][1] == 0.0


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_hours_do_not_depend_on_the_session_zone(spark, frame, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 02:30 does not exist in New York on this day
        vitals = frame([(1, 1, "spo2", 5.0, "2020-03-08 02:30:15.25")], **VITAL)
        hour = seq.hourly_vitals(vitals).select(F.col("hour").cast("string").alias("h")).first()["h"]
        assert hour == "2020-03-08 02:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_spread_takes_time_in_proportion_to_the_values(spark):
    """The mean is computed once, not for every value: these would take minutes."""
    n = 40_000
    begin = time.monotonic()
    row = spark.range(1).select(arrays.spread(F.sequence(F.lit(1), F.lit(n)).cast("array<double>")).alias("s"),
                                arrays.spread(F.lit(None).cast("array<double>")).alias("none")).first()
    assert row["s"] == pytest.approx(math.sqrt((n * n - 1) / 12)) and row["none"] is None
    assert time.monotonic() - begin < 20
