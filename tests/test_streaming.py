from __future__ import annotations

import pathlib

from pyspark.sql import functions as F

from stayline.operators import loading
from stayline.operators import sequences as seq
from stayline.plans import testdata
from stayline.schema import TABLES
from stayline.streaming import events as streams

SF_DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.collect()))


def test_streamed_load_equals_the_batch_load(spark, tmp_path):
    root = str(tmp_path)
    raw = testdata.raw_chartevents(spark, SF_DIR)
    raw.repartition(5).write.parquet(f"{root}/landing")
    kept = testdata.encounter(spark, SF_DIR).where("encounter_id % 3 > 0")

    def load():
        stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/landing")
        streams.stream_vitals(stream, f"{root}/out", f"{root}/checkpoint", kept).awaitTermination()
        return spark.read.parquet(f"{root}/out")

    assert rows(load()) == rows(loading.load_vitals(raw, kept))
    # a second run finds nothing new; new files are added once
    first = load().count()
    raw.limit(100).coalesce(1).write.mode("append").parquet(f"{root}/landing")
    assert load().count() == first + loading.load_vitals(spark.read.parquet(f"{root}/landing"), kept).count() - first


def test_streamed_labs(spark, tmp_path):
    root = str(tmp_path)
    raw = testdata.raw_labevents(spark, SF_DIR)
    raw.write.parquet(f"{root}/landing")
    stream = spark.readStream.schema(raw.schema).parquet(f"{root}/landing")
    streams.stream_labs(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{root}/out").count() == loading.load_labs(raw).count()


def test_late_readings_are_dropped_and_open_hours_wait(spark, tmp_path):
    root = str(tmp_path)
    schema = "encounter_id long, icu_stay_id long, vital_type string, value double, unit string, recorded_at timestamp_ntz"

    def land(*readings):
        loose = schema.replace("recorded_at timestamp_ntz", "recorded_at string")
        df = spark.createDataFrame([(1, 1, "spo2", v, "%", t) for v, t in readings], loose)
        df.withColumn("recorded_at", df.recorded_at.cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{root}/in")

    def run():
        stream = spark.readStream.schema(TABLES["vital_sign"]).parquet(f"{root}/in")
        hourly = streams.hourly_vitals_stream(stream, "1 hour")
        streams.append_stream(hourly, f"{root}/out", f"{root}/checkpoint").awaitTermination()
        out = spark.read.schema(hourly.schema).parquet(f"{root}/out")
        return {str(r["hour"]): r["spo2"] for r in out.collect()}

    land((90.0, "2020-01-01 00:10:00"), (94.0, "2020-01-01 00:20:00"), (80.0, "2020-01-01 03:00:00"))
    assert run() == {"2020-01-01 00:00:00": 92.0}
    land((10.0, "2020-01-01 00:30:00"), (70.0, "2020-01-01 06:00:00"))  # the first is too late
    assert run() == {"2020-01-01 00:00:00": 92.0, "2020-01-01 03:00:00": 80.0}


def test_stream_agrees_with_the_batch_pivot_on_closed_hours(spark, tmp_path):
    root = str(tmp_path)
    vitals = testdata.vital_sign(spark, SF_DIR)
    vitals.coalesce(1).write.parquet(f"{root}/in")
    hourly = streams.hourly_vitals_stream(spark.readStream.schema(vitals.schema).parquet(f"{root}/in"))
    streams.append_stream(hourly, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    out = spark.read.schema(hourly.schema).parquet(f"{root}/out")
    batch = seq.hourly_vitals(vitals)
    assert 0 < out.count() < batch.count()
    compared = [df.select("encounter_id", "hour", F.round("spo2", 6).alias("spo2")) for df in (out, batch)]
    assert compared[0].exceptAll(compared[1]).count() == 0


VITAL = "encounter_id long, icu_stay_id long, vital_type string, value double, unit string, recorded_at timestamp_ntz"
READING = ("encounter_id", "icu_stay_id", "vital_type", "recorded_at")


def landing(spark, root, identity=()):
    """A function that lands readings (encounter, type, value, time) and returns the hours published after them."""
    def deliver(*readings):
        loose = VITAL.replace("timestamp_ntz", "string")
        df = spark.createDataFrame([(e, 1, t, v, "", at) for e, t, v, at in readings], loose)
        if readings:
            df.withColumn("recorded_at", df.recorded_at.cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(TABLES["vital_sign"]).parquet(f"{root}/in")
        streams.publish_hours(stream, root, f"{root}/checkpoint", identity, parts=3).awaitTermination()
        out = streams.published_hours(spark, root).collect()
        return {(r.encounter_id, r.hour and str(r.hour)[5:16]): (r.spo2, r.heart_rate) for r in out}

    return deliver


def test_late_readings_correct_published_hours(spark, tmp_path):
    deliver = landing(spark, str(tmp_path))
    first = deliver((1, "spo2", 90.0, "2020-01-01 00:10:00"), (2, "spo2", 80.0, "2020-01-05 23:59:59"), (1, "other", 1.0, "2020-01-01 09:00:00"))
    assert first == {(1, "01-01 00:00"): (90.0, None), (2, "01-05 23:00"): (80.0, None)}
    # days late, beside an hour of its own, an encounter without an id and a reading without a time
    late = deliver((1, "spo2", 94.0, "2020-01-01 00:50:00"), (1, "heart_rate", 60.0, "2020-01-01 00:00:00"), (1, "spo2", 70.0, "2020-01-01 01:00:00"),
                   (None, "spo2", 50.0, "2020-01-05 23:00:00"), (3, "spo2", 40.0, None), (3, "spo2", None, None))
    assert late == first | {(1, "01-01 00:00"): (92.0, 60.0), (1, "01-01 01:00"): (70.0, None), (None, "01-05 23:00"): (50.0, None),
                            (3, None): (40.0, None)}
    assert deliver((3, "spo2", 60.0, None)) == late | {(3, None): (50.0, None)}


def test_readings_sent_again(spark, tmp_path):
    deliver = landing(spark, str(tmp_path), READING)
    sent = [(1, "spo2", 90.0, "2020-01-01 00:10:00"), (1, "spo2", 94.0, "2020-01-01 00:20:00")]
    assert deliver(*sent, sent[0]) == {(1, "01-01 00:00"): (92.0, None)}
    assert deliver(*sent) == {(1, "01-01 00:00"): (92.0, None)}
    # a smaller value replaces one of an earlier batch; of two in a batch the greater counts
    assert deliver((1, "spo2", 80.0, sent[0][3]), (1, "spo2", 70.0, sent[0][3])) == {(1, "01-01 00:00"): (87.0, None)}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    deliver = landing(spark, str(tmp_path))
    deliver((1, "spo2", 90.0, "2020-01-01 00:10:00"))
    hours = deliver((1, "spo2", 80.0, "2020-01-01 00:10:00"), (1, "spo2", 60.0, "2020-01-02 00:10:00"))
    # as after a crash between the batch's writes and its mark
    commits = pathlib.Path(tmp_path) / "checkpoint" / "commits"
    for name in ("1", ".1.crc"):
        (commits / name).unlink(missing_ok=True)
    assert deliver() == hours == {(1, "01-01 00:00"): (85.0, None), (1, "01-02 00:00"): (60.0, None)}
    assert (commits / "1").exists()


def test_corrected_hours_equal_the_batch_pivot(spark, tmp_path):
    root = str(tmp_path)
    vitals = testdata.vital_sign(spark, SF_DIR)
    for part in vitals.randomSplit([1.0, 1.0], 3):
        part.write.mode("append").parquet(f"{root}/in")
        streams.publish_hours(spark.readStream.schema(vitals.schema).parquet(f"{root}/in"), root, f"{root}/checkpoint").awaitTermination()
    out, batch = streams.published_hours(spark, root), seq.hourly_vitals(vitals)
    compared = [df.select("encounter_id", "hour", F.round("spo2", 6).alias("spo2")) for df in (out, batch)]
    assert out.count() == batch.count() and compared[0].exceptAll(compared[1]).count() == 0
