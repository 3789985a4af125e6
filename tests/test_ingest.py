from __future__ import annotations

import gzip
import os

import pytest
from pyspark.sql import functions as F
from stayline.functions import parsing
from stayline.operators import loading
from stayline.plans import ingest, testdata
from stayline.schema import TABLES
from stayline.sources import documents, extracts, tables

SF_DIR = "/root/testdata/sf0.001"


def write(root, path, text, compressed=False):
    target = os.path.join(root, path)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with (gzip.open(target, "wt") if compressed else open(target, "w")) as f:
        f.write(text)


def test_gz_is_preferred_and_names_come_from_the_header(spark, tmp_path):
    root = str(tmp_path)
    write(root, "hosp/patients.csv", "subject_id,gender\n9,F\n")
    write(root, "hosp/patients.csv.gz", 'extra,gender,subject_id,anchor_age,dod\n"a,b",M,1,NA,2020-01-01\nx,None,2,30,\n', True)
    df = extracts.read_extract(spark, root, "patients")
    assert df.columns == ["subject_id", "gender", "anchor_age", "dod"]
    rows = loading.load_patients(df).orderBy("patient_id").collect()
    assert [r["patient_id"] for r in rows] == [1, 2]
    assert (rows[0]["gender"], rows[0]["anchor_age"], str(rows[0]["dod"])) == ("M", None, "2020-01-01")
    assert (rows[1]["gender"], rows[1]["anchor_age"], rows[1]["dod"]) == (None, 30, None)


def test_missing_extract(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        extracts.find_extract(spark, str(tmp_path), "patients")


def test_parsing(frame):
    df = frame([("2180-05-06 22:23:00",), ("n/a",), ("17",), ("17.0",), (" 3.5 ",), ("nan",), ("abc",)], x="string")
    got = df.selectExpr(parsing.parse_time("x"), parsing.parse_number("x"), parsing.parse_key("x")).collect()
    assert str(got[0][0]) == "2180-05-06 22:23:00" and got[1][0] is None
    assert [r[1] for r in got] == [None, None, 17.0, 17.0, 3.5, None, None]
    assert [r[2] for r in got[2:4]] == [17, 17] and got[6][2] is None
    cleaned = [r[0] for r in df.selectExpr(parsing.missing_to_null("x")).collect()]
    assert cleaned[1] is None and cleaned[5] is None and cleaned[6] == "abc"


def test_loaders_drop_and_fill(frame):
    raw = frame([
        ("5.0", None, "MAIN", "2020-01-01 00:00:00", "bad"), (None, "x", "MAIN", None, None), ("7", "y", "BASE", None, None),
    ], hadm_id="string", drug="string", drug_type="string", starttime="string", stoptime="string")
    kept = frame([(5,)], encounter_id="bigint")
    rows = loading.load_medications(raw, kept).collect()
    assert [(r["encounter_id"], r["drug_name"], r["stop_time"]) for r in rows] == [(5, "Unknown", None)]
    assert "route" not in rows[0].asDict()


def test_unknown_items_are_dropped(frame):
    raw = frame([("1", "2", "220045", "2020-01-01 00:00:00", "80"), ("1", "2", "1", None, "80"),
                 ("1", "2", "220277", None, "x"), (None, "2", "220277", None, "90")],
                hadm_id="string", stay_id="string", itemid="string", charttime="string", valuenum="string")
    rows = loading.load_vitals(raw).collect()
    assert [(r["vital_type"], r["unit"], r["value"]) for r in rows] == [("heart_rate", "bpm", 80.0)]


def test_ingest_is_consistent(spark, tmp_path):
    root = str(tmp_path)
    for name, df in testdata.raw_extracts(spark, SF_DIR).items():
        extracts.write_extract(df, f"{root}/raw", name, compressed=name != "labevents")
    summary = {r["tbl"]: r["n"] for r in ingest.run_ingest(spark, f"{root}/raw", f"{root}/tables", cap=100, max_vitals=50).collect()}
    assert summary["encounter"] == 100
    loaded = tables.read_tables(spark, f"{root}/tables", *summary)
    assert all(loaded[t].count() == n for t, n in summary.items())
    assert all(loaded[t].schema == TABLES[t] for t in summary)
    for name in ("icu_stay", "diagnosis", "medication", "vital_sign", "lab_result"):
        assert loaded[name].join(loaded["encounter"], "encounter_id", "left_anti").count() == 0
    assert loaded["patient"].join(loaded["encounter"], "patient_id", "left_anti").count() == 0
    # running it again replaces the tables
    again = {r["tbl"]: r["n"] for r in ingest.run_ingest(spark, f"{root}/raw", f"{root}/tables", cap=100, max_vitals=50).collect()}
    assert again == summary


def test_clustered_files_hold_ranges(spark, tmp_path):
    labs = testdata.lab_result(spark, SF_DIR)
    tables.reload_tables({"lab_result": labs}, str(tmp_path), cluster=True)
    stored = tables.read_table(spark, str(tmp_path), "lab_result")
    assert stored.exceptAll(labs.select(*stored.columns)).count() == 0 and stored.count() == labs.count()
    files = stored.groupBy(F.input_file_name()).agg(F.min("encounter_id").alias("lo"), F.max("encounter_id").alias("hi"))
    spans = sorted((r["lo"], r["hi"]) for r in files.collect())
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_append_of_no_rows(spark, frame, tmp_path):
    df = frame([(1, "M")], patient_id="bigint", gender="string")
    tables.append_table(df, str(tmp_path), "patient")
    tables.append_table(df.where("false"), str(tmp_path), "patient")
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path), "patient").collect()] == [(1, "M", None, None, None)]


def test_prediction_log(spark, frame, tmp_path):
    df = frame([(1, 0.12344, None, None, 0.5, "MEDIUM")], encounter_id="bigint", xgb_score="double", lstm_score="double",
               cnn_score="double", fusion_score="double", risk_level="string")
    tables.append_predictions(df, str(tmp_path))
    tables.append_predictions(df, str(tmp_path), version="v3")
    log = tables.read_table(spark, str(tmp_path), "risk_prediction")
    assert sorted(r["model_version"] for r in log.collect()) == ["v2_mimic", "v3"]
    row = log.where("model_version = 'v3'").first()
    assert row["xgb_score"] == 0.1234 and row["predicted_at"] is not None


def test_documents(frame):
    docs = frame([("7", "xray", "a"), ("8", "ct", "b"), ("x", "xray", "c")],
                 postgres_encounter_id="string", modality="string", image_path="string")
    wanted = frame([(7,), (8,)], encounter_id="bigint")
    assert [r["image_path"] for r in documents.find_documents(docs, wanted, modality="xray").collect()] == ["a"]
    assert documents.find_documents(docs, modality="xray").count() == 2


def test_parts_with_other_column_orders_and_line_breaks(spark, tmp_path):
    folder = tmp_path / "hosp" / "patients.csv"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text("subject_id,gender,anchor_age\n1,M,40\n2,F,50\n")
    (folder / "b.csv").write_text("gender,extra,subject_id\nF,x,3\n")
    (folder / "c.csv").write_text("")
    rows = extracts.read_extract(spark, str(tmp_path), "patients").orderBy("subject_id").collect()
    assert [tuple(r) for r in rows] == [("1", "M", "40"), ("2", "F", "50"), ("3", "F", None)]
    with gzip.open(tmp_path / "hosp" / "d_icd_diagnoses.csv.gz", "wt") as out:
        out.write('icd_code,icd_version,long_title\nA1,10,"two\nlines, ""quoted"""\nA2,10,plain\n')
    rows = extracts.read_extract(spark, str(tmp_path), "d_icd_diagnoses").orderBy("icd_code").collect()
    assert [tuple(r) for r in rows] == [("A1", "10", 'two\nlines, "quoted"'), ("A2", "10", "plain")]
