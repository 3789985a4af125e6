from __future__ import annotations

import contextlib
import gzip
import io
import random

import pytest

from stayline.operators import loading
from stayline.sources import extracts, records

WANTED = ["id", "text", "other", "absent"]


def field(rng):
    kind = rng.randrange(7)
    word = "".join(rng.choices("abc é,", k=rng.randint(0, 9)))
    return [word, f"{word}\nsecond\n\nthird", f'say ""{word}""', "", "12", "\n", f'""\n""{word}'][kind]


def make_file(path, rng, n, names, end="\n", compressed=False):
    opened = gzip.open(path, "wt", encoding="utf-8", newline="") if compressed else open(path, "w", encoding="utf-8", newline="")
    with opened as f:
        f.write(",".join(names) + end)
        for i in range(n):
            values = [str(i) if c == "id" else f'"{field(rng)}"' for c in names]
            f.write(",".join(values) + end)


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def spark_reads(spark, path, names):
    raw = spark.read.csv(path, header=True, escape='"', multiLine=True)
    return sorted(map(str, raw.select(*names).collect()))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_splits_give_what_whole_files_give(spark, tmp_path, small_splits, end):
    for seed in range(4):
        path = str(tmp_path / f"one{seed}.csv")
        make_file(path, random.Random(seed), 120, ["id", "text", "other"], end)
        rows = records.lines(spark, path)
        blocks = records.block_table(rows)
        assert rows.rdd.getNumPartitions() > 3 and blocks.where("odd").count() > 0
        got = records.read_records(spark, path, WANTED, one_line=False)
        assert got.columns == ["id", "text", "other"]
        assert sorted(map(str, got.collect())) == spark_reads(spark, path, ["id", "text", "other"])


def test_files_of_a_folder_are_matched_by_name(spark, tmp_path, small_splits):
    rng = random.Random(9)
    make_file(str(tmp_path / "a.csv"), rng, 40, ["id", "text", "other"])
    make_file(str(tmp_path / "b.csv"), rng, 40, ["more", "other", "id"])
    make_file(str(tmp_path / "c.csv.gz"), rng, 40, ["text", "id"], compressed=True)
    open(tmp_path / "empty.csv", "w").close()
    got = records.read_records(spark, str(tmp_path), WANTED, one_line=False)
    assert got.columns == ["id", "text", "other"] and got.count() == 120
    expected = []
    for name, columns in (("a.csv", "id text other"), ("b.csv", "id NULL other"), ("c.csv.gz", "id text NULL")):
        raw = spark.read.csv(str(tmp_path / name), header=True, escape='"', multiLine=True)
        expected += map(str, raw.selectExpr(*[f"CAST({c} AS STRING) AS {n}" for c, n in zip(columns.split(), got.columns, strict=True)]).collect())
    assert sorted(map(str, got.collect())) == sorted(expected)


def test_one_line_files_are_opened_by_tasks(spark, tmp_path, small_splits, monkeypatch):
    names = ["itemid", "hadm_id", "valuenum"]
    for k in range(30):
        order = names if k % 2 else names[::-1]
        with open(tmp_path / f"p{k:02d}.csv", "w") as f:
            f.write(",".join(order) + "\n" + "".join(",".join(str({"itemid": i, "hadm_id": k, "valuenum": 0.5}[c]) for c in order) + "\n" for i in range(100)))
    got = records.read_records(spark, str(tmp_path), ["hadm_id", "itemid", "valuenum"], one_line=True)
    assert sorted(map(tuple, got.collect())) == sorted((str(k), str(i), "0.5") for k in range(30) for i in range(100))
    assert spark.conf.get("spark.sql.files.openCostInBytes") == "64"


def test_an_open_quote_takes_the_rest_of_the_file(spark, tmp_path, small_splits):
    path = str(tmp_path / "open.csv")
    with open(path, "w") as f:
        f.write("id,text\n1,a\n2,\"never closed\n" + "x,y\n" * 400)
    rows = records.lines(spark, path)
    found = records.whole_records(rows, records.block_table(rows)).select("record").collect()
    assert sorted(len(r.record) for r in found) == [3, 7, len('2,"never closed\n') + 4 * 400 - 1]


def test_no_header(spark, tmp_path):
    open(tmp_path / "empty.csv", "w").close()
    with pytest.raises(ValueError, match="header"):
        records.read_records(spark, str(tmp_path), WANTED, one_line=False)


def test_extracts_round_trip_through_parts(spark, tmp_path):
    rows = [("1", "5", "a \"quoted\"\nnote", None), ("2", "6", "", "x,y")]
    df = spark.createDataFrame(rows, "hadm_id string, itemid string, value string, flag string")
    for compressed in (True, False):
        root = str(tmp_path / str(compressed))
        extracts.write_extract(df, root, "labevents", compressed)
        got = extracts.read_extract(spark, root, "labevents")
        assert sorted(map(str, got.select(*df.columns).collect())) == spark_reads(spark, extracts.find_extract(spark, root, "labevents"), df.columns)


def test_records_are_parsed_once(spark, tmp_path):
    """Loaders filter by parsed columns, and Spark moves filters down: the parser must not be copied into them."""
    folder = tmp_path / "hosp" / "labevents.csv"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text("hadm_id,itemid,valuenum,charttime\n7,50912,1.5,2020-01-01 00:00:00\r\n,50912,2,\n8,1,2,\n")
    rows = loading.load_labs(extracts.read_extract(spark, str(tmp_path), "labevents"))
    assert [(r.encounter_id, r.valuenum) for r in rows.collect()] == [(7, 1.5)]
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        rows.explain(True)
    optimized = said.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert optimized.count("from_csv(") == 1
