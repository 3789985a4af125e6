from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stayline.operators import quality
from stayline.plans import testdata
from stayline.sources import tables

SF_DIR = "/root/testdata/sf0.001"


def people(spark, *ids):
    return spark.createDataFrame([(i, "F") for i in ids], "patient_id long, gender string")


def ids(spark, root, name="patient"):
    return sorted(r[0] for r in tables.read_table(spark, root, name).collect())


def test_a_load_replaces_all_its_tables_at_once(spark, tmp_path):
    root = str(tmp_path / "t")
    stays = spark.createDataFrame([(5, 1), (6, 2)], "encounter_id long, patient_id long")
    tables.reload_tables({"patient": people(spark, 1, 2), "encounter": stays}, root)
    before = tables.read_tables(spark, root, "patient", "encounter")
    broken = stays.withColumn("race", F.when(F.col("encounter_id") > 5, F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        tables.reload_tables({"patient": people(spark, 3), "encounter": broken}, root)
    assert ids(spark, root) == [1, 2] and ids(spark, root, "encounter") == [5, 6] and tables.last_load(spark, root) == 1
    tables.reload_tables({"patient": people(spark, 7)}, root)
    assert ids(spark, root) == [7] and ids(spark, root, "encounter") == [5, 6]
    assert before["patient"].count() == 2  # a reader of the load before


def test_old_loads_expire(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.reload_tables({"encounter": spark.createDataFrame([(9, 1)], "encounter_id long, patient_id long")}, root)
    for k in range(5):
        tables.reload_tables({"patient": people(spark, k)}, root)
    assert ids(spark, root) == [4] and ids(spark, root, "encounter") == [9]
    kept = sorted(p.name for p in (tmp_path / "t" / "_commits").iterdir() if p.name.isdigit())
    assert kept == [f"{n:010d}" for n in (5, 6)]
    # the folders of both commits, and that of the table that was loaded once
    assert sorted(int(p.name.split("-")[0]) for p in (tmp_path / "t" / "_loads").iterdir()) == [1, 5, 6]


def test_a_load_that_was_overtaken_fails(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.reload_tables({"patient": people(spark, 1)}, root)
    with pytest.raises(RuntimeError, match="another load"):
        tables.commit_load(spark, root, 1, {"patient": "elsewhere"})
    assert ids(spark, root) == [1]
    assert not [p for p in (tmp_path / "t" / "_commits").iterdir() if p.name.startswith("draft")]


def test_appends_go_to_the_current_rows(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.append_table(people(spark, 1), root, "patient")
    tables.reload_tables({"patient": people(spark, 2)}, root)
    tables.append_table(people(spark, 3), root, "patient")
    assert ids(spark, root) == [2, 3]


def test_clustering_reads_its_source_once(spark, tmp_path):
    """The ranges are sampled from a written copy."""
    source = str(tmp_path / "x.csv")
    with open(source, "w") as f:
        f.write("encounter_id,chart_time\n" + "".join(f"{i % 50},2020-01-01 00:00:00\n" for i in range(500)))
    rows = spark.read.csv(source, header=True)
    plan = tables.clustered(rows, "encounter_id", "chart_time")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "FileScan csv" not in plan


def plain_audit(rows):
    """Violations by Python over lists of rows."""
    parents = {t: [r[k] for r in rows[t]] for t, k in quality.PRIMARY_KEYS.items()}
    found = {f"{t}.{k} unique": sum(1 for v in set(parents[t]) if v is None or parents[t].count(v) > 1)
             for t, k in quality.PRIMARY_KEYS.items()}
    for child, key, parent in quality.FOREIGN_KEYS:
        known = set(parents[parent])
        found[f"{child}.{key} -> {parent}"] = sum(1 for r in rows[child] if r[key] is not None and r[key] not in known)
    for t, limits in quality.TEXT_LIMITS.items():
        for c, n in limits.items():
            found[f"{t}.{c} length"] = sum(1 for r in rows[t] if r[c] is not None and len(r[c]) > n)
    return found


def test_audit_against_plain_counts_with_one_scan_a_table(spark):
    audited = {n: df.where(F.pmod(F.xxhash64(df.columns[0]), F.lit(3)) == 0) for n, df in testdata.audited_tables(spark, SF_DIR).items()}
    audited = {n: spark.createDataFrame(df.collect(), df.schema) for n, df in audited.items()}
    expected = plain_audit({n: df.collect() for n, df in audited.items()})
    got = {r["constraint"]: r["violations"] for r in quality.constraint_audit(audited).collect()}
    assert got == expected and sum(v > 0 for v in got.values()) >= 8
    fewer = {r["constraint"]: r["violations"] for r in quality.orphan_counts(audited).collect()}
    assert fewer == {c: n for c, n in expected.items() if " -> " in c}
    empty = {n: df.where("false") for n, df in audited.items()}
    assert {r["violations"] for r in quality.constraint_audit(empty).collect()} == {0}


def test_one_scan_a_table(spark):
    typed = testdata.typed_tables(spark, SF_DIR)
    written = {n: tables.materialize(df, f"audit-{n}") for n, df in typed.items()}
    plan = quality.constraint_audit(written)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == len(typed)
