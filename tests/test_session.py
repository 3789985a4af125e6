from __future__ import annotations

import pathlib
from types import SimpleNamespace

import pytest

from stayline import session as session_module
from stayline.session import materialize, remove_copies, scratch_path


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))


def test_scratch_folder_comes_from_the_session():
    assert scratch_path(session("spark://host:1", "/shared/x/"), "t").startswith("/shared/x/t-")
    assert scratch_path(session("local[2]"), "t") != scratch_path(session("local[2]"), "t")
    with pytest.raises(ValueError):
        scratch_path(session("spark://host:1"), "t")


def test_materialize_keeps_schema_and_rows(spark):
    df = spark.range(10).selectExpr("id", "CAST(NULL AS timestamp_ntz) AS t", "array(id) AS a")
    copy = materialize(df, "copy")
    assert copy.dtypes == df.dtypes and copy.count() == 10
    assert materialize(df.where("false"), "empty").count() == 0


def test_copies_are_removed(spark, monkeypatch):
    monkeypatch.setattr(session_module, "_COPIES", [])
    copies = [materialize(spark.range(5), "one"), materialize(spark.range(5), "two")]
    folders = [pathlib.Path(p) for p in session_module._COPIES]
    assert sum(c.count() for c in copies) == 10 and all(f.exists() for f in folders)
    assert remove_copies(spark) == 2 and not any(f.exists() for f in folders)
