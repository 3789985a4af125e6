from __future__ import annotations

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from stayline.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_spark(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """frame(rows, schema): a DataFrame; date-times are given as text and cast by the schema."""

    def make(rows, **columns):
        names = list(columns)
        text = {"timestamp_ntz", "date"}
        loose = ", ".join(f"`{c}` {'string' if t in text else t}" for c, t in columns.items())
        df = spark.createDataFrame([tuple(r) for r in rows], loose)
        return df.selectExpr(*[f"CAST(`{c}` AS {columns[c]}) AS `{c}`" for c in names])

    return make
