"""Lenient parsing of raw text columns: whatever does not parse becomes NULL.

The functions build SQL text from a column name, so that a whole table is parsed by one ``selectExpr``.
Numbers and keys are matched before they are cast, because a failing cast costs an exception per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from stayline.schema import MISSING_MARKERS

_MARKERS = ", ".join(f"'{marker}'" for marker in MISSING_MARKERS)
_NUMBER = r"r'^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI]nf(inity)?)$'"
_KEY = r"r'^[+-]?\d{1,19}(\.\d*)?$'"


def missing_to_null(text: str) -> str:
    """NULL for the markers that stand for a missing value."""
    return f"CASE WHEN {text} NOT IN ({_MARKERS}) THEN {text} END"


def parse_time(text: str) -> str:
    return f"try_cast(trim({text}) AS timestamp_ntz)"


def parse_date(text: str) -> str:
    return f"CAST({parse_time(text)} AS date)"


def parse_number(text: str) -> str:
    """A finite or infinite double."""
    return f"CASE WHEN trim({text}) RLIKE {_NUMBER} THEN try_cast(trim({text}) AS double) END"


def parse_key(text: str, kind: str = "bigint") -> str:
    """An integer key; ``123.0``, as written for integer columns with gaps, is 123."""
    return f"CASE WHEN trim({text}) RLIKE {_KEY} THEN try_cast(substring_index(trim({text}), '.', 1) AS {kind}) END"


PARSERS = {
    "string": missing_to_null,
    "bigint": parse_key,
    "int": lambda text: parse_key(text, "int"),
    "double": parse_number,
    "timestamp_ntz": parse_time,
    "date": parse_date,
}


def select_present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Those of the wanted columns that exist, in the wanted order."""
    present = set(df.columns)
    return df.select([name for name in wanted if name in present])
