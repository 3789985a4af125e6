"""Chronological train / validation / test splits by row position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.operators.ranking import at_most, key_levels, nth_keys, time_levels
from stayline.schema import SPLIT_SHARES
from stayline.session import materialize


def split_by_position(df: DataFrame, order: list[str], levels: list[Column],
                      shares: tuple[float, float] = SPLIT_SHARES) -> DataFrame:
    """Add ``split``: the first 70 % of rows are train, up to 85 % val, the rest test.

    Positions are ``int(n * share)``. Only the two keys at the ends of train and val are looked up; rows are
    then compared with them, so the data itself is neither sorted nor shuffled. The sort keys are written out
    once, so the lookup does not compute the other columns. NULL keys come last.
    """
    sort_keys = materialize(df.select(*order), "split-keys")
    n = sort_keys.count()
    ends = [int(n * share) - 1 for share in shares]
    keys = nth_keys(sort_keys, order, levels, [p for p in ends if p >= 0])

    def within(end: int) -> Column:
        return at_most(order, keys[end]) if end >= 0 else F.lit(False)

    split = F.when(within(ends[0]), "train").when(within(ends[1]), "val").otherwise("test")
    return df.withColumn("split", split)


def chronological_split(df: DataFrame, time: str = "admit_time", key: str = "encounter_id") -> DataFrame:
    """Split encounters by admit time; the key decides ties."""
    return split_by_position(df, [time, key], time_levels(time, key))


def key_split(df: DataFrame, key: str = "encounter_id") -> DataFrame:
    """Split by the encounter key, which stands in for time; one row per encounter."""
    return split_by_position(df, [key], key_levels(key))


def split_summary(df: DataFrame, label: str = "label", date: str | None = "admit_date") -> DataFrame:
    """Rows, dates and positive rate of each split."""
    dates = [F.min(date).alias("first_date"), F.max(date).alias("last_date")] if date else []
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), *dates, F.avg(label).alias("positive_rate")
    )
