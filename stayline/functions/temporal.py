"""Time arithmetic on zone-less timestamps, independent of the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_between(start: Column, end: Column) -> Column:
    """Exact seconds, with microseconds, as a decimal."""
    return (end - start).cast("interval second").cast("decimal(18,6)")


def stay_days(start: Column, end: Column) -> Column:
    """Length of a stay in fractional days."""
    return seconds_between(start, end).cast("double") / F.lit(86400.0)


def age_at(admit_time: Column, anchor_age: Column, anchor_year: Column) -> Column:
    """Age in whole years at admission, 0 when a part is unknown."""
    return F.coalesce(anchor_age + (F.year(admit_time) - anchor_year), F.lit(0)).cast("int")


def male_flag(gender: Column) -> Column:
    """1 for ``M``, 0 for anything else and for NULL."""
    return F.when(gender == "M", 1).otherwise(0)


def hour_of(time: Column) -> Column:
    """The start of the hour; ``date_trunc`` would go through the session zone."""
    return time - F.make_dt_interval(mins=F.minute(time), secs=F.extract(F.lit("SECOND"), time))
