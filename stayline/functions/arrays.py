"""Expressions over one encounter's vitals: an array of at most 48 steps, each an array of six values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stayline.schema import SEQUENCE_HOURS, SEQUENCE_VITALS

WIDTH = len(SEQUENCE_VITALS)


def cells(steps: Column) -> Column:
    """All values of all steps in one array."""
    return F.flatten(steps)


def bound(value: Column, use) -> Column:
    """``use(value)``, with the value computed once: Spark computes what stands in a lambda anew for every element."""
    return F.transform(F.array(value), use)[0]


def total(values: Column) -> Column:
    """Sum of an array without NULLs."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def mean(values: Column) -> Column:
    """Mean of the non-NULL values, NULL when there are none."""
    known = F.filter(values, lambda v: v.isNotNull())
    return F.try_divide(total(known), F.size(known))


def spread(values: Column) -> Column:
    """Population standard deviation of an array without NULLs."""
    def of(own: Column) -> Column:
        return bound(total(own) / F.size(own), lambda middle: F.sqrt(
            total(F.transform(own, lambda v: (v - middle) * (v - middle))) / F.size(own)))

    return bound(values, of)


def column(steps: Column, i: int) -> Column:
    """The values of one vital over the steps."""
    return F.transform(steps, lambda step: step[i])


def column_means(steps: Column) -> Column:
    """Mean of each of the six columns over the steps, 0 for a column without values."""
    return F.array(*[F.coalesce(mean(column(steps, i)), F.lit(0.0)) for i in range(WIDTH)])


def map_cells(steps: Column, change) -> Column:
    """Apply ``change(value, column number)`` to every cell."""
    return F.transform(steps, lambda step: F.array(*[change(step[i], i) for i in range(WIDTH)]))


def pad_front(steps: Column, step: Column, length: int = SEQUENCE_HOURS) -> Column:
    """The last ``length`` steps, with copies of ``step`` in front when there are fewer."""
    missing = F.greatest(F.lit(length) - F.size(steps), F.lit(0))
    kept = F.when(F.size(steps) > length, F.slice(steps, -length, length)).otherwise(steps)
    return F.concat(F.array_repeat(step, missing), kept)


def constant_step(value: float | None) -> Column:
    return F.array(*[F.lit(value).cast("double") for _ in range(WIDTH)])
