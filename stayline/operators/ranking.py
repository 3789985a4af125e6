"""Ranks, running totals and cut points over a total order, without a window over all rows."""

from __future__ import annotations

from datetime import datetime
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.session import materialize

RANGE_ROWS = 500_000


def in_ranges(df: DataFrame, order: list[str], rows_each: int = RANGE_ROWS) -> DataFrame:
    """``df`` cut by ``order`` into ranges of about ``rows_each`` rows, numbered in order by ``_range``.

    Written out, so the numbers stay. A range holds neighbours in the order, so what is sorted within a range
    only needs a small carry from the ranges before it, and no key is too frequent as long as ``order`` tells
    its rows apart.
    """
    rows = materialize(df, "values")  # sampled for the limits, then dealt out
    n = max(1, ceil(rows.count() / rows_each))
    return materialize(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def running_totals(df: DataFrame, value: str, amounts: list[str], group: str | None = None,
                   rows_each: int = RANGE_ROWS) -> DataFrame:
    """Add ``<amount>_before``: the total of ``amount`` over the smaller values (of the same group).

    ``df`` must hold each value (of a group) once, so callers first aggregate to distinct values. Totals are taken
    within ranges of values, and the totals of the ranges before are added.
    """
    keys = [group] if group else []
    placed = in_ranges(df, [*keys, value], rows_each)
    sums = placed.groupBy(*keys, "_range").agg(*[F.sum(a).alias(a) for a in amounts])
    offsets = _totals_before(sums, "_range", amounts, Window.partitionBy(*keys), "_offset").drop(*amounts)
    inside = _totals_before(placed, value, amounts, Window.partitionBy(*keys, "_range"), "_before")
    joined = inside.join(offsets, [*keys, "_range"])
    return joined.select(*df.columns, *[(F.col(f"{a}_before") + F.col(f"{a}_offset")).alias(f"{a}_before") for a in amounts])


def _totals_before(df: DataFrame, value: str, amounts: list[str], window, suffix: str) -> DataFrame:
    earlier = window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return df.select("*", *[F.coalesce(F.sum(a).over(earlier), F.lit(0)).alias(a + suffix) for a in amounts])


def time_levels(time: str, key: str) -> list[Column]:
    """Sort levels for (time, integer key): day, second of the day, exact time, then the key by parts."""
    t = F.col(time)
    second = F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    return [F.to_date(t), second, t, *key_levels(key)]


def key_levels(key: str) -> list[Column]:
    """Sort levels for an integer key: 16 bits at a time, most significant first."""
    return [F.shiftright(F.col(key), bits) for bits in (48, 32, 16, 0)]


def nth_keys(df: DataFrame, order: list[str], levels: list[Column], positions: list[int]) -> dict[int, tuple | None]:
    """The rows' keys at the given 0-based positions in ascending order of ``order``, NULLs last.

    Works by elimination: count rows per value of the first level, keep the value that holds the position, and go
    on inside it with the next level. The levels must order rows as ``order`` does, coarse to fine, down to the
    whole key; each then has few distinct values within one value of the level before. Only counts are shuffled,
    all positions share one job per level, and the driver sees one row per position.
    """
    total = df.count()
    found: dict[int, tuple | None] = {p: None for p in positions if not 0 <= p < total}
    names = [f"_level{i}" for i in range(len(levels))]
    leveled = df.select(*order, *[level.alias(name) for name, level in zip(names, levels)])
    # the place of a position: values of the levels so far, and the rows sorted before them
    places = {p: ((), 0) for p in sorted(set(positions) - set(found))}
    for i in range(len(levels)):
        if not places:
            return found
        scope = leveled.where(_any([_matches(names, values) for values, _ in places.values()]))
        counts = scope.groupBy(*names[:i + 1]).agg(F.count(F.lit(1)).alias("n"))
        ends = F.sum("n").over(Window.partitionBy(*names[:i]).orderBy(F.col(names[i]).asc_nulls_last()))
        spans = counts.withColumn("end", ends)
        holds = {p: _matches(names, values) & (F.col("end") + before > p) & (F.col("end") - F.col("n") + before <= p)
                 for p, (values, before) in places.items()}
        rows = spans.where(_any(list(holds.values()))).collect()
        for p, (values, before) in places.items():
            row = next(r for r in rows if tuple(r[:i]) == values and before + r["end"] - r["n"] <= p < before + r["end"])
            places[p] = tuple(row[:i + 1]), before + row["end"] - row["n"]
    for p, (values, _) in places.items():
        found[p] = tuple(leveled.where(_matches(names, values)).select(*order).first())
    return found


def _matches(names: list[str], values: tuple) -> Column:
    result = F.lit(True)
    for name, value in zip(names, values):
        result = result & F.col(name).eqNullSafe(_literal(value))
    return result


def _literal(value) -> Column:
    """A literal of a collected value; date-times stay without a zone."""
    if isinstance(value, datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def _any(conditions: list[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def at_most(order: list[str], key: tuple) -> Column:
    """Row key <= ``key`` in lexicographic order, NULLs last."""
    head, value = F.col(order[0]), _literal(key[0])
    less = head.isNotNull() if key[0] is None else F.coalesce(head < value, F.lit(False))
    equal = head.eqNullSafe(value)
    return less | equal if len(order) == 1 else less | (equal & at_most(order[1:], key[1:]))
