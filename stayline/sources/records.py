"""Records of CSV files that are read in splits although quoted values may hold line breaks.

Spark reads such files whole, one task each. Here they are read as lines, in splits. Whether a line begins a record follows from
the number of quotes before it in its file: a line break lies within a value where that number is odd (a quote within a
value is doubled, which leaves the parity as it is).

1. One pass counts the quotes of every block, the part of a file that a split covers, and keeps each file's first line.
2. A running sum over the blocks of a file, one row per block, gives the parity with which each block begins.
3. A second pass joins the lines of records within their blocks. Only pieces that reach over the edge of a block,
   at most two per block, are brought together by a shuffle.

Records then go to Spark's parser as they are.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stayline.session import materialize

QUOTE = '"'


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file (hash of its path), block (first byte of the split), line (without line feed); in order within a block.

    All passes must see the same splits. Spark cuts them by the number of cores of the moment, unless told a number: the
    session keeps the first one.
    """
    least = "spark.sql.files.minPartitionNum"
    if spark.conf.get(least, None) is None:
        spark.conf.set(least, str(spark.sparkContext.defaultParallelism))
    raw = spark.read.text(path, lineSep="\n")
    return raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.col("value").alias("line"))


def block_table(rows: DataFrame) -> DataFrame:
    """file, block, odd, first: whether the quotes before a block are odd in number, and the file's first line.

    One row per block, some 128 MB of text, so the table is a millionth of the input.
    """
    quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit(QUOTE), F.lit("")))
    placed = rows.withColumns({"quotes": quotes, "place": F.monotonically_increasing_id()})
    blocks = materialize(placed.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"), F.min_by("line", "place").alias("line")), "blocks")
    before = Window.partitionBy("file").orderBy("block")
    return blocks.select(
        "file", "block", (F.coalesce(F.sum("quotes").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1)
        .alias("odd"), F.first("line").over(before).alias("first"))


def first_lines(rows: DataFrame) -> DataFrame:
    """file, block, odd, first like ``block_table`` for files without quoted line breaks.

    A task stops after the first lines of its split. So that it has no second file whose first line it would miss, splits
    aren't packed together.
    """
    spark = rows.sparkSession
    cost, size = "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(cost)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                if batch.column(1)[0].as_py() == 0:
                    yield batch.slice(0, 1)
                return

    spark.conf.set(cost, spark.conf.get(size))
    try:
        found = materialize(rows.select("file", "block", "line").mapInArrow(task, "file long, block long, line string"), "first-lines")
    finally:
        spark.conf.set(cost, usual)
    return found.select("file", F.lit(None).cast("long").alias("block"), F.lit(False).alias("odd"), F.col("line").alias("first"))


PIECES = "file long, block long, number long, opens boolean, closes boolean, record string"


def joined_lines(rows: DataFrame, blocks: DataFrame, how: str = "left") -> DataFrame:
    """Pieces of records: ``opens`` where a piece holds its record's first line, ``closes`` where it holds the last.

    A line of an unknown block is an error, so that no line can get lost.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, odd, number, held = None, False, 0, []
        for batch in batches:
            places = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            edges = [0, *[i for i in range(1, len(places)) if places[i] != places[i - 1]], len(places)]
            for start, end in zip(edges, edges[1:], strict=False):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if places[start] != at:
                    if held:
                        yield piece(at, number, began, False, held)
                    at, odd, number, held = places[start], part.column(3)[0].as_py(), 0, []
                    began = not odd
                quotes = np.asarray(pc.count_substring(part.column(2), QUOTE)) % 2
                after = (np.cumsum(quotes) + odd) % 2
                before = np.concatenate([[int(odd)], after[:-1]])
                whole = np.flatnonzero((before == 0) & (after == 0))
                if len(whole):
                    n = len(whole)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(whole)), part.column(1).take(pa.array(whole)), pa.array(number + whole),
                         pa.array(np.ones(n, bool)), pa.array(np.ones(n, bool)), part.column(2).take(pa.array(whole))], names=names)
                others = np.flatnonzero((before == 1) | (after == 1))
                for i, line in zip(others.tolist(), part.column(2).take(pa.array(others)).to_pylist(), strict=True):
                    if before[i] == 0:
                        began = True
                    held.append(line)
                    if after[i] == 0:
                        yield piece(at, number + i, began, True, held)
                        held = []
                odd, number = bool(after[-1]), number + len(after)
        if held:
            yield piece(at, number, began, False, held)

    names = ["file", "block", "number", "opens", "closes", "record"]

    def piece(at: tuple[int, int], number: int, opens: bool, closes: bool, held: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([at[0]]), pa.array([at[1]]), pa.array([number]), pa.array([opens]), pa.array([closes]),
             pa.array(["\n".join(held)])], names=names)

    odd = F.coalesce("odd", F.raise_error(F.lit("the splits of the files have changed")).cast("boolean"))
    return rows.join(F.broadcast(blocks.select("file", "block", "odd")), ["file", "block"], how).select(
        "file", "block", "line", odd.alias("odd")).mapInArrow(task, PIECES)


def whole_records(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """file, record of ``lines``. A quote that is never closed makes one record of the rest of its file.

    Files in which no block begins within a value have no pieces to join; the lines of the others are read again for theirs.
    """
    whole = F.col("opens") & F.col("closes")
    pieces = joined_lines(rows, blocks)
    cut = blocks.groupBy("file").agg(F.max("odd").alias("cut"))
    if not cut.where("cut").count():
        return pieces.select("file", "record")
    edges = joined_lines(rows, blocks.join(cut.where("cut"), "file", "left_semi"), "inner").where(~whole)
    order = Window.partitionBy("file").orderBy("block", "number")
    started = F.sum(F.col("opens").cast("int")).over(order)
    stitched = edges.withColumn("start", started).groupBy("file", "start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "number", "record"))), lambda p: p["record"]), "\n")
        .alias("record")).select("file", "record")
    return pieces.where(whole).select("file", "record").unionByName(stitched)


def parsed(records: DataFrame, firsts: DataFrame, wanted: list[str]) -> DataFrame:
    """The columns of ``wanted`` that any file has, as text, by the header of each record's file.

    ``records``: file, record; ``firsts``: file, first line. Header lines, empty lines and files without a header are left out.
    Different headers come to the driver, not files. A file's header number is broadcast: some bytes per file.
    """
    headers = [r[0] for r in firsts.select(clean("first").alias("header")).where("header <> ''").distinct().orderBy("header").collect()]
    if not headers:
        raise ValueError("no file has a header")
    names = [next(csv.reader([h.removeprefix("\ufeff")])) for h in headers]
    present = [c for c in wanted if any(c in n for n in names)]
    width = max(map(len, names))
    number = F.array_position(F.array(*map(F.lit, headers)), clean("first")) - 1
    of_file = firsts.select("file", number.cast("int").alias("header"), clean("first").alias("first")).distinct()
    fields = F.from_csv(clean("record"), ", ".join(f"c{i} string" for i in range(width)), {"escape": QUOTE})
    # a generator runs once a row; a plain column is computed again in every filter that Spark moves below it
    rows = records.join(F.broadcast(of_file), "file").where(
        (F.col("header") >= 0) & (clean("record") != "") & (clean("record") != F.col("first"))).select(
        "header", F.inline(F.array(fields)))

    def value(name: str):
        places: dict[int, list[int]] = {}
        for k, n in enumerate(names):
            if name in n:
                places.setdefault(n.index(name), []).append(k)
        cases = [(F.col("header").isin(ks), F.col(f"c{i}")) for i, ks in places.items()]
        if len(cases) == 1 and len(next(iter(places.values()))) == len(names):
            return cases[0][1]
        return reduce(lambda c, case: c.when(*case), cases[1:], F.when(*cases[0]))

    return rows.select(*[value(c).alias(c) for c in present])


def clean(column: str):
    """A line without the carriage return that ends it; few lines have any, and a search costs less than a pattern."""
    return F.when(F.contains(F.col(column), F.lit("\r")), F.regexp_replace(column, "\r$", "")).otherwise(F.col(column))


def read_records(spark: SparkSession, path: str, wanted: list[str], one_line: bool) -> DataFrame:
    """The columns in ``wanted`` of all CSV files at ``path``; ``one_line``: no value holds a line break.

    Headers are single lines. A record equal to its file's header is taken for one.
    """
    rows = lines(spark, path)
    if one_line:
        return parsed(rows.select("file", F.col("line").alias("record")), first_lines(rows).select("file", "first"), wanted)
    blocks = materialize(block_table(rows), "block-table")
    return parsed(whole_records(rows, blocks), blocks.select("file", "first"), wanted)
