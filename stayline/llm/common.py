"""What several operators share: tables, words, row numbers, bounded caches, scratch copies.

A *word* is a maximal run of ``[^\\x20\\x09-\\x0D]``. ``bytes.split()`` splits on exactly those bytes, and
``bytes.lower()`` lowers exactly A-Z, so words are handled as UTF-8 bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.session import materialize, scratch_path

__all__ = ["materialize", "scratch_path"]

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lowered."""
    return utf8(text).lower().split()


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def remainder(doc_id: int | None, modulus: int) -> int | None:
    """crc32 of the id as text, modulo; None for no id."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def id_remainder(modulus: int, column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def word_count(column: str):
    """Number of words of a text column; NULL counts 0."""
    parts = F.split(F.coalesce(F.col(column), F.lit("")), SPACES)
    return F.size(F.filter(parts, lambda w: w != "")).cast("long")


def numbered(df: DataFrame, name: str, column: str = "_row") -> DataFrame:
    """``df`` written once with a row number; the copy fixes the numbers, whatever is computed again later."""
    return materialize(df.withColumn(column, F.monotonically_increasing_id()), name)


def keeps_columns(*needed: str) -> Callable:
    """For functions that give back rows of their first argument with all its columns.

    Within the function, columns other than ``needed`` have names that none of its own can clash with.
    """
    def decorate(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(run)
        def renamed(docs: DataFrame, *args, **kwargs) -> DataFrame:
            names = [(c, c if c in needed else f"column {i}") for i, c in enumerate(docs.columns)]
            safe = docs.toDF(*[inner for _, inner in names])
            found = run(safe, *args, **kwargs)
            return found.select(*[F.col(f"`{inner}`").alias(c) for c, inner in names])

        return renamed

    return decorate


def map_arrow(df: DataFrame, run: Callable[[dict], Iterable[dict] | dict], schema: str) -> DataFrame:
    """``mapInArrow`` with batches as dicts of Python lists, in and out; ``run`` takes one batch."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                out = run(part.to_pydict())
                for one in [out] if isinstance(out, dict) else out:
                    yield pa.RecordBatch.from_arrays(
                        [one[f.name] if isinstance(one[f.name], pa.Array) else pa.array(one[f.name], f.type)
                         for f in target], schema=target)

    return df.mapInArrow(task, schema)


def small_batches(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes, one row at least, so that long texts don't add up."""
    rows = batch.num_rows
    if rows == 0:
        return
    step = max(1, int(rows * most / max(1, batch.nbytes)))
    for start in range(0, rows, step):
        yield batch.slice(start, step)


class Cache(dict):
    """A dict that computes missing values and starts anew when full; lives as long as a Python worker."""

    def __init__(self, compute: Callable, most: int):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value


_KEPT: dict = {}


def per_worker(key, make: Callable):
    """A value made once in each Python worker: a tokenizer, a model from a broadcast.

    Only the last one is kept. Workers live on from stage to stage, and what an earlier one needed would add up.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def as_text(word: bytes) -> str:
    return word.decode("utf-8", "surrogatepass")
