"""Words by language: counts, and bitmaps of fixed size that tell tasks which words may matter."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import small_batches, utf8

BITMAP_BITS = 1 << 27
BLOCK_BITS = 1 << 16
FLUSH = 400_000


def code(lang: str, word: bytes) -> int:
    """What Spark's xxhash64(lang, word) gives, unsigned."""
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(utf8(lang), 42))


def is_set(bitmap: np.ndarray, own: int) -> bool:
    bit = own % (len(bitmap) * 8)
    return bool(bitmap[bit >> 3] >> (bit & 7) & 1)


def word_counts(texts: DataFrame, words_of: Callable[[str | None], Iterable[bytes]], flush: int = FLUSH) -> DataFrame:
    """lang, word (binary), n: how often ``words_of`` gives each word, over the rows of ``texts`` (lang, text).

    Words are counted in each task first and passed on when a task holds ``flush`` of them.
    """
    names = ["lang", "word", "n"]

    def rows(totals: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, words in totals.items():
            keys = list(words)
            for at in range(0, len(keys), 50_000):
                some = keys[at:at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()),
                     pa.array([words[k] for k in some], pa.int64())], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, Counter] = {}
        for batch in batches:
            for part in small_batches(batch):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    totals.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, totals.values())) > flush:
                    yield from rows(totals)
                    totals = {}
        yield from rows(totals)

    return texts.select("lang", "text").mapInArrow(task, "lang string, word binary, n long").groupBy(
        "lang", "word").agg(F.sum("n").alias("n"))


def word_bitmap(words: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """One bit per code of ``words`` (lang, word): ``bits`` / 8 bytes, packed by tasks and only then collected."""
    width = min(BLOCK_BITS, bits)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in batch.column(0).to_pylist():
                held.setdefault(at // width, np.zeros(width // 8, np.uint8))[at % width // 8] |= 1 << at % 8
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), pa.array([b.tobytes() for b in held.values()], pa.binary())],
            names=["block", "bits"])

    at = words.select(F.pmod(F.xxhash64("lang", "word"), F.lit(bits)).alias("at"))
    packed = at.repartition((F.col("at") / width).cast("long")).mapInArrow(task, "block long, bits binary")
    bitmap = np.zeros(bits // 8, np.uint8)
    for block, some in packed.toLocalIterator():
        bitmap[block * (width // 8):(block + 1) * (width // 8)] |= np.frombuffer(some, np.uint8)
    return bitmap
