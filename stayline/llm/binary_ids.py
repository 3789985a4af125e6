"""Token ids of documents in binary blocks with Elias-Fano encoded boundaries.

File format. A folder of Parquet files whose rows are *blocks*; a block holds whole documents, in ascending
doc_id order, and is closed once it holds ``BLOCK_IDS`` ids:

* ``shard``, ``block``: place of the block; blocks sorted by both hold the ids of all documents in order;
* ``n_docs``, ``n_ids``, ``n_null``: documents, ids, leading documents without a doc_id;
* ``ids``: all ids of the block, little-endian, ``width`` bytes each (2 while the vocabulary fits, else 4);
* ``ends``: Elias-Fano sequence of the documents' end offsets within ``ids``;
* ``doc_ids``: Elias-Fano sequence of the doc_ids less the first one, ``first_doc``; the last is ``last_doc``.

An Elias-Fano sequence of n values up to u takes about 2 + log2(u / n) bits each: the low bits are packed, the
high parts are a bit vector in which value i sets bit (high + i). ``EliasFano.select`` finds value i with one
sampled count of ones and a scan of a few bytes, without a table of 64-bit offsets.

Spark's writer commits the files, so they may lie on any file system it reaches, and a lost task is written anew.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stayline.llm.common import per_worker, scratch_path, small_batches

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
BLOCK_IDS = 1 << 20
CACHED = 500_000
SHARD_DOCS, MOST_SHARDS = 16_384, 100_000
SAMPLE = 256  # ones between two sampled positions of the select structure

BLOCK_SCHEMA = ("shard int, block int, n_docs int, n_ids long, n_null int, first_doc long, last_doc long, width int, ids binary, "
                "ends binary, doc_ids binary")


class EliasFano:
    """A non-decreasing sequence of unsigned integers, to and from bytes."""

    HEAD = struct.Struct("<QBQ")  # n, low bits, bytes of the high part

    def __init__(self, data: bytes):
        self.n, self.low_bits, high_bytes = self.HEAD.unpack_from(data)
        at = self.HEAD.size
        self.high = np.frombuffer(data, np.uint8, high_bytes, at)
        self.low = np.frombuffer(data, np.uint8, offset=at + high_bytes)
        ones = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)
        #: byte in which each SAMPLE-th one lies, and the ones before that byte
        self.sampled = np.searchsorted(ones, np.arange(0, self.n, SAMPLE), side="right")
        self.before = ones[self.sampled] - np.bitwise_count(self.high[self.sampled]) if self.n else ones[:0]

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n == 0:
            return cls.HEAD.pack(0, 0, 0)
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(high[-1]) + 1, np.uint8)
        bits[high] = 1
        packed = np.packbits(bits, bitorder="little").tobytes()
        low = b""
        if low_bits:
            places = np.arange(low_bits, dtype=np.uint64)
            low = np.packbits(((values[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel(),
                              bitorder="little").tobytes()
        return cls.HEAD.pack(n, low_bits, len(packed)) + packed + low

    def _low(self, first: int, last: int) -> np.ndarray:
        """Low parts of values first..last-1."""
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        from_bit, to_bit = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[from_bit // 8:(to_bit + 7) // 8], bitorder="little")
        bits = bits[from_bit % 8:from_bit % 8 + to_bit - from_bit].reshape(-1, self.low_bits)
        return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def select(self, i: int) -> int:
        """Value i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        byte, seen = int(self.sampled[i // SAMPLE]), int(self.before[i // SAMPLE])
        while seen + (ones := int(self.high[byte]).bit_count()) <= i:
            seen, byte = seen + ones, byte + 1
        rest = int(self.high[byte])
        for _ in range(i - seen):
            rest &= rest - 1
        place = byte * 8 + (rest & -rest).bit_length() - 1
        return (place - i) << self.low_bits | int(self._low(i, i + 1)[0])

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        high = (places - np.arange(self.n)).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._low(0, self.n)


class TextEncoder:
    """A byte-level tokenizer with a bounded cache of chunks.

    A chunk is a space and the run up to the next space. The vocabulary's pattern takes a single space together
    with what follows, so chunks are tokenized alone with the same ids, unless white space meets white space; a
    text with such a place goes to the library whole. New chunks of a text go to the library as one text, which
    is cut where a token begins with a space.
    """

    def __init__(self, path: str, dtype: str, cached: int = CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype(dtype)
        #: chunks since the cache was last full, and those of the filling before
        self.inner: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cached = cached
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def __call__(self, text: str) -> bytes:
        first, *chunks = text.split(" ")
        if not chunks or not first or first[-1].isspace():
            return self._encode(text).tobytes()
        try:
            known = b"".join(map(self.inner.__getitem__, chunks))
            return self.first(first) + known
        except KeyError:
            pass
        missing = [c for c in dict.fromkeys(chunks) if c not in self.inner]
        if len(self.inner) + len(missing) > self.cached:
            self.older, self.inner = self.inner, {}
            missing = list(dict.fromkeys(chunks))
        again = [c for c in missing if c in self.older]
        self.inner.update(zip(again, map(self.older.__getitem__, again), strict=True))
        missing = [c for c in missing if c not in self.inner] if again else missing
        if any(not c or c[0].isspace() or c[-1].isspace() for c in missing):
            return self._encode(text).tobytes()
        if missing:
            self._learn(missing)
        return self.first(first) + b"".join(map(self.inner.__getitem__, chunks))

    def _learn(self, chunks: list[str]) -> None:
        ids = self._encode(" " + " ".join(chunks))
        cuts = np.flatnonzero(self.spaced[ids])
        if len(cuts) != len(chunks):  # a chunk holds a token with a space of its own
            for c in chunks:
                self.inner[c] = self._encode(" " + c).tobytes()
            return
        raw, edges = ids.tobytes(), [*(cuts * self.dtype.itemsize).tolist(), len(ids) * self.dtype.itemsize]
        self.inner.update(zip(chunks, map(raw.__getitem__, map(slice, edges[:-1], edges[1:])), strict=True))

    def first(self, chunk: str) -> bytes:
        return self._encode(chunk).tobytes()


def in_shards(rows: DataFrame, shard_docs: int) -> DataFrame:
    """``rows`` (doc_id, text) in ranges of (doc_id, hash of the text), sorted within them, with the range's number as ``shard``.

    Spark samples the limits. Ranges are as many as the session's shuffle partitions or, if that is more, one for
    ``shard_docs`` documents, ``MOST_SHARDS`` at most. NULL ids come first and, like equal ids, may take several ranges.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_SHARDS, -(-rows.select("doc_id").count() // shard_docs)))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash").asc()]
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    return keyed.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").select(
        "doc_id", "text", F.spark_partition_id().alias("shard"))


def write_ids(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID,
              block_ids: int = BLOCK_IDS, shard_docs: int = SHARD_DOCS) -> None:
    """Tokenize ``docs`` (doc_id, text) and write all ids with ``end_id`` after each document to ``path``."""
    file = public_tokenizers.path(vocabulary)
    wide = Tokenizer.from_file(file).get_vocab_size(with_added_tokens=True) > 1 << 16 or end_id >= 1 << 16
    dtype, width = ("<u4", 4) if wide else ("<u2", 2)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = in_shards(rows, shard_docs)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(BLOCK_SCHEMA))
    end = np.array([end_id], dtype).tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = per_worker(("ids", file, dtype), lambda: TextEncoder(file, dtype))
        shard, block, held = None, 0, Block(width)
        for batch in batches:
            for part in small_batches(batch):
                for doc_id, text, at in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if held.doc_ids and (at != shard or held.n_ids >= block_ids):
                        yield held.row(shard, block, schema)
                        held, block = Block(width), block + 1
                    if at != shard:
                        shard, block = at, 0
                    held.add(doc_id, encode(text) + end)
        if held.doc_ids:
            yield held.row(shard, block, schema)

    ordered.mapInArrow(task, BLOCK_SCHEMA).write.parquet(path)


class Block:
    """Documents gathered for one row of the file."""

    def __init__(self, width: int):
        self.width, self.doc_ids, self.parts, self.ends, self.n_ids = width, [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.parts.append(ids)
        self.n_ids += len(ids) // self.width
        self.ends.append(self.n_ids)

    def row(self, shard: int, block: int, schema: pa.Schema) -> pa.RecordBatch:
        known = [d for d in self.doc_ids if d is not None]
        first = known[0] if known else 0
        values = dict(
            shard=shard, block=block, n_docs=len(self.ends), n_ids=self.n_ids, n_null=len(self.doc_ids) - len(known),
            first_doc=first, last_doc=known[-1] if known else 0, width=self.width, ids=b"".join(self.parts), ends=EliasFano.encode(np.array(self.ends)),
            doc_ids=EliasFano.encode(np.array([d - first for d in known], np.uint64)))
        return pa.RecordBatch.from_arrays([pa.array([values[f.name]], f.type) for f in schema], schema=schema)


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """shard, block, base: the number of ids before each block.

    Sums per shard first; only one row per shard meets in the window that adds them up.
    """
    sizes = spark.read.parquet(path).select("shard", "block", "n_ids")
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(
            Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return sizes.join(shards.select("shard", "before"), "shard").select(
        "shard", "block", (F.col("before") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("base"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files at ``path``."""
    blocks = spark.read.parquet(path)
    names = ["shard", "block", "doc_id", "first", "n_tokens", "ids_crc32"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                number = {k: row[k].as_py() for k in ("shard", "block", "n_null", "first_doc", "width")}
                ids = np.frombuffer(row["ids"].as_buffer(), f"<u{number['width']}")
                ends = EliasFano(row["ends"].as_py()).all().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                docs = EliasFano(row["doc_ids"].as_py()).all().astype(np.int64) + number["first_doc"]
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ends), number["shard"], np.int32)),
                    pa.array(np.full(len(ends), number["block"], np.int32)),
                    pa.array([None] * number["n_null"] + docs.tolist(), pa.int64()),
                    pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())], names=names)

    found = blocks.select("shard", "block", "ids", "ends", "doc_ids", "n_null", "first_doc", "width").mapInArrow(
        task, "shard int, block int, doc_id long, first long, n_tokens long, ids_crc32 long")
    return found.join(block_starts(spark, path), ["shard", "block"]).select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def document_ids(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the document(s) with one doc_id, by select on the boundaries of the blocks that may hold it."""
    blocks = spark.read.parquet(path).where(
        (F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id) & (F.col("n_docs") > F.col("n_null")))
    found = []
    for row in blocks.orderBy("shard", "block").toLocalIterator():
        docs, ends = EliasFano(bytes(row.doc_ids)).all(), EliasFano(bytes(row.ends))
        ids = np.frombuffer(row.ids, f"<u{row.width}")
        for i in np.flatnonzero(docs == doc_id - row.first_doc) + row.n_null:
            start = ends.select(int(i) - 1) if i else 0
            found.append(ids[start:ends.select(int(i))].tolist())
    return found


def token_id_table(docs: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Write ``docs`` (doc_id, text) in the file format and return what is read back, one row per document.

    Order: doc_id ascending, NULL first, equal ids by a hash of the text. NULL and empty texts hold the end id alone. Repeated
    rows are written each; other columns aren't looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-ids")
    write_ids(docs, path, **how)
    return read_documents(spark, path)
