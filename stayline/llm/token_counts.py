"""Token counts of documents from the counts of their distinct pre-tokens.

A pre-token is a maximal run without ASCII white space: this vocabulary's tokenizer drops white space and never
joins over it, so the pieces of a text are those of its pre-tokens. The library counts each distinct pre-token
once; the counts are joined to the pre-token frequencies of each document and summed. No ids are kept.

The commonest ``HEAD`` pre-tokens (a fixed number, so their table has a proven size) are broadcast; they cover
most of the words and would be the hot keys of a join. The others are joined by a shuffle on the pre-token.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stayline.llm.common import as_text, materialize, numbered, per_worker, small_batches, utf8

HEAD = 100_000
LONGEST = 256
FLUSH = 400_000
VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048


def distinct_words(texts: DataFrame, lower: bool = False, flush: int = FLUSH) -> DataFrame:
    """word (binary), n: how often each distinct word occurs in the column ``text``.

    Words are counted in each task first and passed on when a task holds ``flush`` of them.
    """
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()
        for batch in batches:
            for part in small_batches(batch):
                for text in part.column(0).to_pylist():
                    raw = utf8(text)
                    totals.update((raw.lower() if lower else raw).split())
                    if len(totals) > flush:
                        yield from _counted(totals, schema)
                        totals = Counter()
        yield from _counted(totals, schema)

    return texts.select("text").mapInArrow(task, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(totals: Counter, schema: pa.Schema, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    keys = sorted(totals)
    for start in range(0, len(keys), rows):
        some = keys[start:start + rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.binary()), pa.array([totals[k] for k in some], pa.int64())], schema=schema)


def word_pieces(words: DataFrame, path: str) -> DataFrame:
    """word, n, pieces: the library's number of tokens of each word."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("pieces", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = per_worker(("tokenizer", path), lambda: Tokenizer.from_file(path)).encode_batch_fast
        for batch in batches:
            for part in small_batches(batch, 1 << 20):
                found = encode([as_text(w) for w in part.column(0).to_pylist()], add_special_tokens=False)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(e) for e in found], pa.int64())], schema=schema)

    return words.select("word", "n").mapInArrow(task, "word binary, n long, pieces long")


def head_of(words: DataFrame, value: str, size: int = HEAD) -> dict:
    """Up to ``size`` of the commonest words with their value: the part that is broadcast, of a fixed size.

    A histogram of frequencies, in steps of a few per cent, gives the frequency from which at most ``size`` words are;
    only those come to the driver. Words of over ``LONGEST`` bytes never belong to it, so it holds at most ``size``
    times ``LONGEST`` bytes. The dict is in falling order of frequency.
    """
    short = words.where(F.length("word") <= LONGEST)
    step = F.floor(F.log2("n") * 16)
    found, least = 0, None
    for bucket, n in sorted(short.groupBy(step).count().collect(), reverse=True):
        if found + n > size:
            break
        found, least = found + n, bucket
    if least is None:
        return {}
    rows = short.where(step >= least).select("word", "n", value).collect()
    return {bytes(r[0]): r[2] for r in sorted(rows, key=lambda r: (-r[1], bytes(r[0])))}


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text).

    NULL and empty texts have 0 bytes and tokens. Repeated rows and ids are counted each; other columns aren't
    looked at; an empty table gives an empty result. Special tokens' strings inside a text count as the library
    counts them by default (they hold no white space, so they stay within one pre-token).
    """
    spark, path = docs.sparkSession, public_tokenizers.path(vocabulary)
    texts = docs.select("doc_id", "text")
    pieces = materialize(word_pieces(distinct_words(texts), path), "pieces")
    known = spark.sparkContext.broadcast(head_of(pieces, "pieces", head))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = known.value
        for batch in batches:
            for part in small_batches(batch):
                out: dict[str, list] = {c: [] for c in ("n_bytes", "head_tokens", "rest")}
                for text in part.column(1).to_pylist():
                    raw = utf8(text)
                    n, rest = 0, {}
                    for word, times in Counter(raw.split()).items():
                        have = value.get(word)
                        if have is None:
                            rest[word] = times
                        else:
                            n += have * times
                    out["n_bytes"].append(len(raw))
                    out["head_tokens"].append(n)
                    out["rest"].append(list(rest.items()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(out["n_bytes"], pa.int64()), pa.array(out["head_tokens"], pa.int64()),
                     pa.array(out["rest"], pa.map_(pa.binary(), pa.int64()))],
                    names=["doc_id", "n_bytes", "head_tokens", "rest"])

    counted = numbered(texts.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        task, "doc_id long, n_bytes long, head_tokens long, rest map<binary, bigint>"), "counted")
    rest = counted.select("_row", F.explode("rest").alias("word", "times"))
    sums = (
        rest.join(pieces.select("word", "pieces"), "word")
        .groupBy("_row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    )
    n = F.col("head_tokens") + F.coalesce("more", F.lit(0))
    return counted.select("_row", "doc_id", "n_bytes", "head_tokens").join(sums, "_row", "left").select(
        "doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
