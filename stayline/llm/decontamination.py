"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive tokens: hashes of the kept places are compared, so a substituted token at
an ignored place doesn't matter. Around every seed that a document shares with a benchmark item, the tokens are
compared along the same diagonal, and the best overlap that tolerates substitutions is measured.

1. Both sides are cut into tokens (lower case, ASCII punctuation removed, split at white space), hashed to 64 bits.
2. The benchmark's seed hashes set bits in a bitmap of fixed size (``BITMAP_BITS``), which is broadcast: its size
   doesn't depend on the benchmark. Documents' seeds that meet no set bit can't match and go no further.
3. The others are *joined* to the benchmark's seeds by hash. A document carries only stretches of tokens around
   them, to each side as many as the longest item has.
4. Each pair of stretch and item is verified on all diagonals with a shared seed.

An overlap begins at a seed and is extended both ways, +1 per equal token and -``PENALTY`` per other, until the
score has fallen ``DROP`` below its best or an end is reached; it counts if it holds ``least`` equal tokens, or all of an item's,
if those are fewer. Items of fewer tokens than the shortest mask spans have a single seed, all their tokens in a row; they
are found where those occur unchanged. Items are equal if their tokens are, whatever their ids.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import Cache, keeps_columns, materialize, numbered, per_worker, small_batches

#: Kept places of each mask (fixed values).
MASKS = ((0, 1, 3, 4, 6, 7), (0, 1, 2, 5, 7, 8), (0, 2, 3, 4, 8, 9), (0, 1, 2, 3, 4, 5))
SPANS = tuple(m[-1] + 1 for m in MASKS)
LEAST = 13
PENALTY, DROP = 2, 6
BITMAP_BITS = 1 << 27
WORDS_CACHED = 300_000

_PUNCTUATION = bytes.maketrans(b"", b"")
_REMOVED = string.punctuation.encode()


def tokens_of(text: str | None) -> list[bytes]:
    if not text:
        return []
    return text.lower().encode("utf-8", "surrogatepass").translate(_PUNCTUATION, _REMOVED).split()


def _word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def token_hashes(text: str | None) -> np.ndarray:
    cache = per_worker("token hashes", lambda: Cache(_word_hash, WORDS_CACHED))
    words = tokens_of(text)
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


#: Masks of items that are shorter than all of the above, by their number of tokens.
SHORT = {n: tuple(range(n)) for n in range(1, min(SPANS))}


def seeds(tokens: np.ndarray, mask: int) -> np.ndarray:
    """Hash of each place of mask number ``mask``; short items of n tokens have the mask numbered -n."""
    kept = MASKS[mask] if mask >= 0 else SHORT[-mask]
    n = len(tokens) - kept[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, (mask + 1) % (1 << 64), np.uint64)
    for place in kept:
        total = (total ^ tokens[place:place + n]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """key, item (smallest item_id of equal token sequences, NULL if none has one), tokens (binary), n_tokens."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                found = [token_hashes(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([t.tobytes() for t in found], pa.binary()),
                     pa.array([len(t) for t in found], pa.int64())], names=["item_id", "tokens", "n_tokens"])

    rows = benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(
        task, "item_id long, tokens binary, n_tokens long")
    return numbered(rows.where("n_tokens > 0").groupBy("tokens", "n_tokens").agg(F.min("item_id").alias("item")), "items", "key")


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """seed, key, at: every seed of every item."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = np.frombuffer(raw, np.uint64)
                for m in range(len(MASKS)) if len(tokens) >= min(SPANS) else [-len(tokens)]:
                    found = seeds(tokens, m)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.view(np.int64)), pa.array([key] * len(found), pa.int64()),
                         pa.array(np.arange(len(found)))], names=["seed", "key", "at"])

    return items.select("key", "tokens").mapInArrow(task, "seed long, key long, at long")


def seed_bitmap(found: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bits of all seeds; the driver gets 64-bit words that aren't zero, ``bits`` / 64 at most."""
    bit = F.pmod("seed", F.lit(bits))
    words = found.select(F.floor(bit / 64).alias("word"), F.expr("shiftleft(1L, cast(pmod(seed, 64) AS int))").alias(
        "bit")).groupBy("word").agg(F.bit_or("bit").alias("mask"))
    bitmap = np.zeros(bits // 64, np.int64)
    for word, mask in words.collect():
        bitmap[word] = mask
    return bitmap.view(np.uint8)


def stretches(docs: DataFrame, bitmap: np.ndarray, reach: int, short: list[int]) -> DataFrame:
    """doc_id, text_hash, tokens (binary), hits (seed, at): the stretches of each document that may match.

    ``reach``: tokens of the longest item; ``short``: lengths of items that are shorter than the masks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, size = shared.value, np.uint64(len(shared.value) * 8 - 1)
        for batch in batches:
            for part in small_batches(batch):
                out: dict[str, list] = {c: [] for c in ("row", "tokens", "seed", "at")}
                for row, text in enumerate(part.column(2).to_pylist()):
                    tokens = token_hashes(text)
                    where, what = [], []
                    for m in [*range(len(MASKS)), *[-n for n in short]]:
                        found = seeds(tokens, m)
                        bit = found & size
                        set_ = (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
                        hit = np.flatnonzero(set_)
                        if m < 0:  # one place of each short item will do
                            hit = np.sort(hit[np.unique(found[hit], return_index=True)[1]])
                        where.append(hit)
                        what.append(found[hit])
                    at, seed = np.concatenate(where), np.concatenate(what).view(np.int64)
                    if not len(at):
                        continue
                    order = np.argsort(at, kind="stable")
                    at, seed = at[order], seed[order]
                    cut = np.flatnonzero(np.diff(at) > 2 * reach + max(SPANS)) + 1
                    for hits, values in zip(np.split(at, cut), np.split(seed, cut), strict=True):
                        first = max(0, int(hits[0]) - reach)
                        out["row"].append(row)
                        out["tokens"].append(tokens[first:int(hits[-1]) + max(SPANS) + reach].tobytes())
                        out["seed"].append(values.tolist())
                        out["at"].append((hits - first).tolist())
                rows = pa.array(out["row"], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(out["tokens"], pa.binary()),
                     pa.array(out["seed"], pa.list_(pa.int64())), pa.array(out["at"], pa.list_(pa.int64()))],
                    names=["doc_id", "text_hash", "tokens", "seed", "at"])

    return docs.mapInArrow(
        task, "doc_id long, text_hash long, tokens binary, seed array<bigint>, at array<bigint>")


def extend(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """Equal and other tokens of the best overlap of ``a`` and ``b`` around a seed at ``a[i]``, ``b[j]``."""
    def one_way(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
        n = min(len(x), len(y))
        same = x[:n] == y[:n]
        score = np.cumsum(np.where(same, 1, -PENALTY))
        below = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score >= DROP)
        score = score[:below[0]] if len(below) else score
        if not len(score) or score.max() <= 0:
            return 0, 0
        end = int(np.argmax(score)) + 1
        return int(same[:end].sum()), int(end - same[:end].sum())

    right, left = one_way(a[i:], b[j:]), one_way(a[:i][::-1], b[:j][::-1])
    return right[0] + left[0], right[1] + left[1]


def verified(pairs: DataFrame, least: int) -> DataFrame:
    """doc_id, text_hash, key, item, equal, other: the best overlap of each stretch (tokens) and item (item_tokens)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                row, n_equal, n_other = [], [], []
                columns = [part.column(c).to_pylist() for c in range(4, 8)]
                for k, (raw, item_raw, at, item_at) in enumerate(zip(*columns, strict=True)):
                    tokens, item = np.frombuffer(raw, np.uint64), np.frombuffer(item_raw, np.uint64)
                    found = {extend(tokens, item, i, j) for i, j in set(zip(at, item_at, strict=True))}
                    equal, other = max(found, key=lambda f: (f[0], -f[1]))
                    if equal >= min(least, len(item)):
                        row.append(k)
                        n_equal.append(equal)
                        n_other.append(other)
                rows = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(rows) for c in range(4)], pa.array(n_equal, pa.int64()),
                     pa.array(n_other, pa.int64())], names=["doc_id", "text_hash", "key", "item", "equal", "other"])

    return pairs.mapInArrow(task, "doc_id long, text_hash long, key long, item long, equal long, other long")


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text_hash, key, item, equal, other: every document and benchmark item that overlap enough.

    Equal benchmark items are one, with a key of its own, named by the smallest id; rows that agree in doc_id and text are one document.
    """
    items = benchmark_items(benchmark)
    sizes = items.agg(F.max("n_tokens"), F.collect_set(F.when(F.col("n_tokens") < min(SPANS), F.col("n_tokens")))).first()
    reach, short = sizes[0] or 0, sorted(sizes[1])
    item_seeds = materialize(benchmark_seeds(items), "seeds")
    found = numbered(stretches(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text"),
                               seed_bitmap(item_seeds), reach, short), "stretches")
    hits = found.select("_row", F.explode(F.arrays_zip("seed", "at")).alias("hit")).select(
        "_row", "hit.seed", F.col("hit.at").alias("at"))
    shared = hits.join(item_seeds.withColumnRenamed("at", "item_at"), "seed")
    # along one diagonal a run of seeds is one place: only the first of each run of near seeds is extended
    diagonals = shared.groupBy("_row", "key", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.array_sort(F.collect_set("at")).alias("ats"))
    starts = F.filter("ats", lambda x, i: (i == 0) | (x - F.get("ats", i - 1) > 1))
    places = diagonals.select("_row", "key", F.explode(starts).alias("at"), "shift").groupBy("_row", "key").agg(
        F.collect_list(F.struct("at", (F.col("at") - F.col("shift")).alias("item_at"))).alias("places"))
    pairs = (
        places.join(found.select("_row", "doc_id", "text_hash", "tokens"), "_row")
        .join(items.select("key", "item", F.col("tokens").alias("item_tokens")), "key")
        .select("doc_id", "text_hash", "key", "item", "tokens", "item_tokens", "places.at", "places.item_at")
    )
    return verified(pairs, least).groupBy("doc_id", "text_hash", "key", "item").agg(
        F.max(F.struct("equal", (-F.col("other")).alias("other"))).alias("best")).select(
        "doc_id", "text_hash", "key", "item", "best.equal", (-F.col("best.other")).alias("other"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, contaminated, n_items, item, equal, other for every row of ``docs`` (doc_id, text).

    n_items counts the benchmark items that the document overlaps; item, equal and other tell of the one with the
    most equal tokens (ties: fewest others, smallest item, items without an id last), NULL and 0 if there is none. Items of the
    same tokens are one; items without an id are found and have item NULL; different texts of one id are items of their own. NULL
    and empty texts are clean; item texts that are NULL or have no token are no items; other columns aren't looked at; an empty
    benchmark or table gives clean rows or none.
    """
    best = F.max(F.struct("equal", (-F.col("other")).alias("other"), F.col("item").isNotNull().alias("known"), (-F.col("item")).alias("item")))
    found = overlaps(docs, benchmark, least).groupBy("doc_id", "text_hash").agg(
        F.count("*").alias("n"), best.alias("best"))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash")).alias("d")
    joined = rows.join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))
                       & (F.col("d.text_hash") == F.col("f.text_hash")), "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "d.doc_id", F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", zero).alias("n_items"),
        (-F.col("best.item")).alias("item"), F.coalesce("best.equal", zero).alias("equal"),
        F.coalesce(-F.col("best.other"), zero).alias("other"))


@keeps_columns("doc_id", "text")
def clean_documents(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, with all their columns; as in ``decontaminate``."""
    found = overlaps(docs, benchmark, least).select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash")),
                     "left_anti")
