"""Nearest neighbours by cosine from randomly rotated one-bit codes with error bounds.

*Index*: each vector is scaled to length 1, rotated by a random orthogonal matrix and kept as the signs of its
coordinates, packed, plus one scalar: the inner product of the vector with its code. Blocks of ``BLOCK`` vectors
are rows of a table with their ids, codes, scalars and the original vectors. All rows are indexed; the rotation
depends on the dimension and the seed alone, so nothing is fitted.

*Search*: for a rotated unit query q, a code x (signs / sqrt(d)) and a vector o, with ``s = <x, o>``,
``<x, q> / s`` estimates ``<o, q>``. What it leaves out is the part of q orthogonal to o, seen through x:
``|<o, q> - <x, q> / s| <= sqrt(1 - <o, q>^2) * sqrt(1 - s^2) / s``, which is certain but wide; for a random
rotation that part is spread over d - 1 directions, so ``EPSILON / sqrt(d - 1)`` times it holds with a
probability that falls like a normal tail. A block's candidates for a query are those whose upper bound reaches
the k-th best lower bound of the block's rows with other ids; they are scored exactly, on the original vectors. Each query keeps k rows per
task, the partial results are merged, and ties go to the smaller id.

Queries are searched in rounds of ``ROUND``, each broadcast (of a fixed size), against all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayline.llm.common import materialize, scratch_path

BLOCK = 2048
ROUND = 4096
CHUNK = 256
EPSILON = 1.9
SEED = 7
INDEX_SCHEMA = "dim int, n int, ids binary, vectors binary, codes binary, scalars binary"
RESULT_SCHEMA = "query_id long, vec_id long, score double"


@cache
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(df: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of rows whose vector is neither NULL, empty or zero nor holds NULL, NaN, infinity.

    Rows without vec_id take no part either.
    """
    vectors = df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & sound & F.exists("embedding", lambda x: x != 0))


def by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of each length of vectors in a batch of (vec_id, embedding)."""
    ids, lists = batch.column(0).to_numpy(), batch.column(1)
    lengths = lists.value_lengths().to_numpy()
    flat, starts = lists.values.to_numpy(), lists.offsets.to_numpy()[:-1]
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield ids[at], flat[starts[at][:, None] + np.arange(dim)]


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)  # else squares may over- or underflow
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs and scalars of the rotated unit vectors."""
    turned = unit(vectors) @ turn
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(1) / np.sqrt(vectors.shape[1])


def index(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of codes of all usable rows of ``df`` (vec_id, embedding)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors in by_dimension(batch):
                dim = vectors.shape[1]
                turn = rotation(dim)
                for start in range(0, len(ids), block):
                    some = vectors[start:start + block]
                    codes, scalars = encode(some, turn)
                    row = (some.shape[1], len(some), ids[start:start + block].tobytes(), some.tobytes(),
                           codes.tobytes(), scalars.tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.int32()] + [pa.binary()] * 4, strict=True)],
                        names=["dim", "n", "ids", "vectors", "codes", "scalars"])

    return materialize(usable(df).mapInArrow(task, INDEX_SCHEMA), "codes")


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision, summed in order of the components.

    Where squares leave the range of doubles, both vectors are scaled by their largest component first.
    """
    with np.errstate(all="ignore"):
        dot, own, other = np.zeros(len(vectors)), np.zeros(len(vectors)), 0.0
        for j in range(vectors.shape[1]):
            x = vectors[:, j]
            dot += x * query[j]
            own += x * x
            other += query[j] * query[j]
        square = own * other
        found = np.clip(dot / np.sqrt(square), -1.0, 1.0)
    odd = ~((square > 1e-290) & (square < 1e290))
    if odd.any():
        found[odd] = np.clip(unit(vectors[odd]) @ unit(query[None])[0], -1.0, 1.0)
    return found


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search_block(queries, query_ids, turned, vectors, ids, signs, scalars, k: int, epsilon: float):
    """(query number, ids, scores) of the best of one block for each query, by bounds and reranking."""
    dim = vectors.shape[1]
    estimate = (turned @ signs.T) / (np.sqrt(dim) * scalars)
    spread = np.sqrt(np.maximum(0.0, 1 - scalars**2)) / scalars * min(1.0, epsilon / np.sqrt(max(1, dim - 1)))
    rest = np.sqrt(np.maximum(0.0, 1 - np.minimum(1.0, np.maximum(0.0, np.abs(estimate) - spread))**2))
    error = rest * spread + 1e-9
    lower, upper = estimate - error, estimate + error
    own = ids[None, :] == np.asarray(query_ids)[:, None]
    lower[own] = -np.inf  # rows of the query's id are no candidates, so they mustn't set the bound
    kth = min(k, len(ids))  # with fewer than k other rows the bound is -inf, and all of them are candidates
    least = np.partition(lower, len(ids) - kth, axis=1)[:, len(ids) - kth]
    for q in range(len(queries)):
        at = np.flatnonzero((upper[q] >= least[q]) & ~own[q])
        if len(at):
            scores = cosines(vectors[at], queries[q])
            top = best_of(ids[at], scores, k)
            yield q, ids[at][top], scores[top]


def search(blocks: DataFrame, queries: DataFrame, k: int = 5, epsilon: float = EPSILON, size: int = ROUND) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row of ``queries`` (vec_id, embedding)."""
    spark, path = blocks.sparkSession, scratch_path(blocks.sparkSession, "found")
    distinct = materialize(usable(queries).distinct(), "queries")
    rounds = max(1, -(-distinct.count() // size))
    dealt = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(rounds))
    for number in range(rounds):
        groups: dict[int, list] = {}
        for batch in distinct.where(dealt == number).toArrow().to_batches():
            for ids, vectors in by_dimension(batch):
                groups.setdefault(vectors.shape[1], []).append((ids, vectors))
        shared = spark.sparkContext.broadcast(
            {d: tuple(map(np.concatenate, zip(*v, strict=True))) for d, v in groups.items()})
        blocks.mapInArrow(searcher(shared, k, epsilon), RESULT_SCHEMA).write.mode("append").parquet(path)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema(RESULT_SCHEMA).parquet(path)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def searcher(shared, k: int, epsilon: float):
    """The task of one round: the ``k`` best of all its blocks for each broadcast query."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                if dim not in shared.value:
                    continue
                query_ids, queries = shared.value[dim]
                raw = {c: batch.column(c)[i].as_buffer() for c in ("ids", "vectors", "codes", "scalars")}
                ids = np.frombuffer(raw["ids"], np.int64)
                vectors = np.frombuffer(raw["vectors"]).reshape(-1, dim)
                codes = np.frombuffer(raw["codes"], np.uint8).reshape(len(ids), -1)
                signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float64) * 2 - 1
                turn = rotation(dim)
                for start in range(0, len(query_ids), CHUNK):
                    some, some_ids = queries[start:start + CHUNK], query_ids[start:start + CHUNK]
                    for q, near, scores in search_block(some, some_ids, unit(some) @ turn, vectors, ids, signs,
                                                        np.frombuffer(raw["scalars"]), k, epsilon):
                        had = best.get((dim, start + q))
                        if had:
                            near, scores = np.concatenate([had[0], near]), np.concatenate([had[1], scores])
                        top = best_of(near, scores, k)
                        best[dim, start + q] = near[top], scores[top]
        if best:
            query = [np.full(len(near), shared.value[dim][0][q]) for (dim, q), (near, _) in best.items()]
            near, scores = map(np.concatenate, zip(*best.values(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(query)), pa.array(near), pa.array(scores)], names=["query_id", "vec_id", "score"])

    return task


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``.

    Vectors of another length than the query's are no candidates. Repeated vec_ids are candidates of their
    own, but never of a query with that id; a query id with several vectors is searched with each and keeps
    the ``k`` best. Other columns aren't looked at; an empty table gives an empty result.
    """
    return search(index(embeddings), embeddings.where(F.col("vec_id") % every == 0), k)
