"""Quality classifier: naive Bayes log-count ratios as the scale of a linear support vector machine.

*Features* are indicators of n-grams, hashed to ``BUCKETS`` places: byte n-grams of the text, and n-grams of its *shape*, in
which letters are one sign per case, digits and characters beyond ASCII one each, and other characters stay. A word that
equals the one before it has a shape of its own. Shapes tell of layout in any language, bytes of its words.

1. A sample of at most ``SAMPLE`` labelled documents per class, by a hash of doc_id, is what is learned from; the rest of
   the labels isn't looked at. Sampled ids are a table of a proven size, and meet the documents in a broadcast join.
2. ``r = log((p_f + a_p) / |p|) - log((q_f + a_q) / |q|)`` per feature, with p_f and q_f the documents of class 1 and 0
   that hold it. The smoothing follows the classes' sizes, ``a_p = 2 |p| / (|p| + |q|)``, so that an unseen feature has 0. A document is the vector of the ratios of its features, scaled to length one, and a one for the bias.
3. A linear hinge-loss model is fitted by dual coordinate descent. ``PARTS`` tasks improve the dual variables of
   their documents against a copy of the weights; their changes are averaged, for ``ROUNDS`` rounds.
4. A logistic curve, fitted on ``1 / HOLD`` of the sample
   that the weights haven't seen, with the classes weighted by their true sizes, turns the margin into a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import id_remainder, materialize, small_batches, utf8

BUCKETS = 1 << 18
BYTE_GRAMS, SHAPE_GRAMS = (2, 3, 4), (1, 2, 3, 4, 5, 6)
SAMPLE = 4000
PARTS, ROUNDS, STEPS = 8, 12, 5
COST = 1.0
HOLD = 8
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
PIECE, OVERLAP = 1 << 20, 64  # bytes of a text hashed at once, and what the next piece repeats of them

_SHAPE = np.arange(256, dtype=np.uint32)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 128
_SPACE = np.isin(np.arange(256), (32, 9, 10, 11, 12, 13))
_AGAIN = np.uint32(129)
_POWERS = np.cumprod(np.full(256, 0x100000001B3, np.uint64), dtype=np.uint64)


def shape_of(raw: np.ndarray) -> np.ndarray:
    """Shape signs of a text's bytes, runs of equal signs cut to two; a word equal to the word before is _AGAIN alone."""
    shape, space = _SHAPE[raw], _SPACE[raw]
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if len(first) > 1:
        length = np.add.reduceat(~space, first, dtype=np.int64)
        place = np.arange(len(raw))
        place[first[0]:] -= np.repeat(first, np.diff(np.append(first, len(raw))))
        value = np.where(space, np.uint64(0), (raw.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 255])
        word = np.add.reduceat(value, first)
        again = np.concatenate([[False], (word[1:] == word[:-1]) & (length[1:] == length[:-1])])
        inner = np.zeros(len(raw), bool)
        inner[first[0]:] = np.repeat(again, np.diff(np.append(first, len(raw)))) & ~space[first[0]:]
        shape[inner] = _AGAIN
    run = np.ones(len(shape), bool)
    run[2:] = (shape[2:] != shape[1:-1]) | (shape[2:] != shape[:-2])
    run[1:] &= (shape[1:] != _AGAIN) | (shape[:-1] != _AGAIN)
    return shape[run]


class Features:
    """Features of texts, with one table of flags for all."""

    def __init__(self) -> None:
        self.flags = np.zeros(BUCKETS, bool)

    def _set(self, signs: np.ndarray, orders: tuple[int, ...], salt: int) -> None:
        value = np.full(len(signs), salt, np.uint32)
        for n in range(1, orders[-1] + 1):
            if len(signs) < n:
                return
            value = value[:len(signs) - n + 1] * np.uint32(0x01000193) + signs[n - 1:]
            if n in orders:
                mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                self.flags[mixed >> np.uint32(14)] = True

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted buckets of a text."""
        raw = np.frombuffer(utf8(text), np.uint8)
        for at in range(0, len(raw), PIECE):
            piece = raw[max(0, at - OVERLAP):at + PIECE]
            self._set(piece.astype(np.uint32), BYTE_GRAMS, 17)
            self._set(shape_of(piece), SHAPE_GRAMS, 71)
        found = np.flatnonzero(self.flags)
        self.flags[found] = False
        return found.astype(np.int32)


def packed(found: np.ndarray) -> bytes:
    """Buckets as numbers or, if that is shorter, as bits: ``BUCKETS`` / 8 bytes at most."""
    if 4 * len(found) < BUCKETS // 8:
        return found.tobytes()
    bits = np.zeros(BUCKETS, np.uint8)
    bits[found] = 1
    return np.packbits(bits).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if len(data) == BUCKETS // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8))).astype(np.int32)
    return np.frombuffer(data, np.int32)


def scaled(found: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """A document's entries: the ratios of its features, scaled to length one."""
    values = ratio[found]
    length = float(np.sqrt(values @ values))
    return values / length if length else values


# --- the sample ------------------------------------------------------------------------------


def training_labels(labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, label of the usable labels: 0 or 1, outside the held-out fold, and the same in all rows of the id."""
    rows = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label"))
    one = rows.where(F.col("label").isin(0, 1) & (id_remainder(folds) != held_out)).groupBy("doc_id").agg(
        F.min("label").alias("label"), F.max("label").alias("other"))
    return one.where(F.col("label") == F.col("other")).select("doc_id", "label")


def sampled_features(docs: DataFrame, usable: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """part, hold, doc_id, label, features of up to ``sample`` documents per class; ids with several rows by their least text."""
    order = F.xxhash64("doc_id")
    some = [usable.where(F.col("label") == c).orderBy(order, "doc_id").limit(sample) for c in (0, 1)]
    chosen = materialize(some[0].unionByName(some[1]), "sample")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").groupBy(
        "doc_id", "label").agg(F.min("text").alias("text"))
    own = F.xxhash64("doc_id", F.lit(1))
    rows = texts.select(F.pmod(own, F.lit(PARTS)).cast("int").alias("part"),
                        (F.pmod(F.floor(own / PARTS), F.lit(HOLD)) == 0).alias("hold"), "doc_id", "label", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for part in small_batches(batch):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array([packed(features(t)) for t in part.column(4).to_pylist()], pa.binary())],
                    names=["part", "hold", "doc_id", "label", "features"])

    return materialize(rows.mapInArrow(task, "part int, hold boolean, doc_id long, label int, features binary")
                       .repartition(PARTS, "part"), "features")


# --- the model -------------------------------------------------------------------------------


def log_count_ratios(features: DataFrame, block: int = 4096) -> np.ndarray:
    """The ratio of every bucket; counts are summed by blocks of buckets, and only the sums come to the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for label, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[label][unpacked(data)] += 1
        parts = total.reshape(-1, block)
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([parts[i].tobytes() for i in some], pa.binary())],
                                         names=["block", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in group.column("counts").to_pylist())
        return pa.table({"block": group.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    ddl = "block long, counts binary"
    found = features.select("label", "features").mapInArrow(count, ddl).groupBy("block").applyInArrow(add, ddl)
    counts = np.zeros((2 * BUCKETS // block, block))
    for at, data in found.collect():
        counts[at] += np.frombuffer(data, np.int64)
    counts = counts.reshape(2, BUCKETS)
    size = counts.sum(1, keepdims=True)
    q, p = np.log((counts + 2 * size / size.sum()) / size)
    return p - q


def descend(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: np.ndarray, weights: np.ndarray,
            alpha: np.ndarray, steps: int) -> None:
    """Dual coordinate descent for the hinge loss, in place; the last weight is the bias."""
    size = np.array([float(v @ v) for v in values]) + 1.0
    rng = np.random.default_rng(0)
    for _ in range(steps):
        for i in rng.permutation(len(rows)).tolist():
            slope = sign[i] * (weights[rows[i]] @ values[i] + weights[-1]) - 1
            after = min(max(alpha[i] - slope / size[i], 0.0), cost[i])
            if after != alpha[i]:
                move = (after - alpha[i]) * sign[i]
                weights[rows[i]] += move * values[i]
                weights[-1] += move
                alpha[i] = after


def fit_margin(features: DataFrame, ratio: np.ndarray, costs: tuple[float, float], rounds: int = ROUNDS,
               steps: int = STEPS) -> np.ndarray:
    """Weights of the scaled features and the bias. Each part starts a round from the same weights, and its change
    counts by one part in ``PARTS``, which keeps the dual variables feasible."""
    context = features.sparkSession.sparkContext
    shared_ratio = context.broadcast(ratio)
    weights = np.zeros(BUCKETS + 1)
    alphas: dict[int, np.ndarray] = {}
    for _ in range(rounds):
        shared = context.broadcast((weights, alphas))

        def improve(group: pa.Table) -> pa.Table:
            start, known = shared.value
            group = group.sort_by("doc_id")
            part = group.column("part")[0].as_py()
            label = group.column("label").to_numpy()
            rows = [unpacked(d) for d in group.column("features").to_pylist()]
            values = [scaled(r, shared_ratio.value) for r in rows]
            own, alpha = start.copy(), known.get(part, np.zeros(len(rows))).copy()
            before = alpha.copy()
            descend(rows, values, label * 2.0 - 1, np.array(costs)[label], own, alpha, steps)
            moved = before + (alpha - before) / PARTS
            return pa.table({"part": pa.array([part], pa.int32()), "alpha": pa.array([moved.tobytes()], pa.binary()),
                             "change": pa.array([((own - start) / PARTS).astype(np.float32).tobytes()], pa.binary())})

        for part, alpha, change in features.groupBy("part").applyInArrow(
                improve, "part int, alpha binary, change binary").collect():
            alphas[part] = np.frombuffer(alpha, np.float64)
            weights = weights + np.frombuffer(change, np.float32)
        shared.unpersist()
    return weights


def fit_curve(margin: np.ndarray, label: np.ndarray, sizes: tuple[int, int], rounds: int = 50) -> tuple[float, float]:
    """slope, offset of ``1 / (1 + exp(-(slope * margin + offset)))`` by Newton steps; classes weigh by their true sizes."""
    n = np.bincount(label, minlength=2)
    weight = np.array([sizes[c] / max(1, n[c]) for c in (0, 1)])[label]
    weight = weight / weight.mean()
    target = np.where(label == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    curve = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-3 * (curve - [1, 0])
        second = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(second, gradient)
        curve = curve - step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return max(float(curve[0]), 1e-3), float(curve[1])


class Model:
    """What scores a text: one weight per bucket, scaled by the length of the text's ratios, and a curve."""

    def __init__(self, ratio: np.ndarray, weights: np.ndarray, curve: tuple[float, float]):
        self.ratio, self.weights, self.bias, self.curve = ratio, weights[:-1], weights[-1], curve

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found] @ scaled(found, self.ratio) + self.bias)

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * margin + self.curve[1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    """A model of ``labels`` (doc_id, quality) on ``docs`` (doc_id, text)."""
    usable = materialize(training_labels(labels, folds, held_out), "labels")
    sizes = {row[0]: row[1] for row in usable.groupBy("label").count().collect()}
    true = (sizes.get(0, 0), sizes.get(1, 0))
    features = sampled_features(docs, usable, sample)
    found = {(r[0], r[1]): r[2] for r in features.groupBy("hold", "label").count().collect()}
    fitted = features.where("NOT hold")
    n = [found.get((False, c), 0) for c in (0, 1)]
    if not all(n):  # nothing to tell apart: the share of class 1
        share = (true[1] + 1) / (sum(true) + 2)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS + 1), (1.0, float(np.log(share / (1 - share)))))
    ratio = log_count_ratios(fitted)
    weights = fit_margin(fitted, ratio, tuple(COST * sum(n) / (2 * k) for k in n))
    model = Model(ratio, weights, (1.0, 0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    unseen = features.where("hold") if all(found.get((True, c)) for c in (0, 1)) else features

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = [shared.value.margin(unpacked(d)) for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(margin, pa.float64())], names=["label", "margin"])

    rows = unseen.select("label", "features").mapInArrow(margins, "label int, margin double").collect()
    rows.sort()
    model.curve = fit_curve(np.array([r[1] for r in rows]), np.array([r[0] for r in rows]), true)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, held_out: int = HELD_OUT,
                   threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    Learns from ``labels`` (doc_id, quality) whose crc32(doc_id) modulo ``folds`` isn't ``held_out``. Left out of learning:
    NULL ids, qualities other than 0 and 1, ids with both. A row without doc_id isn't held out. A NULL or empty text has no features
    and the score of the bias alone; equal texts have equal scores; long texts are hashed whole, piece by piece. Without labels of
    both classes every score is the share of class 1 (0.5 if there are none). Other columns aren't looked at; an empty table
    gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample, folds, held_out))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for part in small_batches(batch):
                margin = np.array([model.value.margin(features(t)) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.value.score(margin))],
                                                 names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(id_remainder(folds) == held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
