"""Boosted trees by histograms: gradient sums per (node, feature, bin) over all rows.

Features are binned once, by a quantile sketch of the train rows, and the binned rows are written with their margins, in blocks
of some thousand rows and a buffer per column: a job reads them all, and reading row by row took longer than the sums. To split
nodes, a job's tasks sum the gradients of their rows, a shuffle by node adds the sums up, and the best split of each node is
found where they meet. Only splits come to the driver. Boosting goes on from its own margins, which are written anew
every ``SNAPSHOT`` trees, and the first job of a round counts the held-out rows' margins, so its AUC is known as it goes.

Depth costs no jobs where it can be foreseen: a tree grown on a bounded sample of rows tells which nodes the lower levels will
have, and one job sums for all of them. What counts is the split that all rows give; below a node where it
differs from the foreseen one, another job follows. The sample never decides a split.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from copy import deepcopy
from dataclasses import dataclass, field, replace
from functools import partial
from urllib.parse import urlsplit
from urllib.request import url2pathname

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.session import copies_made, materialize, remove_copies

MAX_BINS = 128  # of a feature; bin 0 holds missing values
SKETCH_ERROR = 0.001
ROWS_EACH = 500_000  # rows a task reads at most
BLOCK_ROWS = 50_000
LEAST_ROWS = 10_000  # fewer aren't worth a task
SAMPLE = 200_000  # train rows with which the driver foresees splits
SNAPSHOT = 8
AUC_BINS = 4096


@dataclass(frozen=True)
class Settings:
    """Settings of the tabular model."""

    rounds: int = 600
    patience: int = 50
    depth: int = 4
    rate: float = 0.03
    rows: float = 0.8
    columns: float = 0.8
    l2: float = 2.0
    l1: float = 1.0
    min_child_weight: float = 5.0
    seed: int = 42


TREE_SCHEMA = ("tree int, node int, feature int, bin int, threshold double, missing_left boolean, left int, value double, "
               "gain double")


@dataclass
class Tree:
    """Nodes in order of creation. ``feature`` is -1 in leaves; the right child follows the left one. Bins up to ``bin``
    and values below ``threshold`` go left, missing values by ``missing_left``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, threshold: float, missing_left: bool, gain: float,
              values: tuple[float, float]) -> tuple[int, int]:
        """Make ``node`` an inner node; returns its children."""
        first = len(self.feature)
        self.feature[node], self.bin[node], self.threshold[node] = feature, at, threshold
        self.missing_left[node], self.left[node], self.gain[node] = missing_left, first, gain
        for value in values:
            self.feature.append(-1)
            self.bin.append(0)
            self.threshold.append(0.0)
            self.missing_left.append(False)
            self.left.append(first)
            self.value.append(value)
            self.gain.append(0.0)
        return first, first + 1

    def splits_like(self, node: int, other: Tree, its: int) -> bool:
        return (self.feature[node], self.bin[node], self.missing_left[node]) == (
            other.feature[its], other.bin[its], other.missing_left[its])

    def leaves(self, columns: np.ndarray, binned: bool, ends: frozenset[int] = frozenset()) -> np.ndarray:
        """The node in which each row ends, a leaf or one of ``ends``. ``columns``: features x rows, as bins or as values."""
        small = np.min_scalar_type(-len(self.feature)).type  # node numbers of one byte in most trees

        def reached(node: int) -> np.ndarray:
            if self.feature[node] < 0 or node in ends:
                return small(node)
            value = columns[self.feature[node]]
            if binned:  # missing values have bin 0, below every split
                goes_left = value <= self.bin[node] if self.missing_left[node] else (value <= self.bin[node]) & (value > 0)
            else:
                goes_left = value < self.threshold[node]
                if self.missing_left[node]:
                    goes_left |= np.isnan(value)
            left, right = reached(self.left[node]), reached(self.left[node] + 1)
            return right + (left - right) * goes_left.astype(small)  # without branches, unlike np.where

        return np.broadcast_to(reached(0), columns.shape[1]).astype(np.intp)

    def below(self, node: int) -> list[int]:
        """``node`` and all nodes under it."""
        children = (self.left[node], self.left[node] + 1) if self.feature[node] >= 0 else ()
        return [node, *[n for child in children for n in self.below(child)]]

    def values(self, columns: np.ndarray, binned: bool) -> np.ndarray:
        return np.array(self.value)[self.leaves(columns, binned)]


@dataclass
class BoostedTrees:
    """A fitted model: trees, the features they read, and the AUC on held-out rows after each round that was tried."""

    trees: list[Tree]
    features: list[str]
    aucs: list[float] = field(default_factory=list)

    def score(self, rows: DataFrame, output: str) -> DataFrame:
        """Add the probability of class 1; NULL and NaN features are missing values."""
        trees = self.trees

        @F.pandas_udf("double")
        def probability(*values):
            columns = np.stack([v.to_numpy() for v in values])
            margin = np.zeros(columns.shape[1])
            for tree in trees:
                margin += tree.values(columns, binned=False)
            return pd.Series(1 / (1 + np.exp(-margin)))

        missing = F.lit(float("nan"))
        return rows.withColumn(output, probability(*[F.coalesce(F.col(c).cast("double"), missing) for c in self.features]))

    def best(self) -> int:
        """The first round (from 1) with the best AUC."""
        return int(np.argmax(self.aucs)) + 1

    def importances(self) -> list[tuple[str, float]]:
        """(feature, mean gain of its splits as a share of all such means); 0 for features that split nothing."""
        total, times = np.zeros(len(self.features)), np.zeros(len(self.features))
        for tree in self.trees:
            for f, gain in zip(tree.feature, tree.gain, strict=True):
                if f >= 0:
                    total[f] += gain
                    times[f] += 1
        mean = np.divide(total, times, out=np.zeros_like(total), where=times > 0)
        share = mean / mean.sum() if mean.sum() else mean
        return list(zip(self.features, share.tolist(), strict=True))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(t, n, *[getattr(tree, c)[n] for c in ("feature", "bin", "threshold", "missing_left", "left", "value", "gain")])
                for t, tree in enumerate(self.trees) for n in range(len(tree.feature))]
        spark.createDataFrame(rows, TREE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        spark.createDataFrame([(self.features, self.aucs)], "features array<string>, aucs array<double>").write.mode(
            "overwrite").parquet(f"{path}/columns")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        meta = spark.read.parquet(f"{path}/columns").first()
        trees: dict[int, Tree] = {}
        for row in spark.read.parquet(f"{path}/trees").orderBy("tree", "node").collect():
            tree = trees.setdefault(row["tree"], Tree([], [], [], [], [], [], []))
            for name in ("feature", "bin", "threshold", "missing_left", "left", "value", "gain"):
                getattr(tree, name).append(row[name])
        return cls(list(trees.values()), list(meta["features"]), list(meta["aucs"]))


# --- binning ---------------------------------------------------------------------------------


def cut_points(rows: DataFrame, features: list[str], most: int = MAX_BINS) -> list[np.ndarray]:
    """Per feature the values that separate its bins: distinct quantiles, from one job over all features."""
    steps = [i / (most - 2) for i in range(most - 1)]
    found = rows.stat.approxQuantile(features, steps, SKETCH_ERROR)
    # a cut lies above each value but the greatest, so that equal values share a bin
    return [np.unique(q)[1:] if q else np.empty(0) for q in found]


def binned_rows(rows: DataFrame, features: list[str], cuts: list[np.ndarray], keys: list[Column]) -> DataFrame:
    """label, weight, held_out, draw, margin and bins, one byte per feature. ``keys`` decide what samples a row is in."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            bins = np.zeros((n, len(features)), np.uint8)
            for i, cut in enumerate(cuts):
                value = batch.column(5 + i).to_numpy(zero_copy_only=False).astype(np.float64)
                bins[:, i] = np.where(np.isnan(value), 0, np.searchsorted(cut, value, side="right") + 1)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(features)), n, [None, pa.py_buffer(bins.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], raw.cast(pa.binary())],
                                             names=["label", "weight", "held_out", "draw", "margin", "bins"])

    draw = (F.xxhash64(*keys) if keys else F.xxhash64(F.lit(0))).alias("draw")
    missing = F.lit(float("nan"))
    return rows.select(
        F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"), "held_out", draw,
        F.lit(0.0).alias("margin"), *[F.coalesce(F.col(c).cast("double"), missing).alias(f"_f{i}") for i, c in enumerate(features)],
    ).mapInArrow(task, "label double, weight double, held_out boolean, draw long, margin double, bins binary")


# --- one level -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Request:
    """What to sum for tree ``number``: the nodes, in the tree they belong to, and the features that may split them."""

    settings: Settings
    number: int
    tree: Tree
    nodes: list[int]
    columns: list[int]
    count_held_out: bool


def in_sample(draw: np.ndarray, number: int, share: float, seed: int) -> np.ndarray:
    """Rows that tree ``number`` learns from."""
    with np.errstate(over="ignore"):
        mixed = (draw.view(np.uint64) ^ np.uint64(number * 1_000_003 + seed)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(32)) < np.uint64(int(share * (1 << 32)))


#: Columns of a block and the types of their buffers; ``columns`` is features x rows.
BLOCK = {"label": np.float64, "weight": np.float64, "held_out": np.bool_, "draw": np.int64, "margin": np.float64, "columns": np.uint8}
BLOCK_SCHEMA = ", ".join(f"{name} binary" for name in BLOCK)


def packed(rows: Iterable[Held]) -> pa.RecordBatch:
    """A block per element of ``rows``."""
    data = [[np.ascontiguousarray(getattr(held, name), kind).tobytes() for name, kind in BLOCK.items()] for held in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*data, strict=True)], names=list(BLOCK))


class Held:
    """Binned rows in memory, with their margins."""

    def __init__(self, batches: Iterable[pa.RecordBatch], features: int):
        parts = [self._arrays(batch, features) for batch in batches if batch.num_rows]
        empty = (*[np.empty(0)] * 2, np.empty(0, bool), np.empty(0, np.int64), np.empty(0), np.empty((features, 0), np.uint8))
        self.label, self.weight, self.held_out, self.draw, self.margin, self.columns = (
            [np.concatenate(c, axis=-1) for c in zip(*parts, strict=True)] if parts else empty)

    @staticmethod
    def _arrays(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, ...]:
        raw = batch.column(5)
        at = raw.offset * features
        bins = np.frombuffer(raw.buffers()[2], np.uint8)[at:at + batch.num_rows * features].reshape(-1, features)
        return (*[batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)], np.ascontiguousarray(bins.T))

    @classmethod
    def blocks(cls, batches: Iterable[pa.RecordBatch], features: int) -> Iterator[Held]:
        """The rows of each block that ``packed`` has made."""
        for batch in batches:
            for block in zip(*[batch.column(name) for name in BLOCK], strict=True):
                held = cls([], features)
                for (name, kind), data in zip(BLOCK.items(), block, strict=True):
                    setattr(held, name, np.frombuffer(data.as_buffer(), kind))
                held.columns = held.columns.reshape(features, -1)
                yield held

    def add(self, tree: Tree) -> None:
        self.margin = self.margin + tree.values(self.columns, binned=True)

    def sums(self, request: Request) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature per node, column and bin; held-out rows per label and bin of their probability."""
        p = 1 / (1 + np.exp(-self.margin))
        counts = np.zeros((2, AUC_BINS))
        if request.count_held_out:
            at = np.minimum((p[self.held_out] * AUC_BINS).astype(np.int64), AUC_BINS - 1)
            for k in (0, 1):
                counts[k] = np.bincount(at[self.label[self.held_out] == k], minlength=AUC_BINS)
        tree, settings = request.tree, request.settings
        under = {n: tree.below(n) for n in request.nodes}
        # each row is summed once, at the lowest asked node or leaf that it reaches; a node's sums are those of all ends under it
        last = frozenset(n for n in request.nodes if not any(m in under for m in under[n][1:]))
        ends = sorted({m for n in request.nodes for m in under[n] if m in last or (tree.feature[m] < 0 and n not in last)})
        place = np.full(len(tree.feature), -1)
        place[ends] = np.arange(len(ends))
        at = place[tree.leaves(self.columns, True, last)]
        rows = np.flatnonzero(~self.held_out & in_sample(self.draw, request.number, settings.rows, settings.seed) & (at >= 0))
        p, label, weight, base = p[rows], self.label[rows], self.weight[rows], at[rows] * MAX_BINS
        gradient, curvature = weight * (p - label), weight * p * (1 - p)
        parts = np.zeros((len(ends), len(request.columns), 2, MAX_BINS))
        for i, f in enumerate(request.columns if len(rows) else []):
            key = base + self.columns[f][rows]
            for k, values in enumerate((gradient, curvature)):
                parts[:, i, k] = np.bincount(key, values, len(ends) * MAX_BINS).reshape(-1, MAX_BINS)
        return np.stack([parts[[k for k, m in enumerate(ends) if m in under[n]]].sum(0) for n in request.nodes]), counts


def best_split(sums: np.ndarray, settings: Settings) -> dict:
    """The split with the most gain from sums per (column, gradient or curvature, bin); column -1 if there is none."""
    def quality(g, h):
        return np.maximum(np.abs(g) - settings.l1, 0) ** 2 / (h + settings.l2)

    total = sums[0].sum(1)
    missing = sums[:, :, :1]
    below = np.cumsum(sums[:, :, 1:], 2)
    # first the splits that send missing values right, then those that send them left
    left = np.stack([below, below + missing])[:, :, :, :-1]
    g, h = left[:, :, 0], left[:, :, 1]
    rest_g, rest_h = total[0] - g, total[1] - h
    gain = (quality(g, h) + quality(rest_g, rest_h) - quality(total[0], total[1])) / 2
    allowed = (h >= settings.min_child_weight) & (rest_h >= settings.min_child_weight) & (gain > 1e-9)
    gain = np.where(allowed, gain, -1.0)
    way, column, at = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return dict(column=int(column) if allowed.any() else -1, bin=int(at) + 1, missing_left=bool(way),
                gain=float(gain[way, column, at]), gradient=float(total[0]), curvature=float(total[1]),
                left_gradient=float(g[way, column, at]), left_curvature=float(h[way, column, at]), auc=None)


def area(counts: np.ndarray) -> float | None:
    """ROC-AUC from counts of negatives and positives per bin, ties as one half; None without both classes."""
    neg, pos = counts
    pairs = neg.sum() * pos.sum()
    return float(((neg.cumsum() - neg / 2) * pos).sum() / pairs) if pairs else None


# --- boosting --------------------------------------------------------------------------------

#: Best splits by node, and in node -1 the AUC of the trees so far.
Found = dict[int, dict]


def _grow(tree: Tree, node: int, found: dict, chosen: list[int], cuts: list[np.ndarray], settings: Settings) -> list[int]:
    """Split ``node`` as found, or give it its value; returns the new nodes."""
    def value(g: float, h: float) -> float:
        return -settings.rate * float(np.sign(g)) * max(abs(g) - settings.l1, 0.0) / (h + settings.l2)

    g, h = found["gradient"], found["curvature"]
    tree.value[node] = value(g, h)
    if found["column"] < 0:
        return []
    feature = chosen[found["column"]]
    left_g, left_h = found["left_gradient"], found["left_curvature"]
    cut = cuts[feature]
    # the last bin has no upper cut: such a split only separates missing values
    threshold = float(cut[found["bin"] - 1]) if found["bin"] <= len(cut) else float("inf")
    return list(tree.split(node, feature, found["bin"], threshold, found["missing_left"], found["gain"],
                           (value(left_g, left_h), value(g - left_g, h - left_h))))


def read_files(files: list[str], numbers: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks in those of the Parquet ``files`` whose numbers are given, one at a time."""
    for batch in numbers:
        for number in batch.column(0).to_pylist():
            with pq.ParquetFile(url2pathname(urlsplit(files[number]).path)) as file:
                yield from file.iter_batches(batch_size=1, use_threads=False)


class Rows:
    """Blocks of binned rows at rest. Margins are written anew every ``SNAPSHOT`` trees; jobs in between apply the few trees since."""

    PARTIAL = "node int, sums binary"
    SPLIT = ("node int, column int, bin int, missing_left boolean, gain double, gradient double, curvature double, "
             "left_gradient double, left_curvature double, auc double")

    def __init__(self, rows: DataFrame, features: int, tasks: int):
        self.features, self.tasks, self.recent, self.path = features, tasks, [], None

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                held, n = [*held, batch], n + batch.num_rows
                if n >= BLOCK_ROWS:
                    yield packed([Held(held, features)])
                    held, n = [], 0
            if n:
                yield packed([Held(held, features)])

        blocks = rows.mapInArrow(task, BLOCK_SCHEMA)
        self._write(blocks.repartition(tasks) if tasks > 1 else blocks.coalesce(1))

    def find(self, request: Request) -> Found:
        """The best splits of the request's nodes over all rows: one job."""
        recent, features, settings, columns, read = self.recent, self.features, request.settings, len(request.columns), self.read

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = Held([], features).sums(request)
            for held in Held.blocks(read(batches), features):
                for tree in recent:
                    held.add(tree)
                for total, more in zip((sums, counts), held.sums(request), strict=True):
                    total += more
            nodes, data = list(request.nodes), [s.tobytes() for s in sums]
            if request.count_held_out:
                nodes, data = [*nodes, -1], [*data, counts.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int32()), pa.array(data, pa.binary())], names=["node", "sums"])

        def add_up(group: pa.Table) -> pa.Table:
            node = group.column("node")[0].as_py()
            sums = sum(np.frombuffer(s, np.float64) for s in group.column("sums").to_pylist())
            row = {"auc": area(sums.reshape(2, -1))} if node < 0 else best_split(sums.reshape(columns, 2, MAX_BINS), settings)
            return pa.Table.from_pylist([{"node": node} | row], schema=arrow)

        kinds = {"int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
        arrow = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in self.SPLIT.split(", "))])
        found = self.source.mapInArrow(task, self.PARTIAL).groupBy("node").applyInArrow(add_up, self.SPLIT)
        return {row["node"]: row.asDict() for row in found.collect()}

    def add(self, tree: Tree) -> None:
        self.recent.append(tree)
        if len(self.recent) == SNAPSHOT:
            recent, features, read = self.recent, self.features, self.read

            def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for held in Held.blocks(read(batches), features):
                    for one in recent:
                        held.add(one)
                    yield packed([held])

            self._write(self.source.mapInArrow(task, BLOCK_SCHEMA))
            self.recent = []

    def _write(self, rows: DataFrame) -> None:
        """Written anew, as many files as tasks; the copy they were read from is deleted.

        Jobs read ``source`` by ``read``. On a file system that Python reads too these are the numbers of the files, and each
        task reads its own: Spark's reader and the way from it to Python copy a block several times, which took longer than
        the sums. Elsewhere they are the blocks.
        """
        name = f"margins-{uuid.uuid4().hex[:8]}"
        copy = materialize(rows, name)
        self.remove()
        self.rows, self.path = copy.coalesce(self.tasks), next(p for p in copies_made() if name in p)
        files = sorted(copy.inputFiles())
        if files and all(f.startswith("file:") for f in files):
            self.source, self.read = copy.sparkSession.range(0, len(files), 1, len(files)), partial(read_files, files)
        else:
            self.source, self.read = self.rows, iter

    def remove(self) -> None:
        if self.path:
            remove_copies(self.rows.sparkSession, [self.path])


def foreseen(tree: Tree, nodes: list[int], depth: dict[int, int], sample: Held, request: Request, scale: float,
             cuts: list[np.ndarray]) -> tuple[Tree, list[int]]:
    """``tree`` grown on below ``nodes`` as the sample splits them, and all nodes that may be split there."""
    ahead, depth, asked = deepcopy(tree), dict(depth), []
    while nodes:
        asked += nodes
        sums, _ = sample.sums(replace(request, tree=ahead, nodes=nodes, count_held_out=False))
        after = []
        for node, own in zip(nodes, sums, strict=True):
            for child in _grow(ahead, node, best_split(own * scale, request.settings), request.columns, cuts, request.settings):
                depth[child] = depth[node] + 1
                after.append(child)
        nodes = [n for n in after if depth[n] < request.settings.depth]
    return ahead, asked


def grow_tree(rows: Rows, sample: Held, request: Request, scale: float, cuts: list[np.ndarray]) -> tuple[Tree, float | None]:
    """A tree by the splits of all rows, and the AUC before it."""
    tree, depth, auc, settings = Tree(), {0: 0}, None, request.settings
    nodes = [0]
    while nodes:
        ahead, asked = foreseen(tree, nodes, depth, sample, request, scale, cuts)
        found = rows.find(replace(request, tree=ahead, nodes=asked))
        auc = found.get(-1, {}).get("auc", auc)
        request = replace(request, count_held_out=False)
        known, nodes = [(n, n) for n in nodes], []
        while known:
            node, other = known.pop(0)
            children = _grow(tree, node, found[other], request.columns, cuts, settings)
            for child in children:
                depth[child] = depth[node] + 1
            children = [c for c in children if depth[c] < settings.depth]
            if children and tree.splits_like(node, ahead, other):
                known += zip(children, (ahead.left[other], ahead.left[other] + 1), strict=True)
            else:
                nodes += children
    return tree, auc


def boost(rows: DataFrame, features: list[str], settings: Settings = Settings(), keys: list[Column] | None = None,
          sample: int = SAMPLE, rows_each: int = ROWS_EACH) -> BoostedTrees:
    """Trees from the rows that aren't ``held_out``, as many as give the best AUC on those that are.

    ``rows`` holds ``features``, ``label`` (0 or 1), ``weight`` and ``held_out``. Boosting ends after ``settings.patience``
    rounds without a better AUC, after ``settings.rounds``, or at a tree that finds nothing to split; without held-out rows of both
    classes all trees are kept. ``keys`` tell rows apart, for the draw of each tree's rows. NULL and NaN features are missing
    values, which each split sends to the better side.
    """
    cuts = cut_points(rows.where(~F.col("held_out")), features)
    binned = materialize(binned_rows(rows, features, cuts, keys or [F.col(c) for c in features]), "binned")
    n, train = binned.agg(F.count("*"), F.count_if(~F.col("held_out"))).first()
    model = BoostedTrees([], list(features))
    if not n:
        return model  # which scores every row 0.5
    share = int(min(1.0, sample / max(1, train)) * (1 << 20))
    some = binned.where(~F.col("held_out") & (F.pmod(F.xxhash64("draw"), F.lit(1 << 20)) < share)).limit(sample)
    few = Held(some.toArrow().to_batches(), len(features))
    scale = train / max(1, len(few.label))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    whole = Rows(binned, len(features), max(-(-n // rows_each), min(cores, -(-n // LEAST_ROWS))))
    while True:
        number, width = len(model.trees), len(features)
        rng = np.random.default_rng([settings.seed, number])
        chosen = sorted(rng.choice(width, max(1, round(settings.columns * width)), replace=False).tolist())
        tree, auc = grow_tree(whole, few, Request(settings, number, Tree(), [0], chosen, number > 0), scale, cuts)
        if number and auc is not None:
            model.aucs.append(auc)
            if number - model.best() >= settings.patience:
                break
        if number == settings.rounds or len(tree.feature) == 1:
            break
        model.trees.append(tree)
        whole.add(tree)
        few.add(tree)
    whole.remove()
    if model.aucs:
        model.trees = model.trees[:model.best()]
    return model
