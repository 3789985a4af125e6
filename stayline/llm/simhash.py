"""SimHash near-dedup with BK-trees.

1. Each document gets a SimHash fingerprint of its word shingles (repeats included).
2. Distinct fingerprints are dealt to *shards*: equal keys of some of their bits. With ``exact_keys`` two
   fingerprints that differ in at most ``radius`` bits share a shard for certain: of ``radius + intact`` blocks
   at least ``intact`` are equal, and each choice of blocks is a key. With ``sampled_keys`` a key is a random
   choice of bits, for radii at which blocks would be too short.
3. Each shard is a BK-tree: a node's children are keyed by their Hamming distance to it, and a search follows
   only the edges within the radius of the distance to the node. A shard of over ``SHARD`` fingerprints is cut
   into parts; the tree of a part is sent to every part after it (its size is bounded), so no task holds more than two.
4. A shard passes on a spanning forest of its links, never all pairs of a group. Forests are joined into
   components by repeated star contraction, with every round written to the shared folder.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import materialize, small_batches, words_of

SEED = 42
SHARD = 4096
GATHER = 1 << 16
FRONTIER = 1 << 18


def shingle_hashes(words: list[bytes], size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``size`` words joined by spaces; of the whole sequence, if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-size] + 1).tolist()]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1:].tolist(), strict=True)])
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def majority(hashes: np.ndarray, lanes: int = 1, block: int = 1 << 14) -> bytes:
    """The bits that are set in over half of ``hashes``; lane 0 is the hashes, later lanes are mixed from them."""
    out = []
    for lane in range(lanes):
        ones = np.zeros(64, np.int64)
        for start in range(0, len(hashes), block):
            part = hashes[start:start + block]
            if lane:
                part = _mixed(part, lane)
            ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(hashes)).tobytes() if len(hashes) else bytes(8))
    return b"".join(out)


def _mixed(x: np.ndarray, lane: int) -> np.ndarray:
    """Another 64-bit hash from a hash: a multiply and shift mixer, with a constant per lane."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * lane % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int = 4, lanes: int = 1, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``fp`` (binary, 8 bytes per lane), from the whole ``text``."""
    kept = docs.select(*keep, "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                fps = [majority(shingle_hashes(words_of(t), shingle), lanes) for t in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], pa.array(fps, pa.binary())],
                                                 names=[*keep, "fp"])

    fields = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)
    return kept.mapInArrow(task, f"{fields}, fp binary")


# --- shard keys ------------------------------------------------------------------------------


def exact_keys(bits: int, radius: int, intact: int = 2) -> list[np.ndarray]:
    """Bit places of each key: all choices of ``intact`` of ``radius + intact`` blocks."""
    blocks = np.array_split(np.arange(bits), radius + intact)
    return [np.concatenate(chosen) for chosen in itertools.combinations(blocks, intact)]


def sampled_keys(bits: int, width: int, count: int, seed: int = SEED) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [np.sort(rng.choice(bits, width, replace=False)) for _ in range(count)]


def shard_rows(distinct: DataFrame, keys: list[np.ndarray]) -> DataFrame:
    """shard, fp: one row per fingerprint and key."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                fps = batch.column(0).slice(start, 2000)
                n = len(fps)
                bits = np.unpackbits(_matrix(fps).view(np.uint8).reshape(n, -1), axis=1)
                shard = np.empty((len(keys), n), np.int64)
                for k, places in enumerate(keys):
                    value = bits[:, places].astype(np.int64) @ (1 << np.arange(len(places)))
                    shard[k] = value * len(keys) + k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.ravel()), pa.concat_arrays([fps] * len(keys))], names=["shard", "fp"])

    return distinct.select("fp").mapInArrow(task, "shard long, fp binary")


def _matrix(fps: pa.Array) -> np.ndarray:
    """Fingerprints as rows of 64-bit integers, one per lane."""
    raw = fps.cast(pa.binary()).to_pylist()
    return np.frombuffer(b"".join(raw), np.uint64).reshape(len(raw), -1) if raw else np.empty((0, 1), np.uint64)


# --- BK-trees --------------------------------------------------------------------------------


class Forest:
    """BK-trees of many shards at once: one tree per value of ``group``, built and searched level by level."""

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        n = len(fps)
        self.fps, self.bits = fps, fps.shape[1] * 64 + 1
        groups, first, sizes = np.unique(group, return_index=True, return_counts=True)
        self.groups, self.roots, self.sizes = groups, first, sizes
        node, alive = first[np.searchsorted(groups, group)], np.ones(n, bool)
        alive[first] = False
        edges, children = [], []
        item = np.flatnonzero(alive)
        at = node[item]
        while len(item):
            edge = at * self.bits + distance(fps[item], fps[at])
            found, where, back = np.unique(edge, return_index=True, return_inverse=True)
            child = item[where]
            edges.append(found)
            children.append(child)
            at = child[back]
            rest = at != item
            item, at = item[rest], at[rest]
        edge = np.concatenate(edges) if edges else np.empty(0, np.int64)
        order = np.argsort(edge)
        #: (node, distance to the child) of every edge in order, and its child
        self.edges, self.children = edge[order], (np.concatenate(children) if children else np.empty(0, np.int64))[order]

    def search(self, queries: np.ndarray, group: np.ndarray, radius: int, most: int = FRONTIER):
        """Pairs (query, node) within ``radius``, in blocks of queries, following only edges within the radius.

        A block's queries have trees of ``most`` nodes together, or it is one query, which bounds the frontier.
        """
        place = np.searchsorted(self.groups, group)
        inside = (place < len(self.groups)) & (self.groups[np.minimum(place, len(self.groups) - 1)] == group)
        known = np.flatnonzero(inside)
        reach = np.cumsum(self.sizes[place[known]]) // most
        for query in np.split(known, np.flatnonzero(np.diff(reach)) + 1) if len(known) else ():
            node = self.roots[place[query]]
            while len(query):
                d = distance(queries[query], self.fps[node])
                near = d <= radius
                if near.any():
                    yield query[near], node[near]
                low = np.searchsorted(self.edges, node * self.bits + np.maximum(d - radius, 0), "left")
                high = np.searchsorted(self.edges, node * self.bits + np.minimum(d + radius, self.bits - 1), "right")
                n = high - low
                total = int(n.sum())
                query = np.repeat(query, n)
                step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                node = self.children[np.repeat(low, n) + step]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


class Union:
    """Union-find over 0..n-1 for blocks of links: the links not yet joined are hooked round by round."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def _find(self, x: np.ndarray) -> np.ndarray:
        while (self.root[x] != x).any():
            x = self.root[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self._find(a), self._find(b)
        while (open_ := a != b).any():
            a, b = a[open_], b[open_]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            a, b = self._find(a), self._find(b)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(member, root) of every member that isn't alone."""
        root = self._find(np.arange(len(self.root)))
        member = np.flatnonzero(root != np.arange(len(root)))
        return member, root[member]


def _forest_links(tree_fps, tree_group, fps, group, radius) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two sets, as two equally long blocks of fingerprints."""
    both = np.concatenate([tree_fps, fps])
    union = Union(len(both))
    for query, node in Forest(tree_fps, tree_group).search(fps, group, radius):
        union.add(query + len(tree_fps), node)
    member, root = union.links()
    return both[member], both[root]


def _link_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    out = []
    for side in (a, b):
        raw, width = np.ascontiguousarray(side).tobytes(), 8 * side.shape[1]
        out.append(pa.array([raw[i:i + width] for i in range(0, len(raw), width)], pa.binary()))
    return pa.RecordBatch.from_arrays(out, names=["a", "b"])


def links(distinct: DataFrame, keys: list[np.ndarray], radius: int, shard: int = SHARD) -> DataFrame:
    """a, b: links between fingerprints within ``radius`` that connect what all such links in the shards connect."""
    rows = materialize(shard_rows(distinct, keys), "shards")
    sizes = rows.groupBy("shard").count().where("count > 1")
    large = materialize(sizes.where(F.col("count") > shard).select(
        "shard", F.ceil(F.col("count") / shard).cast("int").alias("parts")), "large-shards")
    small = rows.join(sizes.where(F.col("count") <= shard), "shard", "left_semi")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole small shards, many at a time; rows come in order of their shard."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def flush(keep_last: bool):
            nonlocal held, count
            group, fps = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            cut = int(np.searchsorted(group, group[-1])) if keep_last else len(group)
            held = [(group[cut:], fps[cut:])] if cut < len(group) else []
            count = len(group) - cut
            if cut:
                a, b = _forest_links(fps[:cut], group[:cut], fps[:cut], group[:cut], radius)
                if len(a):
                    yield _link_batch(a, b)

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), _matrix(batch.column(1))))
                count += batch.num_rows
                if count >= GATHER:
                    yield from flush(True)
        if held:
            yield from flush(False)

    found = small.select("shard", "fp").repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(
        solve, "a binary, b binary")

    # parts of large shards: each pair of parts is one group of two bounded blocks
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    parts = rows.join(large, "shard").withColumn("part", part)
    as_tree = parts.select("shard", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"),
                           F.lit(True).alias("tree"), "fp")
    as_query = parts.select("shard", F.explode(F.sequence(F.lit(0), "part")).alias("i"), F.col("part").alias("j"),
                            F.lit(False).alias("tree"), "fp")

    def solve_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])

        def flush():
            tree, fps = (np.concatenate(s) if s else np.empty((0, 1), np.uint64) for s in sides)
            if len(tree) and len(fps):
                a, b = _forest_links(tree, np.zeros(len(tree), np.int64), fps, np.zeros(len(fps), np.int64), radius)
                if len(a):
                    yield _link_batch(a, b)

        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), len(place)]
            for start, end in itertools.pairwise(cuts):
                if start == end:
                    continue
                if key is not None and key != tuple(place[start]):
                    yield from flush()
                    sides = ([], [])
                key = tuple(place[start])
                is_tree = batch.column(3).slice(start, end - start).to_numpy(zero_copy_only=False)
                fps = _matrix(batch.column(4).slice(start, end - start))
                sides[0].append(fps[is_tree])
                sides[1].append(fps[~is_tree])
        if key is not None:
            yield from flush()

    pairs = as_tree.unionByName(as_query).repartition(n, "shard", "i", "j").sortWithinPartitions(
        "shard", "i", "j").mapInArrow(solve_pair, "a binary, b binary")
    return found.unionByName(pairs).distinct()


# --- components ------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of the component of every node in ``edges`` (a, b).

    Alternates two star operations: every node's larger neighbours, then its smaller ones, are linked to the
    smallest neighbour. A hub's neighbours are never gathered: smallest neighbours are partial minima, joined back.
    """
    current = materialize(_ordered(edges), "edges")
    while True:
        large = _star(current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        after = materialize(_ordered(_small_star(materialize(large, "edges"))), "edges")
        if _digest(after) == _digest(current):
            break
        current = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _star(both: DataFrame) -> DataFrame:
    """Large star: links of each node to larger neighbours become links to its smallest neighbour or itself."""
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _ordered(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Small star: a node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)


# --- documents -------------------------------------------------------------------------------


def fingerprint_components(fps: DataFrame, keys: list[np.ndarray], radius: int, order: str = "doc_id") -> DataFrame:
    """fp, first: the smallest ``order`` of the component of each fingerprint; ``fps`` has fp and ``order``."""
    own = materialize(fps.groupBy("fp").agg(F.min(order).alias("own")), "distinct")
    joined = components(links(own, keys, radius))
    rooted = own.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "own", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("own").alias("first"))
    return rooted.join(least, "root").select("fp", "first")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, intact: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs`` (doc_id, text).

    Texts without words (NULL and empty too) have fingerprint zero and are linked like any other. component_id is
    the smallest doc_id reachable; NULL ids take no part in the minimum, and it is NULL where there is no other.
    Repeated rows are rows of their own; other columns aren't looked at; an empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs.select("doc_id", "text"), shingle, 1, "doc_id"), "fingerprints")
    found = fingerprint_components(fps, exact_keys(64, radius, intact), radius)
    return fps.join(found, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"),
                                        F.col("first").alias("component_id"))
