"""One document of each group of near duplicates: SimHash fingerprints of 256 bits propose, shingle sets decide.

Two documents are near duplicates if the Jaccard similarity of their sets of five-word shingles is ``SIMILARITY``
(0.8) or more; a text of fewer words is one shingle. Documents with equal sets are one *node*.

1. *Candidates*: sets that share a Jaccard similarity ``J`` have a cosine of about ``2 J / (1 + J)``, so the
   fingerprints of the sets differ in ``acos(cosine) / pi`` of the bits: 39 of 256 at 0.8, with a spread of 6.
   ``RADIUS`` 58 is three spreads above. No two blocks of so many differing bits need be equal, so shards take random
   choices of bits, ``KEYS`` keys of ``WIDTH`` bits, worked off in ``ROUNDS`` rounds. By this model 99.0 % of the
   pairs at exactly 0.8 become candidates, and more above; what is lost is lost here, nowhere else.
2. *Verification*: the sets of linked candidates are compared exactly, inside each component of candidates. First
   all nodes are compared with ``STARS`` hubs, one after the other. Nodes that this leaves outside the largest
   group of their component are then compared with every node of the component, in pairs of blocks of ``PART``.
3. Groups are the components of the verified pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import keeps_columns, materialize, numbered, small_batches, words_of
from stayline.llm.simhash import Union, components, links, majority, sampled_keys, shingle_hashes
from stayline.session import copies_made, remove_copies

SHINGLE, LANES, RADIUS, WIDTH, KEYS, ROUNDS = 5, 4, 58, 16, 96, 2
SIMILARITY = 0.8
STARS, PART = 3, 128


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles of a text, in order."""
    return np.unique(shingle_hashes(words_of(text), SHINGLE))


def set_prints(rows: DataFrame) -> DataFrame:
    """_row, doc_id, node (a hash of the shingle set), fp (the set's fingerprint) of every row."""
    kept = rows.select("_row", "doc_id", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                sets = [shingle_set(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                     pa.array([majority(s, LANES) for s in sets], pa.binary())], names=["_row", "doc_id", "node", "fp"])

    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(task, f"_row long, doc_id {kind}, node binary, fp binary")


def candidate_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links between fingerprints; the shards of a round of keys are deleted before the next."""
    keys, found = sampled_keys(64 * LANES, WIDTH, KEYS), None
    for i in range(ROUNDS):
        before = set(copies_made())
        some = materialize(links(fps, keys[i::ROUNDS], radius), "links")
        remove_copies(fps.sparkSession, [p for p in copies_made()[:-1] if p not in before])
        found = some if found is None else found.unionByName(some)
    return found.distinct()


def candidates(sets: DataFrame, radius: int) -> DataFrame:
    """group, node, _row: the nodes of each component of candidates that has more than one."""
    fps = materialize(sets.select("fp").distinct(), "distinct")
    joined = components(candidate_links(fps, radius)).select(F.col("node").alias("fp"), "root")
    close = materialize(sets.join(joined, "fp", "left").select(
        F.coalesce("root", "fp").alias("group"), "node", F.col("place._row").alias("_row")), "close")
    return close.join(close.groupBy("group").count().where("count > 1"), "group", "left_semi")


def shared(sets: list[np.ndarray], other: np.ndarray) -> np.ndarray:
    """How many shingles each of ``sets`` has in common with ``other``; all are in order and not repeated."""
    sizes = np.array([len(s) for s in sets])
    if not len(other) or not sizes.sum():
        return np.zeros(len(sets), np.int64)
    flat = np.concatenate(sets)
    place = np.minimum(np.searchsorted(other, flat), len(other) - 1)
    total = np.concatenate([[0], np.cumsum(other[place] == flat)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def similar(sets: list[np.ndarray], other: np.ndarray, least: float) -> np.ndarray:
    """Which of ``sets`` have a Jaccard similarity of ``least`` or more with ``other``."""
    both = shared(sets, other)
    union = np.array([len(s) for s in sets]) + len(other) - both
    return (both > 0) & (both >= least * union - 1e-9)


def star_links(members: DataFrame, number: int, least: float) -> DataFrame:
    """a, b: nodes of each group and its hub, where they are similar. The hub depends on the round's number."""
    hubs = members.groupBy("group").agg(F.min_by(F.struct("node", "shingles"), F.xxhash64(F.lit(number), "node")).alias("hub"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                near = [k for k, (own, hub) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))
                        if similar([np.frombuffer(own, np.uint64)], np.frombuffer(hub, np.uint64), least)[0]]
                at = pa.array(near, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at)], names=["a", "b"])

    return members.join(hubs, "group").where("node <> hub.node").select(
        "node", F.col("hub.node").alias("b"), "shingles", F.col("hub.shingles").alias("others")).mapInArrow(
        task, "a binary, b binary")


def block_links(members: DataFrame, stars: DataFrame, least: float) -> DataFrame:
    """a, b: what connects the nodes outside the largest star-linked part of their group to all that are similar."""
    linked = components(stars).withColumnRenamed("root", "part")
    known = materialize(members.select("group", "node").join(linked, "node", "left").select(
        "group", "node", F.coalesce("part", "node").alias("part")), "known")
    largest = known.groupBy("group", "part").count().groupBy("group").agg(
        F.max(F.struct("count", "part")).alias("most"), F.sum("count").alias("size"))
    open_ = largest.where("most.count < size").select(
        "group", F.col("most.part").alias("largest"), F.ceil(F.col("size") / PART).cast("int").alias("wide"),
        F.ceil((F.col("size") - F.col("most.count")) / PART).cast("int").alias("high"))
    rest = materialize(members.join(open_, "group").join(known, ["group", "node"]).select(
        "group", "node", "shingles", "wide", "high", (F.col("part") != F.col("largest")).alias("outside")), "open")
    dealt = F.xxhash64("node")
    one = rest.where("outside").select(
        "group", F.pmod(dealt, "high").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("j"),
        "outside", "node", "shingles")
    all_ = rest.select(
        "group", F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("i"), F.pmod(dealt, "wide").cast("int").alias("j"),
        F.lit(False).alias("outside"), "node", "shingles")

    def solve(found: pa.Table) -> pa.Table:
        nodes = found.column("node").to_pylist()
        sets = [np.frombuffer(raw, np.uint64) for raw in found.column("shingles").to_pylist()]
        outside = found.column("outside").to_numpy()
        others = np.flatnonzero(~outside)
        union = Union(len(nodes))
        some = [sets[k] for k in others]
        for k in np.flatnonzero(outside) if len(some) else ():
            near = others[similar(some, sets[k], least)]
            union.add(np.full(len(near), k), near)
        member, root = union.links()
        return pa.table({"a": pa.array([nodes[k] for k in member], pa.binary()),
                         "b": pa.array([nodes[k] for k in root], pa.binary())})

    return one.unionByName(all_).groupBy("group", "i", "j").applyInArrow(solve, "a binary, b binary").where("a <> b")


def verified_links(rows: DataFrame, close: DataFrame, least: float) -> DataFrame:
    """a, b: links between nodes with a similarity of ``least`` or more that connect what all such pairs connect."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                sets = pa.array([shingle_set(t).tobytes() for t in part.column(2).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], sets], names=["group", "node", "shingles"])

    members = materialize(rows.select("_row", "text").join(close, "_row").select("group", "node", "text").mapInArrow(
        task, "group binary, node binary, shingles binary"), "members")
    stars = star_links(members, 0, least)
    for number in range(1, STARS):
        stars = stars.unionByName(star_links(members, number, least))
    stars = materialize(stars, "stars")
    return stars.unionByName(block_links(members, stars, least))


@keeps_columns("doc_id", "text")
def distinct_documents(docs: DataFrame, radius: int = RADIUS, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) but for one of each group, the one with the smallest doc_id.

    Texts without words are copies of each other. Rows without doc_id come after all others; of equal ids any one
    row stays. Linked documents are a group, and so are those linked through others.
    """
    rows = numbered(docs, "to-compare")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    sets = materialize(set_prints(rows).groupBy("node", "fp").agg(F.min(place).alias("place")), "sets")
    joined = components(verified_links(rows, candidates(sets, radius), least))
    first = sets.join(joined, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(
        F.min("place").alias("first"))
    return rows.join(first.select(F.col("first._row").alias("_row")), "_row", "left_semi").select(*docs.columns)
