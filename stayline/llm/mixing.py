"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target / size of its source. The whole part
is taken at once. What is left is a mass of words between 0 and the document's size. Two documents with such a
rest are paired: mass moves from one to the other, in a random direction that leaves both expectations as they
are, until one is integral (nothing or the whole document). So words are conserved, and each leaf leaves one
fractional document at most; leaves are combined in a tree of wide nodes, and only the root rounds at random.

Leaves are chosen by a hash of the document, about ``leaf`` rows each, so a hot source is many leaves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayline.llm.common import keeps_columns, materialize, numbered, word_count

WEIGHTS = (3.0, 1.0, 2.0)
LEAF = 1024
FAN = 256


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """source, source_size, n_docs, target, sid; one row per source, NULL being a source of its own.

    ``sizes`` has source and size. Sources in code point order (NULL last) weigh ``weights`` in turn and share
    ``share`` of all words; a target stops at ``most`` times its source's size, and the excess is shared again
    by weight among the others, until none is above. That point is a single level per unit of weight, so each
    round only needs two sums over the table of sources.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    grouped = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    sources = materialize(
        grouped.withColumn("sid", F.row_number().over(ordered) - 1).withColumn("weight", turn)
        .withColumn("most", F.col("source_size") * F.lit(most)), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("most") if capped >= 0 else F.lit(False)
        row = sources.agg(
            F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)).alias("full"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("free"),
            F.count(F.when(above, 1)).alias("n")).first()
        if row.n == capped or row.free == 0:
            break
        level, capped = (share * total - row.full) / row.free, row.n
    return sources.select("source", "source_size", "n_docs", "sid",
                          F.least("most", F.col("weight") * F.lit(level)).alias("target"))


def settle(size: np.ndarray, mass: np.ndarray, rng: np.random.Generator) -> int:
    """Pair the fractional entries of ``mass`` (0..size) in place until one is left; its index, or -1."""
    open_at = -1
    draws = rng.random(len(size))
    for j in range(len(size)):
        if not 0 < mass[j] < size[j]:
            continue
        if open_at < 0:
            open_at = j
            continue
        i = open_at
        up = min(size[i] - mass[i], mass[j])
        down = min(size[j] - mass[j], mass[i])
        if draws[j] * (up + down) < down:  # towards i
            mass[i], mass[j] = mass[i] + up, mass[j] - up
            i_done, j_done = size[i] - mass[i] <= 1e-9 * size[i], mass[j] <= 1e-9 * size[j]
            mass[i], mass[j] = size[i] if i_done else mass[i], 0.0 if j_done else mass[j]
        else:
            mass[i], mass[j] = mass[i] - down, mass[j] + down
            i_done, j_done = mass[i] <= 1e-9 * size[i], size[j] - mass[j] <= 1e-9 * size[j]
            mass[i], mass[j] = 0.0 if i_done else mass[i], size[j] if j_done else mass[j]
        open_at = j if i_done and not j_done else -1 if i_done else i
    return open_at


def combiner(seed: int, level: int, last: bool):
    """The function of one level of the tree; at the root what is left is rounded."""

    def combine(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "leaf"], ascending=[False, True], ignore_index=True)
        size, mass = rows["size"].to_numpy(float), rows["mass"].to_numpy(float).copy()
        rng = np.random.default_rng([seed, level, *key])
        left = settle(size, mass, rng)
        if left >= 0 and last:
            mass[left] = size[left] if rng.random() < mass[left] / size[left] else 0.0
            left = -1
        rows["mass"], rows["node"] = mass, key[1]
        rows["open"] = np.arange(len(rows)) == left
        return rows[["sid", "leaf", "node", "size", "mass", "open"]]

    return combine


def copies(sized: DataFrame, targets: DataFrame, seed: int = 20, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """``_row``, ``_copies`` (0, 1 or 2) for every row of ``sized`` (_row, _key, source, size)."""
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(2.0), F.col("target") / F.col("source_size")))
    leaves = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / leaf))
    dealt = (
        sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("_row", "_key", "size", "sid", F.coalesce(ratio, F.lit(0.0)).alias("ratio"),
                F.pmod(F.xxhash64(F.lit(seed), "_key"), leaves).alias("leaf"))
    )

    def first(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "_key", "_row"], ascending=[False, True, True], ignore_index=True)
        size = rows["size"].to_numpy(float)
        whole = np.floor(rows["ratio"].to_numpy())
        mass = (rows["ratio"].to_numpy() - whole) * size
        rest = settle(size, mass, np.random.default_rng([seed, *key]))
        rows["_copies"] = (whole + (mass >= size) * (size > 0)).astype("int64")
        rows["mass"] = np.nan
        if rest >= 0:
            rows.loc[rest, "mass"] = mass[rest]
        return rows[["_row", "sid", "leaf", "size", "_copies", "mass"]]

    leaf_rows = materialize(
        dealt.groupBy("sid", "leaf").applyInPandas(
            first, "_row long, sid int, leaf long, size long, _copies long, mass double"), "leaves")
    rest = leaf_rows.where("mass IS NOT NULL").select("sid", "leaf", F.col("leaf").alias("node"), "size", "mass")
    most = targets.agg(F.max("n_docs")).first()[0] or 1
    nodes, level, decided = -(-most // leaf), 0, None
    while True:
        nodes, level = -(-nodes // fan), level + 1
        last = nodes <= 1

        done = materialize(
            rest.withColumn("node", F.floor(F.col("node") / fan)).groupBy("sid", "node").applyInPandas(
                combiner(seed, level, last), "sid int, leaf long, node long, size long, mass double, open boolean"), "nodes")
        settled = done.where("NOT open").select(
            "sid", "leaf", F.when(F.col("mass") > 0, 1).otherwise(0).alias("extra"))
        decided = settled if decided is None else decided.unionByName(settled)
        if last:
            break
        rest = done.where("open").drop("open")
    return leaf_rows.join(decided, ["sid", "leaf"], "left").select(
        "_row", (F.col("_copies") + F.when(F.col("mass").isNull(), 0).otherwise(F.coalesce("extra", F.lit(0))))
        .alias("_copies"))


def mix(docs: DataFrame, seed: int = 20, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source).

    NULL and blank texts have size 0 and take nothing; a NULL source is a source; repeated rows and ids are
    rows of their own; an empty table gives an empty result. Other columns of ``docs`` aren't looked at. The
    draw depends on the seed, the ids and the texts alone, so reruns agree.
    """
    sized = numbered(docs.select("doc_id", "source", word_count("text").alias("size"),
                                 F.xxhash64("doc_id", "text").alias("_key")), "sizes")
    targets = materialize(source_targets(sized), "targets")
    drawn = copies(sized, targets, seed, leaf, fan)
    return (
        sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .join(drawn, "_row")
        .select("doc_id", "size", "source_size", "target", (F.col("_copies") * F.col("size")).alias("taken"))
    )


@keeps_columns("doc_id", "text", "source")
def mixed_documents(docs: DataFrame, seed: int = 20) -> DataFrame:
    """The mix itself: the rows of ``docs`` (doc_id, text, source, ...), each as often as it is taken, with all their columns.

    NULLs, repeated rows and empty tables as in ``mix``.
    """
    rows = numbered(docs.withColumns({"_size": word_count("text"), "_key": F.xxhash64("doc_id", "text")}), "to-mix")
    sized = rows.select("_row", "_key", "source", F.col("_size").alias("size"))
    drawn = copies(sized, materialize(source_targets(sized), "targets"), seed)
    kept = rows.join(drawn.where("_copies > 0"), "_row")
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
