"""How far the sources of a language differ in their words.

Per language, a count vectorizer with a minimum document frequency and no other bound on its vocabulary (``vocabSize`` the
largest integer) makes an exact sparse vector of every document. Tasks sum the vectors of their documents by group
(lang, source), a shuffle sums the partial sums. The vocabulary is a table: it is never collected or
broadcast, only a bitmap of fixed size keeps rare terms out of the vectors early, and a join makes them exact.

With count c, sum N of the group and V kept terms, a term's share is ``p = 1 + floor(10^9 (c + 5) / (N + 5 V))``. Most terms
are absent from most groups and then have the group's own least share ``p0``. So the difference of groups i and j,
the sum over all V terms of ``|p - q|``, is evaluated sparsely:

* ``V |p0 - q0|``, as if both lacked every term;
* for the terms of i, ``|p - q0| - |p0 - q0|``, and the same for j. It depends on a term's count alone, so it is summed
  over the histogram of a group's shares;
* for the terms of both, ``|p - q| - |p - q0| - |p0 - q| + |p0 - q0|``, summed by tasks over the terms' rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayline.llm.common import materialize, small_batches, utf8
from stayline.llm.lexicon import code, is_set, word_bitmap, word_counts

MIN_DF = 30
VOCAB_SIZE = (1 << 31) - 1
TOP = 50
SCALE, SMOOTHING = 1_000_000_000, 5
HELD = 2_000_000  # entries of vectors, or pairs, that a task adds up at once
SYMBOLS = 500_000

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, with A-Z lowered."""
    return utf8(text).translate(_LETTERS).split()


class Vectorizer:
    """Count vectors of documents, per language, over terms with ``min_df`` documents of that language."""

    def __init__(self, min_df: int = MIN_DF, vocab_size: int = VOCAB_SIZE):
        self.min_df, self.vocab_size = min_df, vocab_size

    def fit(self, docs: DataFrame) -> Vectors:
        """The vocabulary of ``docs`` (lang, text), and what makes their vectors."""
        found = word_counts(docs, lambda text: set(terms_of(text))).where(F.col("n") >= self.min_df)
        if self.vocab_size < VOCAB_SIZE:
            order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
            found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= self.vocab_size)
        vocabulary = materialize(found.select("lang", F.col("word").alias("term"), F.col("n").alias("df")), "vocabulary")
        return Vectors(vocabulary)


class Places(dict):
    """term -> place in a task's list of (lang, term); -1 for terms that can't be in the vocabulary."""

    def __init__(self, lang: str, bitmap: np.ndarray, symbols: list[tuple[str, bytes]]):
        super().__init__()
        self.lang, self.bitmap, self.symbols = lang, bitmap, symbols

    def __missing__(self, term: bytes) -> int:
        place = -1
        if is_set(self.bitmap, code(self.lang, term)):
            place = len(self.symbols)
            self.symbols.append((self.lang, term))
        self[term] = place
        return place


def vector_of(text: str | None, places: Places) -> tuple[np.ndarray, np.ndarray]:
    """A document's terms, as places, and their counts."""
    terms = terms_of(text)
    ids = np.fromiter(map(places.__getitem__, terms), np.int64, len(terms))
    return np.unique(ids[ids >= 0], return_counts=True)


class Vectors:
    """A fitted vectorizer."""

    def __init__(self, vocabulary: DataFrame):
        self.vocabulary = vocabulary

    def _bitmap(self):
        spark = self.vocabulary.sparkSession
        return spark.sparkContext.broadcast(word_bitmap(self.vocabulary.select("lang", F.col("term").alias("word"))))

    def transform(self, docs: DataFrame, key: str) -> DataFrame:
        """key, lang, term, count: the entries of the vectors of ``docs`` (key, lang, text) that aren't zero."""
        shared = self._bitmap()

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in small_batches(batch):
                    symbols: list[tuple[str, bytes]] = []
                    places: dict[str, Places] = {}
                    rows, found, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                    for row, (lang, text) in enumerate(zip(*[part.column(c).to_pylist() for c in (1, 2)], strict=True)):
                        own = places.setdefault(lang, Places(lang, shared.value, symbols))
                        ids, n = vector_of(text, own)
                        rows.append(np.full(len(ids), row))
                        found.append(ids)
                        counts.append(n)
                    at = np.concatenate(found).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(np.concatenate(rows))), pa.array([symbols[i][0] for i in at], pa.string()),
                         pa.array([symbols[i][1] for i in at], pa.binary()), pa.array(np.concatenate(counts))],
                        names=[key, "lang", "term", "count"])

        kind = docs.schema[key].dataType.simpleString()
        entries = docs.select(key, "lang", "text").mapInArrow(task, f"`{key}` {kind}, lang string, term binary, count long")
        return entries.join(self.vocabulary.select("lang", "term"), ["lang", "term"])

    def group_sums(self, docs: DataFrame, held: int = HELD) -> DataFrame:
        """lang, source, term, count: the sums of the vectors of ``docs`` (lang, source, text) by lang and source."""
        shared = self._bitmap()
        names = ["lang", "source", "term", "count"]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums(shared.value)
            for batch in batches:
                for part in small_batches(batch):
                    for lang, source, text in zip(*[part.column(c).to_pylist() for c in range(3)], strict=True):
                        sums.add(lang, source, text)
                        if sums.n >= held or len(sums.symbols) >= SYMBOLS:
                            yield from sums.rows(names)
                            sums = Sums(shared.value)
            yield from sums.rows(names)

        partial = docs.select("lang", "source", "text").mapInArrow(
            task, "lang string, source string, term binary, count long")
        total = partial.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"))
        return total.join(self.vocabulary.select("lang", "term"), ["lang", "term"])


class Sums:
    """Vectors of documents, added up by group within a task."""

    def __init__(self, bitmap: np.ndarray):
        self.bitmap = bitmap
        self.symbols: list[tuple[str, bytes]] = []
        self.places: dict[str, Places] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, lang: str, source: str, text: str | None) -> None:
        group = self.groups.setdefault((lang, source), len(self.groups))
        ids, counts = vector_of(text, self.places.setdefault(lang, Places(lang, self.bitmap, self.symbols)))
        self.parts.append((group, ids, counts))
        self.n += len(ids)

    def rows(self, names: list[str], most: int = 100_000) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        keys = np.concatenate([g << 32 | ids for g, ids, _ in self.parts])
        found, at = np.unique(keys, return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, at, np.concatenate([c for *_, c in self.parts]))
        groups = list(self.groups)
        for start in range(0, len(found), most):
            key = found[start:start + most]
            of, term = (key >> 32).tolist(), (key & 0xFFFFFFFF).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([groups[g][0] for g in of], pa.string()), pa.array([groups[g][1] for g in of], pa.string()),
                 pa.array([self.symbols[t][1] for t in term], pa.binary()), pa.array(total[start:start + most])], names=names)


def share(count, total, size):
    """1 + floor(10^9 (count + 5) / (total + 5 size)) in decimals."""
    def wide(x):
        return x.cast("decimal(20,0)")

    return 1 + F.call_function("div", (F.lit(SCALE).cast("decimal(11,0)") * (wide(count) + SMOOTHING)).cast("decimal(38,0)"),
                               (wide(total) + SMOOTHING * wide(size)).cast("decimal(38,0)"))


PAIR = "lang string, i int, j int, value long"


def sums_of_both(entries: DataFrame, held: int = HELD) -> DataFrame:
    """lang, i, j, value over the terms that two groups have; partial sums. ``entries``: lang, term, own (i, p, p0)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, dict] = {}
        for batch in batches:
            for part in small_batches(batch, 1 << 20):
                for lang, own in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    i, p, p0 = (own.values.field(f).to_numpy() for f in range(3))
                    step = max(1, held // len(i))
                    for at in range(0, len(i), step):
                        a = slice(at, at + step)
                        value = np.abs(p[a, None] - p) - np.abs(p[a, None] - p0) - np.abs(p0[a, None] - p) + np.abs(p0[a, None] - p0)
                        key = (i[a, None].astype(np.int64) << 32 | i).ravel()
                        found = totals.setdefault(lang, {"keys": [], "values": [], "n": 0})
                        found["keys"].append(key)
                        found["values"].append(value.ravel())
                        found["n"] += len(key)
                        if found["n"] > held:
                            merge(found)
                            if found["n"] > held // 2:
                                yield rows(lang, totals.pop(lang))
        for lang, found in totals.items():
            merge(found)
            yield rows(lang, found)

    def merge(found: dict) -> None:
        keys, at = np.unique(np.concatenate(found["keys"]), return_inverse=True)
        value = np.zeros(len(keys), np.int64)
        np.add.at(value, at, np.concatenate(found["values"]))
        found.update(keys=[keys], values=[value], n=len(keys))

    def rows(lang: str, found: dict) -> pa.RecordBatch:
        merge(found)
        key, value = found["keys"][0], found["values"][0]
        some = (key >> 32) != (key & 0xFFFFFFFF)
        key, value = key[some], value[some]
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(key), pa.string()), pa.array((key >> 32).astype(np.int32)),
             pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(value)], names=["lang", "i", "j", "value"])

    return entries.select("lang", "own").mapInArrow(task, PAIR)


def sums_of_one(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, i, j, value over the terms of one group, and as if both lacked every term; for both orders of i and j.

    ``groups``: lang, i, size, p0, others (j, q0); ``shares``: lang, i, p, n, the histogram of the group's shares.
    """
    def task(group: pa.Table, found: pa.Table) -> pa.Table:
        row = group.to_pylist()[0]
        j = np.array([o["j"] for o in row["others"]], np.int64)
        q0 = np.array([o["q0"] for o in row["others"]], np.int64)
        p, n = (found.column(c).to_numpy().astype(np.int64) for c in ("p", "n"))
        order = np.argsort(p)
        p, n = p[order], n[order]
        upto, weighed = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * p))
        at = np.searchsorted(p, q0)  # shares before are less than q0
        far = q0 * upto[at] - weighed[at] + (weighed[-1] - weighed[at]) - q0 * (upto[-1] - upto[at])
        value = far - upto[-1] * np.abs(row["p0"] - q0)
        both = row["size"] * np.abs(row["p0"] - q0)
        some = j != row["i"]
        j, value, both = j[some], value[some], both[some]
        i = np.full(len(j), row["i"])
        return pa.Table.from_arrays(
            [pa.array([row["lang"]] * (2 * len(j)), pa.string()), pa.array(np.concatenate([i, j]).astype(np.int32)),
             pa.array(np.concatenate([j, i]).astype(np.int32)), pa.array(np.concatenate([value + both, value]))],
            names=["lang", "i", "j", "value"])

    return groups.groupBy("lang", "i").cogroup(shares.groupBy("lang", "i")).applyInArrow(task, PAIR)


def divergence(docs: DataFrame, min_df: int = MIN_DF, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) in ``docs`` (text, lang, source).

    Part ``pair``: each other source of the language and the difference of both groups' shares, summed over all kept terms.
    Part ``term``: the ``top`` terms whose share in the group exceeds that in the whole language most, with the excess. Rank
    1 has the largest value, ties go by item. NULL text, lang and source count as ''; repeated rows count each; a
    language without kept terms has differences of 0; other columns aren't looked at; an empty table gives an empty result.
    """
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    vectors = Vectorizer(min_df).fit(rows)
    sums = materialize(vectors.group_sums(rows), "sums")
    sizes = vectors.vocabulary.groupBy("lang").agg(F.count("*").alias("size"))
    totals = sums.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    zero = F.lit(0).cast("long")
    least = F.when(F.col("size") > 0, share(zero, F.col("total"), F.col("size"))).otherwise(zero)
    groups = (
        rows.groupBy("lang", "source").count().drop("count")
        .join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "size"])
        .withColumns({"p0": least, "i": F.row_number().over(Window.partitionBy("lang").orderBy("source")),
                      "lang_total": F.sum("total").over(Window.partitionBy("lang"))})
    )
    groups = materialize(groups, "groups")
    entries = materialize(
        sums.join(groups.select("lang", "source", "i", "total", "size", "p0"), ["lang", "source"])
        .select("lang", "source", "i", "term", "count", "p0", share(F.col("count"), F.col("total"), F.col("size")).alias("p")),
        "shares")

    others = groups.groupBy("lang").agg(F.collect_list(F.struct(F.col("i").alias("j"), F.col("p0").alias("q0"))).alias("others"))
    one = sums_of_one(groups.join(others, "lang").select("lang", "i", "size", "p0", "others"),
                      entries.groupBy("lang", "i", "p").agg(F.count("*").alias("n")))
    both = sums_of_both(entries.groupBy("lang", "term").agg(F.collect_list(F.struct("i", "p", "p0")).alias("own"))
                        .where(F.size("own") > 1))
    name = groups.select("lang", "i", "source")
    pairs = (
        one.unionByName(both).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
        .join(name, ["lang", "i"]).join(name.select("lang", F.col("i").alias("j"), F.col("source").alias("item")), ["lang", "j"])
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    )
    whole = sums.groupBy("lang", "term").agg(F.sum("count").alias("all"))
    langs = groups.select("lang", "size", "lang_total").distinct()
    usual = whole.join(langs, "lang").select("lang", "term", share(F.col("all"), F.col("lang_total"), F.col("size")).alias("q"))
    terms = (
        entries.join(usual, ["lang", "term"]).where(F.col("p") > F.col("q"))
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"),
                (F.col("p") - F.col("q")).alias("value"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(order)
    return pairs.withColumn("rank", ranked).unionByName(terms.withColumn("rank", ranked).where(F.col("rank") <= top))
