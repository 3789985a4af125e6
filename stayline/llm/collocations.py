"""Phrase collocations by weighted acyclic automata over words.

A *count transducer* maps phrases of two and three words to how often they occur. It has three levels: arcs of first
words lead to arcs of second words, these to states of third words, whose arcs carry the weights; the empty third word stands
for a second word without a usable one after it. A pair's count is the sum of the weights beyond it. Second-word states
with one equal arc are one state, so the automaton is no tree.

1. Words are counted per language. Phrases of candidates hold only words with ``least`` occurrences; a bitmap of fixed
   size (``lexicon.BITMAP_BITS``) tells tasks which words may have them. It errs only towards more.
2. Each task cuts its texts into shards of ``SHARD_TOKENS`` words. The sorted phrases of a shard are built level by level into
   transducers, one per *prefix range*: a range of the codes (hashes) of language, first and second word.
3. Transducers of a range are united: symbol tables are merged, equal paths add their weights. A range holds about
   ``RANGE_TOKENS`` phrases at any corpus size, and a phrase comes at most once per shard, so hot words don't matter.
4. Parts are looked up by composition: the symbol table of a range with the word counts, and the last two words of its
   phrases with the transducer of the range in which those are a prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayline.llm.common import materialize, small_batches, utf8
from stayline.llm.lexicon import code, is_set, word_bitmap, word_counts
from stayline.llm.token_counts import head_of

LEAST, LONGER_SHARE, TOP = 10, 50, 2000
HEAD = 100_000  # commonest symbols, which are broadcast
SHARD_TOKENS = 2_000_000
RANGE_TOKENS = 2_000_000
UNKNOWN = "und"

BREAK = b"."
_SEPARATORS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", BREAK * 10)


def tokens_of(text: str | None) -> list[bytes]:
    """Words of a text, with BREAK between its pieces; no word holds that byte."""
    return utf8(text).lower().translate(_SEPARATORS).replace(BREAK, b" . ").split()


def ranges_of(first: np.ndarray, second: np.ndarray, ranges: int) -> np.ndarray:
    """Number of the prefix range of pairs, given the codes of both words."""
    mixed = (first ^ (second >> np.uint64(31)) ^ (second << np.uint64(33))) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights[order], first)


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).lower().translate(_SEPARATORS).replace(BREAK, b" ").split()


class CountTransducer:
    """Phrases with counts. Labels below ``HEAD`` are places in the list of the commonest symbols, which all transducers share;
    the others, less ``HEAD``, are places in the transducer's own ``symbols``. Label -1 is the empty third word."""

    SCHEMA = "symbols binary, symbol_ends binary, firsts binary, ends binary, seconds binary, targets binary, " \
             "state_ends binary, thirds binary, weights binary"
    ARRAYS = ("firsts", "ends", "seconds", "targets", "state_ends", "thirds", "weights")

    def __init__(self, symbols: pa.BinaryArray, **arrays: np.ndarray):
        self.symbols = symbols
        for name in self.ARRAYS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, symbols: pa.BinaryArray, first: np.ndarray, second: np.ndarray, third: np.ndarray,
              weight: np.ndarray) -> CountTransducer:
        """From phrases in any order, repeats added up; level by level over the sorted phrases."""
        pair, at_pair = np.unique(first.astype(np.int64) << 32 | second, return_inverse=True)
        key, weight = summed(at_pair.astype(np.int64) << 32 | (third + 1), weight.astype(np.int64))
        degree = np.bincount(key >> 32, minlength=len(pair))
        label = (key & 0xFFFFFFFF) - 1
        # states with one arc: one per distinct (label, weight); the others keep their own
        single = degree[key >> 32] == 1
        shared, target = np.unique(np.stack([label[single], weight[single]]), axis=1, return_inverse=True) \
            if single.any() else (np.empty((2, 0), np.int64), np.empty(0, np.int64))
        targets = np.empty(len(pair), np.int64)
        targets[degree == 1] = target.ravel()
        targets[degree > 1] = shared.shape[1] + np.arange((degree > 1).sum())
        firsts, begin = np.unique(pair >> 32, return_index=True)
        return cls(symbols, firsts=firsts, ends=np.append(begin[1:], len(pair))[:len(firsts)], seconds=pair & 0xFFFFFFFF,
                   targets=targets,
                   state_ends=np.concatenate([np.arange(shared.shape[1]) + 1, shared.shape[1] + np.cumsum(degree[degree > 1])]),
                   thirds=np.concatenate([shared[0], label[~single]]),
                   weights=np.concatenate([shared[1], weight[~single]]))

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """first, second, third, weight of all paths."""
        first = np.repeat(self.firsts, np.diff(self.ends, prepend=0))
        degree = np.diff(self.state_ends, prepend=0)[self.targets]
        start = (self.state_ends - np.diff(self.state_ends, prepend=0))[self.targets]
        path = np.repeat(np.arange(len(self.seconds)), degree)
        arc = np.repeat(start - (np.cumsum(degree) - degree), degree) + np.arange(len(path))
        return first[path], self.seconds[path], self.thirds[arc], self.weights[arc]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """first, second and the count of all pairs."""
        sums = np.add.reduceat(self.weights, self.state_ends - np.diff(self.state_ends, prepend=0)) \
            if len(self.weights) else self.weights
        return np.repeat(self.firsts, np.diff(self.ends, prepend=0)), self.seconds, sums[self.targets]

    @classmethod
    def union(cls, several: list[CountTransducer]) -> CountTransducer:
        known = pa.chunked_array([one.symbols for one in several]).combine_chunks().dictionary_encode()
        found, at = [], 0
        for one in several:
            to = known.indices.slice(at, len(one.symbols)).to_numpy().astype(np.int64)
            at += len(to)
            *labels, weight = one.phrases()
            found.append((*[moved(x, to) for x in labels], weight))
        return cls.build(known.dictionary, *[np.concatenate(c) for c in zip(*found, strict=True)])

    def compose(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Counts of the pairs that another transducer asks for, arc by arc; 0 where there is no path."""
        have_first, have_second, count = self.pairs()
        have = have_first << 32 | have_second
        want = first << 32 | second
        at = np.minimum(np.searchsorted(have, want), max(0, len(have) - 1))
        return np.where(have[at] == want, count[at], 0) if len(have) else np.zeros(len(want), np.int64)

    def frequent(self, least: int) -> CountTransducer:
        """Only pairs and triples with ``least`` occurrences. A pair keeps its count: the rest goes to the empty third word."""
        first, second, third, weight = self.phrases()
        keep = (third >= 0) & (weight >= least)
        a, b, count = self.pairs()
        rest = np.where(keep, -weight, 0)
        return CountTransducer.build(self.symbols, *[np.concatenate(c) for c in (
            (a, first, first[keep]), (b, second, second[keep]), (np.full(len(a), -1), np.full(len(first), -1), third[keep]),
            (count, rest, weight[keep]))])._without_pairs_under(least)

    def _without_pairs_under(self, least: int) -> CountTransducer:
        first, second, third, weight = self.phrases()
        _, _, count = self.pairs()
        many = np.repeat(count >= least, np.diff(self.state_ends, prepend=0)[self.targets])
        return CountTransducer.build(*with_used(self.symbols, first[many], second[many], third[many]), weight[many])

    def row(self) -> dict:
        _, ends, data = pa.concat_arrays([self.symbols, pa.array([b""], pa.binary())]).slice(0, len(self.symbols)).buffers()
        ends = np.frombuffer(ends, np.int32)[:len(self.symbols) + 1]
        return dict(symbols=data.to_pybytes()[:ends[-1]] if data else b"", symbol_ends=ends.tobytes(),
                    **{n: getattr(self, n).astype(np.int64 if n == "weights" else np.int32).tobytes() for n in self.ARRAYS})

    @classmethod
    def of(cls, row: dict) -> CountTransducer:
        """From what ``row`` gives."""
        symbols = pa.BinaryArray.from_buffers(pa.binary(), len(row["symbol_ends"]) // 4 - 1, [
            None, pa.py_buffer(row["symbol_ends"]), pa.py_buffer(row["symbols"])])
        return cls(symbols, **{n: np.frombuffer(row[n], np.int64 if n == "weights" else np.int32).astype(np.int64)
                               for n in cls.ARRAYS})

    def with_words(self, head: list[bytes]) -> tuple[list[tuple[str, bytes]], CountTransducer]:
        """Language and word of every symbol in use, and the same phrases with labels into that list."""
        *labels, weight = self.phrases()
        used, at = np.unique(np.concatenate(labels), return_inverse=True)
        at = np.split(at.astype(np.int64) - int(len(used) > 0 and used[0] < 0), 3)
        found = [head[i] if i < HEAD else self.symbols[i - HEAD].as_py() for i in used[used >= 0].tolist()]
        words = [(lang.decode("utf-8", "surrogatepass"), word) for lang, word in (s.rsplit(b"\n", 1) for s in found)]
        return words, CountTransducer.build(pa.array(found, pa.binary()), *at, weight)


def moved(labels: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Labels whose own symbols have new places."""
    own = labels >= HEAD
    labels = labels.copy()
    labels[own] = HEAD + to[labels[own] - HEAD]
    return labels


def with_used(symbols: pa.BinaryArray, *labels: np.ndarray) -> tuple:
    """The own symbols in use, and labels that fit."""
    every = np.concatenate(labels)
    used = np.unique(every[every >= HEAD]) - HEAD
    to = np.zeros(len(symbols), np.int64)
    to[used] = np.arange(len(used))
    return symbols.take(pa.array(used)), *[moved(x.astype(np.int64), to) for x in labels]


def symbol(lang: str, word: bytes) -> bytes:
    """One label for both; words hold no line feed."""
    return utf8(lang) + b"\n" + word


class Shard:
    """Words of texts gathered until there are enough to build transducers from."""

    def __init__(self, bitmap: np.ndarray, head: dict[bytes, int], codes: np.ndarray):
        self.bitmap, self.head, self.head_codes = bitmap, head, codes
        self.symbols: list[bytes] = []
        self.codes: list[int] = []
        self.places: dict[str, Places] = {}
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, lang: str, text: str | None) -> None:
        words = tokens_of(text)
        found = self.places.setdefault(lang, Places(lang, self))
        self.parts.append(np.fromiter(map(found.__getitem__, words), np.int32, len(words)))
        self.parts.append(np.full(2, -1, np.int32))
        self.n += len(words)

    def transducers(self, ranges: int) -> Iterator[tuple[int, CountTransducer]]:
        ids = np.concatenate(self.parts)
        pair = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        first, second, third = ids[pair], ids[pair + 1], np.append(ids, -1)[pair + 2]
        codes, symbols = np.concatenate([self.head_codes, np.array(self.codes, np.uint64)]), pa.array(self.symbols, pa.binary())
        place = ranges_of(codes[first], codes[second], ranges)
        order = np.argsort(place.astype(np.int16) if ranges < 1 << 15 else place, kind="stable")  # 16 bits: by radix
        edges = np.searchsorted(place[order], np.arange(ranges + 1))
        for number in np.flatnonzero(np.diff(edges)).tolist():
            some = order[edges[number]:edges[number + 1]]
            yield number, CountTransducer.build(*with_used(symbols, first[some], second[some], third[some]),
                                                np.ones(len(some), np.int64))


class Places(dict):
    """word -> label; -1 for the break and for words that are too rare."""

    def __init__(self, lang: str, shard: Shard):
        super().__init__({BREAK: -1})
        self.lang, self.shard = lang, shard

    def __missing__(self, word: bytes) -> int:
        shard, label = self.shard, symbol(self.lang, word)
        place = shard.head.get(label)
        if place is None:
            own = code(self.lang, word)
            if is_set(shard.bitmap, own):
                place = HEAD + len(shard.symbols)
                shard.symbols.append(label)
                shard.codes.append(own)
            else:
                place = -1
        self[word] = place
        return place


def commonest(words: DataFrame, size: int) -> list[bytes]:
    """Up to ``size`` symbols of ``words`` (lang, word, n); HEAD at most, each of bounded length."""
    found = words.select(F.concat(F.col("lang").cast("binary"), F.lit(b"\n"), F.col("word")).alias("word"), "n")
    return list(head_of(found, "n", min(size, HEAD)))


def as_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def phrase_counts(texts: DataFrame, bitmap: np.ndarray, head: list[bytes], ranges: int, least: int = LEAST,
                  shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per prefix range: the transducer of the pairs and triples in ``texts`` (lang, text) with ``least`` occurrences."""
    codes = np.zeros(HEAD, np.uint64)
    codes[:len(head)] = [code(lang.decode("utf-8", "surrogatepass"), word) for lang, word in (s.rsplit(b"\n", 1) for s in head)]
    shared = texts.sparkSession.sparkContext.broadcast((bitmap, {s: i for i, s in enumerate(head)}, codes))
    ddl = f"prefix_range int, {CountTransducer.SCHEMA}"
    schema = arrow_schema(ddl)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Shard(*shared.value)
        for batch in batches:
            for part in small_batches(batch):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held.add(lang, text)
                    if held.n >= shard_tokens:
                        for number, one in held.transducers(ranges):
                            yield as_batch([one.row() | {"prefix_range": number}], schema)
                        held = Shard(*shared.value)
        if held.n:
            for number, one in held.transducers(ranges):
                yield as_batch([one.row() | {"prefix_range": number}], schema)

    def unite(group: pa.Table) -> pa.Table:
        united = CountTransducer.union([CountTransducer.of(r) for r in group.to_pylist()]).frequent(least)
        number = group.column("prefix_range")[0].as_py()
        return pa.Table.from_batches([as_batch([united.row() | {"prefix_range": number}], schema)])

    return texts.select("lang", "text").mapInArrow(task, ddl).groupBy("prefix_range").applyInArrow(unite, ddl)


CANDIDATE = "lang string, w1 binary, w2 binary, w3 binary, a long, f1 long, f_last long, f12 long, longer long, route int"


def candidates(counts: DataFrame, words: DataFrame, head: list[bytes], ranges: int) -> DataFrame:
    """All phrases of ``counts`` with the counts of their first and last word, from the range's symbols and ``words``.

    ``f12`` is the count of a triple's first two words. ``longer`` is the count of a pair's commonest continuation.
    ``route`` is the range of the phrase's last two words as a prefix.
    """
    schema, shared = arrow_schema(CANDIDATE), counts.sparkSession.sparkContext.broadcast(head)

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found, _ = CountTransducer.of(row).with_words(shared.value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["prefix_range"]] * len(found), pa.int32()), pa.array([s[0] for s in found], pa.string()),
                     pa.array([s[1] for s in found], pa.binary())], names=["prefix_range", "lang", "word"])

    def compose(transducers: pa.Table, known: pa.Table) -> pa.Table:
        labels, one = CountTransducer.of(transducers.to_pylist()[0]).with_words(shared.value)
        n = dict(zip(zip(known.column("lang").to_pylist(), known.column("word").to_pylist(), strict=True),
                     known.column("n").to_pylist(), strict=True))
        own = np.fromiter((n[s] for s in labels), np.int64, len(labels))
        codes = np.fromiter((code(*s) for s in labels), np.uint64, len(labels))
        first, second, third, weight = one.phrases()
        triple = third >= 0
        first, second, third, weight = (x[triple] for x in (first, second, third, weight))
        a, b, count = one.pairs()
        key = a << 32 | b
        at = np.searchsorted(key, first << 32 | second)
        longer = np.zeros(len(a), np.int64)
        np.maximum.at(longer, at, weight)
        w1, w2 = np.concatenate([a, first]), np.concatenate([b, second])
        last = np.concatenate([b, third])
        before = np.concatenate([a, second])
        langs, text = (np.array([s[k] for s in labels], object) for k in (0, 1))
        none = np.zeros(len(a), np.int64)
        columns = dict(
            lang=langs[w1], w1=text[w1], w2=text[w2], w3=np.concatenate([np.full(len(a), None, object), text[third]]),
            a=np.concatenate([count, weight]), f1=own[w1], f_last=own[last], f12=np.concatenate([none, count[at]]),
            longer=np.concatenate([longer, np.zeros(len(third), np.int64)]),
            route=ranges_of(codes[before], codes[last], ranges))
        return pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    asked = counts.mapInArrow(symbols, "prefix_range int, lang string, word binary").join(words, ["lang", "word"])
    return counts.groupBy("prefix_range").cogroup(asked.groupBy("prefix_range")).applyInArrow(
        lambda left, right: compose(left, right) if left.num_rows else schema.empty_table(), CANDIDATE)


def with_last_parts(found: DataFrame) -> DataFrame:
    """Candidates with ``f23``, the count of a triple's last two words, and ``longer`` over all triples around a pair.

    The pairs of a range are a transducer, with which the last two words of triples are composed.
    """
    ddl = CANDIDATE.replace("route int", "f23 long")
    schema = arrow_schema(ddl)

    def compose(group: pa.Table) -> pa.Table:
        c = group.to_pydict()
        pair = np.array([w is None for w in c["w3"]])
        place: dict[bytes, int] = {}
        n = len(pair)
        before = np.fromiter((place.setdefault(symbol(lang, x if z is None else y), len(place))
                              for lang, x, y, z in zip(c["lang"], c["w1"], c["w2"], c["w3"], strict=True)), np.int64, n)
        last = np.fromiter((place.setdefault(symbol(lang, y if z is None else z), len(place))
                            for lang, y, z in zip(c["lang"], c["w2"], c["w3"], strict=True)), np.int64, n)
        a = np.array(c["a"], np.int64)
        some = np.flatnonzero(pair)
        counts = CountTransducer.build(pa.array(list(place), pa.binary()), before[some], last[some], np.full(len(some), -1), a[some])
        f23 = np.where(pair, 0, counts.compose(before, last))
        key = before << 32 | last
        keys, at = np.unique(key, return_inverse=True)
        most = np.zeros(len(keys), np.int64)
        np.maximum.at(most, at[~pair], a[~pair])
        longer = np.where(pair, np.maximum(np.array(c["longer"], np.int64), most[at]), 0)
        out = group.drop_columns(["route", "longer"])
        return pa.Table.from_arrays([{"f23": pa.array(f23), "longer": pa.array(longer)}.get(f.name) if f.name in (
            "f23", "longer") else out.column(f.name) for f in schema], schema=schema)

    return found.groupBy("route").applyInArrow(compose, ddl)


def score(a, left, right):
    """floor(1000000 a a / (l r)) in decimals; the quotient is at most a million, as no part is rarer than the whole."""
    def wide(x):
        return x.cast("decimal(20,0)")

    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)).cast("decimal(31,0)"),
                           (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, least: int = LEAST, longer_share: int = LONGER_SHARE, top: int = TOP,
                 range_tokens: int = RANGE_TOKENS, shard_tokens: int = SHARD_TOKENS, head: int = HEAD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two or three words in ``docs`` (text, lang).

    ``a``, ``l`` and ``r`` count the phrase and the parts of its lowest-scoring cut (ties: the earliest), ``n`` all words. Phrases
    that lie in a longer candidate with ``longer_share`` per cent of their count are left out. Order: score and a
    descending, phrase ascending. NULL and empty texts have no words, a NULL lang is 'und'. Repeated rows count each;
    other columns aren't looked at; without candidates, as in an empty table, the result is empty. Counts are exact below 10^15.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    words = materialize(word_counts(texts, words_of), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    ranges = max(4 * spark.sparkContext.defaultParallelism, -(-total // range_tokens))
    usable = words.where(F.col("n") >= least)
    common = commonest(usable, head)
    counts = materialize(phrase_counts(texts, word_bitmap(usable), common, ranges, least, shard_tokens), "phrases")
    found = with_last_parts(candidates(counts, words, common, ranges))
    pair = F.col("w3").isNull()
    first_cut = score(F.col("a"), F.col("f1"), F.when(pair, F.col("f_last")).otherwise(F.col("f23")))
    second_cut = F.when(~pair, score(F.col("a"), F.col("f12"), F.col("f_last")))
    late = F.coalesce(F.col("second") < F.col("first"), F.lit(False))
    scored = (
        found.where(100 * F.col("longer") < longer_share * F.col("a"))
        .withColumns({"first": first_cut, "second": second_cut})
        .select("lang", F.concat_ws(" ", *[F.col(w).cast("string") for w in ("w1", "w2", "w3")]).alias("phrase"), "a",
                F.when(late, F.col("f12")).otherwise(F.col("f1")).alias("l"),
                F.when(late | pair, F.col("f_last")).otherwise(F.col("f23")).alias("r"),
                F.when(late, F.col("second")).otherwise(F.col("first")).alias("score"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
