"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A run is consecutive lines: ``lines`` (3) or more of them, whatever they hold, or fewer with ``words`` (50) or more
words ``[^\\x20\\x09-\\x0D]+`` together, or all lines of a text that has fewer than ``lines``. A line is deleted if it lies
in a run that occurred earlier: in a document with a smaller doc_id, or further up in its own; a whole short text
repeats whole short texts only. Lines are compared exactly, through 64-bit hashes.

1. *Fingerprints*: of every window of ``lines`` line hashes the smallest (the last of equal ones) is selected.
   Equal windows select equal lines, so a repeated run can't be missed, and about every second line is enough.
   Shorter windows with words enough select in the same way, and a short text is a window of its own.
2. *Join positions*: fingerprints that occur once drop out, which is nearly all of the text.
3. *Extend both ways*: what surrounds a remaining fingerprint is the windows that selected it; each is compared,
   as a hash of all its lines, with its first occurrence. Windows that touch and have the same distance to their
   sources are one match, see ``repeated_runs``. A group of equal windows is reduced to its first place before
   it moves, and only the first is joined, so a line in a third of all documents costs no pairs. The reduced
   tables are written before they are joined, so that adaptive execution can split a hot fingerprint.
4. Later repeats are cut out of their documents.

NULL texts have no lines and stay NULL; an empty text is one empty line and loses nothing. Rows that agree in doc_id
and text are one document and are treated alike; documents with equal ids come in the order of their text's hash,
NULL ids first. Other columns aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import WORD, materialize

LINES = 3
WORDS = 50
KEY = ("has_id", "id", "text_hash")


def _lines():
    return F.split(F.coalesce("text", F.lit("")), "\n")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the document's key, which also orders documents."""
    return docs.select(
        "doc_id", "text", F.col("doc_id").isNotNull().alias("has_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("text_hash"))


def winnowed(docs: DataFrame, lines: int = LINES, words: int = WORDS) -> DataFrame:
    """Key and ``windows``: for each window its position, size and content, and the line it selects.

    Windows hold ``lines`` lines, or fewer with ``words`` words. A text of fewer than ``lines`` is one more window,
    whose size in ``kind`` is 0, so that it meets only its like; in the others ``kind`` is the size.
    """
    measured = docs.where("text IS NOT NULL").select(*KEY, (F.col("text") != "").alias("filled"), F.transform(
        _lines(), lambda x: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("n"))).alias("l"))
    n = F.size("l")

    def windows(size):
        def window(i):
            here = F.transform(F.slice("l", i + 1, size), lambda x: x["h"])
            least = F.array_min(F.transform(here, lambda x, j: F.struct(x.alias("v"), (-(i + j)).alias("at"))))
            return F.struct((-least["at"]).alias("line"), least["v"].alias("fingerprint"), i.alias("pos"),
                            F.lit(size).alias("size"), F.lit(size).alias("kind"), F.xxhash64(here).alias("content"))

        def is_run(i):
            held = F.get("l", i)["n"]
            for j in range(1, size):
                held = held + F.get("l", i + j)["n"]
            return held >= words

        none = F.array().cast("array<int>")
        places = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(none)
        return F.transform(places if size >= lines else F.filter(places, is_run), window)

    content = F.xxhash64(F.transform("l", lambda x: x["h"]))
    whole = F.array(F.struct(F.lit(0).alias("line"), content.alias("fingerprint"), F.lit(0).alias("pos"),
                             n.alias("size"), F.lit(0).alias("kind"), content.alias("content")))
    # no filter on the windows: pushed below, it would measure the lines again for each of them
    return measured.select(*KEY, F.concat(
        F.when(F.col("filled") & (n < lines), whole).otherwise(F.slice(whole, 1, 0)),
        *[windows(size) for size in range(1, lines + 1)]).alias("windows"))


def fingerprints(found: DataFrame) -> DataFrame:
    """Key, line and fingerprint of every selected line. Windows of a size select ascending lines: equal ones touch."""
    def is_new(w, i):
        before = F.get("windows", i - 1)
        return (i == 0) | (w["line"] != before["line"]) | (w["fingerprint"] != before["fingerprint"])

    return found.select(*KEY, F.explode(F.filter("windows", is_new)).alias("w")).select(
        *KEY, "w.line", "w.fingerprint")


def repeated_windows(docs: DataFrame, lines: int = LINES, words: int = WORDS) -> DataFrame:
    """Key, pos, size and the place (``first``: key, pos) where the same lines come first, for every later window.

    ``docs`` is what ``keyed`` returns.
    """
    found = materialize(winnowed(docs, lines, words), "windows")
    place = F.xxhash64(*KEY, "line")
    repeated = materialize(
        fingerprints(found).groupBy("fingerprint").agg(F.min(place).alias("a"), F.max(place).alias("b"))
        .where("a <> b").select("fingerprint"), "repeated-lines")
    spread = found.select(*KEY, F.explode("windows").alias("w")).select(
        *KEY, "w.fingerprint", "w.pos", "w.size", "w.kind", "w.content")
    again = materialize(spread.join(repeated, "fingerprint"), "repeated")
    same = ["fingerprint", "kind", "content"]
    first = materialize(
        again.groupBy(*same)
        .agg(F.min(F.struct(*KEY, "pos")).alias("first"), F.max(F.struct(*KEY, "pos")).alias("last"))
        .where("first < last").drop("last"), "first-places")
    return (
        again.join(first, same).where(F.struct(*KEY, "pos") > F.col("first"))
        .select(*KEY, "pos", "size", "first").distinct()
    )


def _lines_of(windows: str):
    """The lines of an array of windows, in order, each once."""
    of_each = F.transform(windows, lambda w: F.sequence(w["pos"], w["pos"] + w["size"] - 1))
    return F.array_sort(F.array_distinct(F.flatten(of_each)))


def repeated_runs(docs: DataFrame, lines: int = LINES, words: int = WORDS) -> DataFrame:
    """doc_id, start, length, first_doc, first_start: windows joined to matches along equal distances.

    A run may overlap another that comes from elsewhere.
    """
    found = repeated_windows(keyed(docs), lines, words).withColumns({
        "source": F.struct(F.col("first.has_id"), F.col("first.id"), F.col("first.text_hash")),
        "shift": F.col("pos") - F.col("first.pos")})
    ends = (found.groupBy(*KEY, "source", "shift").agg(F.collect_set(F.struct("pos", "size")).alias("w"))
            .select(*KEY, "source", "shift", _lines_of("w").alias("at")))
    starts = F.filter("at", lambda p, i: (i == 0) | (F.get("at", i - 1) != p - 1))
    stops = F.filter("at", lambda p, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != p + 1))
    runs = ends.select(*KEY, "source", "shift", F.explode(F.arrays_zip(starts.alias("s"), stops.alias("e"))).alias("r"))
    own = F.when(F.col("has_id"), F.col("id"))
    return runs.select(own.alias("doc_id"), F.col("r.s").alias("start"),
                       (F.col("r.e") - F.col("r.s") + 1).alias("length"),
                       F.when(F.col("source.has_id"), F.col("source.id")).alias("first_doc"),
                       (F.col("r.s") - F.col("shift")).alias("first_start"))


def dedup_lines(docs: DataFrame, lines: int = LINES, words: int = WORDS) -> DataFrame:
    """doc_id, n_lines, n_deleted, text (without the later repeated runs) for every row of ``docs``."""
    rows = keyed(docs)
    cuts = (repeated_windows(rows, lines, words).groupBy(*KEY).agg(F.collect_set(F.struct("pos", "size")).alias("w"))
            .select(*KEY, _lines_of("w").alias("cut")))
    joined = rows.join(cuts, list(KEY), "left").select(
        "doc_id", "text", _lines().alias("all"), F.coalesce("cut", F.array().cast("array<int>")).alias("cut"))

    def between(i):
        start = F.when(i == 0, 0).otherwise(F.get("cut", i - 1) + 1)
        end = F.when(i == F.size("cut"), F.size("all")).otherwise(F.get("cut", i))
        return F.slice("all", start + 1, end - start)

    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("cut")), between))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("all")).cast("long")
    return joined.withColumn("kept", F.when(F.size("cut") == 0, F.col("all")).otherwise(kept)).select(
        "doc_id", n.alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(n - F.size("kept")).cast("long")
        .alias("n_deleted"), F.when(F.col("text").isNotNull(), F.array_join("kept", "\n")).alias("text"))
