from __future__ import annotations

import pathlib
import random
import re

import duckdb
import pytest

from stayline.llm import line_dedup
from stayline.llm.queries import ORACLE, QUERIES


def without_repeats(texts: list[str]) -> list[str]:
    """Brute force over the lines of documents that come in this order: what stays of each."""
    seen, out = set(), []
    for text in texts:
        lines, gone = text.split("\n"), set()
        for i in range(len(lines)):
            for size in (1, 2, 3):
                run = tuple(lines[i:i + size])
                if len(run) < size or (size < 3 and sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in run) < 50):
                    continue
                gone |= set(range(i, i + size)) if run in seen else set()
                seen.add(run)
        if text and len(lines) < 3:
            gone |= set(range(len(lines))) if ("text", text) in seen else set()
            seen.add(("text", text))
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def deduped(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    return [r.text for r in sorted(line_dedup.dedup_lines(df).collect(), key=lambda r: r.doc_id)]


def test_short_runs_are_judged_by_their_words(spark):
    words = [f"w{i}" for i in range(60)]
    long, half, rest = " ".join(words[:50]), " ".join(words[:25]), " ".join(words[25:50])
    texts = [f"head\n{long}", f"{long}\ntail", " ".join(words[:49]), " ".join(words[:49]) + "\nx", f"a\n{half}\n{rest}",
             f"{half}\n{rest}\nb", f"{half}\nc", "yes\nno", "yes\nno", "yes", "yes", "no\nyes", "", "", "\n", "\n",
             f"{long}\n{long}", f"q\n{long}\nyes\nr"]
    got = deduped(spark, texts)
    assert got == without_repeats(texts)
    assert got[1] == "tail" and got[3] == texts[3] and got[5] == "b" and got[6] == texts[6]
    assert got[7:12] == ["yes\nno", "", "yes", "", "no\nyes"] and got[16:] == ["", "q\nyes\nr"]


def test_matches_brute_force(spark):
    draw = random.Random(4)
    pool = [" ".join(draw.choice("abc") for _ in range(draw.choice((1, 2, 20, 30, 49, 50)))) for _ in range(12)] + ["", " "]
    texts = ["\n".join(draw.choice(pool) for _ in range(draw.choice((1, 1, 2, 2, 3, 5, 9)))) for _ in range(150)]
    # a text of a megabyte, and a group of copies that holds a third of all rows
    texts += ["\n".join(f"line {i % 700} of {i // 7}" for i in range(60_000))] + ["hot\nline"] * 80
    assert deduped(spark, texts) == without_repeats(texts)


def test_runs_say_where_they_come_from(spark):
    long = " ".join(["w"] * 50)
    df = spark.createDataFrame([(1, f"x\n{long}\na\nb"), (2, f"y\n{long}\na\nb"), (3, "k"), (4, "k")], "doc_id long, text string")
    assert {tuple(r) for r in line_dedup.repeated_runs(df).collect()} == {(2, 1, 3, 1, 1), (4, 0, 1, 3, 0)}


def test_later_runs_go(spark):
    run = "a\nb\nc\nd"
    rows = [(1, f"x\n{run}\ny"), (2, f"{run}\nz"), (3, "a\nb\nq"), (4, f"p\n{run}\n{run}"), (5, None), (6, ""), (7, "b\nc"),
            (8, "x\na\nb\nc"), (8, "x\na\nb\nc"), (None, "m\nn\no"), (None, "m\nn\no"), (9, "m\nn\no\nr")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "'k' AS windows")
    got = {(r.doc_id, r.n_lines, r.n_deleted, r.text) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {(1, 6, 0, rows[0][1]), (2, 5, 4, "z"), (3, 3, 0, "a\nb\nq"), (4, 9, 8, "p"), (5, 0, 0, None), (6, 1, 0, ""),
                   (7, 2, 0, "b\nc"), (8, 4, 4, ""), (None, 3, 0, "m\nn\no"), (9, 4, 3, "r")}
    assert line_dedup.dedup_lines(df).count() == len(rows)
    runs = {tuple(r) for r in line_dedup.repeated_runs(df).collect()}
    assert (2, 0, 4, 1, 1) in runs and (4, 1, 4, 1, 1) in runs and (4, 5, 4, 1, 1) in runs
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for file in pathlib.Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    df = QUERIES[name](spark, folder)
    columns = ", ".join(df.columns)
    expected = con.sql(f"SELECT {columns} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, expected))


def test_native(spark):
    plan = line_dedup.dedup_lines(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert "Python" not in plan._jdf.queryExecution().toString() and "Arrow" not in plan._jdf.queryExecution().toString()
