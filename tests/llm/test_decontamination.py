from __future__ import annotations

import random
import re
import string

import pytest

from stayline.llm import decontamination as dec

from .conftest import sentence


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(8)
    items = [(i, sentence(rng, rng.randint(15, 40))) for i in range(12)] + [(50, None), (51, ""), (52, "too short"), (53, "x y z")]
    items.append((60, items[0][1].upper()))  # equal tokens: one item
    rows = [(1000 + i, sentence(rng, 80)) for i in range(20)] + [(2, None), (3, ""), (4, "a b")]
    for i in range(12):
        words = items[i][1].split()
        for at in range(4, len(words), 6):
            words[at] = "other" if i % 2 else words[at]
        rows.append((i + 100, sentence(rng, 30) + " " + " ".join(words) + "!!! " + sentence(rng, 30)))
    rows.append((200, items[3][1][:20]))  # too small a part
    rows.append((201, (items[4][1] + " " + sentence(rng, 300) + " ") * 3))
    rows += [(None, items[5][1]), (100, rows[23][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS tokens")
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "2 AS tokens", "'s' AS seed"), bench, rows, items


def plain_tokens(text):
    lowered = (text or "").lower()
    return re.sub("[" + re.escape(string.punctuation) + "]", "", lowered).split()


def plain_side(a, b):
    """Equal and other tokens of the best way on, token by token."""
    score = equal = best = 0
    found = (0, 0)
    for n, (x, y) in enumerate(zip(a, b, strict=False), 1):
        score, equal = (score + 1, equal + 1) if x == y else (score - 2, equal)
        if score > best:
            best, found = score, (equal, n - equal)
        if max(best, 0) - score >= 6:
            break
    return found


def brute(rows, items, least=13):
    """Plain Python over words, with nothing of the library but its masks."""
    unique = {}
    for i, text in items:
        words = tuple(plain_tokens(text))
        if words:
            known = unique.get(words)
            unique[words] = i if known is None else known if i is None else min(known, i)
    out = []
    for doc, text in rows:
        tokens, found = plain_tokens(text), {}
        for item, name in unique.items():
            masks = [m for m in dec.MASKS if m[-1] < len(item)] if len(item) >= 6 else [tuple(range(len(item)))]
            for mask in masks:
                for i in range(len(tokens) - mask[-1]):
                    for j in range(len(item) - mask[-1]):
                        if all(tokens[i + k] == item[j + k] for k in mask):
                            right = plain_side(tokens[i:], item[j:])
                            left = plain_side(tokens[:i][::-1], item[:j][::-1])
                            equal, other = right[0] + left[0], right[1] + left[1]
                            if equal >= min(least, len(item)):
                                found[item] = max(found.get(item, (0, 0)), (equal, -other))
        best = max(((e, o, name is not None, -(name or 0), name) for (e, o), name in
                    ((found[t], unique[t]) for t in found)), key=lambda b: b[:4], default=(0, 0, 0, 0, None))
        out.append((doc, bool(found), len(found), best[4], best[0], -best[1]))
    return out


def test_against_brute_force(planted):
    docs, bench, rows, items = planted
    got = dec.decontaminate(docs, bench).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, items)))
    marked = {r.doc_id: r for r in got if r.contaminated}
    assert set(marked) == {*range(100, 112), 201, None}
    assert marked[100].item == 0 and marked[100].equal == len(items[0][1].split()) and marked[101].other > 0


def test_short_nameless_and_clashing_items_and_long_overlaps(spark):
    rng = random.Random(3)
    long, nameless, first, second = sentence(rng, 400), sentence(rng, 20), sentence(rng, 18), sentence(rng, 18)
    items = [(1, long), (None, nameless), (5, first), (5, second), (7, "zz yy xx"), (None, "qq"), (8, "..."), (None, None)]
    rows = [(1, sentence(rng, 30) + " " + long + " " + sentence(rng, 30)), (2, nameless), (3, first), (4, second), (5, "aa zz yy. XX bb"),
            (6, "zz yy aa xx"), (7, "qq " * 500), (8, first + " " + nameless), (None, "ends with qq"), (9, sentence(rng, 2000) + " " + first)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, map(tuple, dec.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect())))
    assert got == sorted(map(str, brute(rows, items)))
    found = {r[0]: r for r in brute(rows, items)}
    assert found[1][4] == 400 and found[2][1:5] == (True, 1, None, 20) and found[5][3] == 7 and not found[6][1] and found[8][2] == 2


def test_clean_documents(planted):
    docs, bench, rows, _ = planted
    kept = dec.clean_documents(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 200, *range(1000, 1020)]
    assert dec.clean_documents(docs, bench.where("false")).count() == len(rows)
    assert dec.decontaminate(docs.where("false"), bench).count() == 0


def test_overlap_tolerates_substitutions():
    a = dec.token_hashes("a b c d e f g h i j k l m n o p")
    b = dec.token_hashes("a b c X e f g h Y j k l m n o p")
    assert dec.extend(a, b, 4, 4) == (14, 2)
    assert dec.extend(a, dec.token_hashes("z z z z e f g h z z z z z z z z"), 4, 4) == (4, 0)
