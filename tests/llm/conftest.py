from __future__ import annotations

import random

import pytest

SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split(),
             "fr": "eau oi ou é è ç que ment tion aux eux elle re ch vi pa ier an en on de la".split()}


def sentence(rng, n, lang="en"):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def odd_texts():
    return [None, "", " ", "\n\n\n\n", "one", "  two  spaces ", "A B\tC\nD", "é́ ñ x", "<|endoftext|> x <|startoftext|>y",
            "12345 --- !!", "word " * 3000, "İstanbul ſtraße ΑΣ", "a b c", "x" * 5000]


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with odd texts, copies, near copies, repeated rows and ids, a hot source, NULLs, and clashing columns."""
    rng = random.Random(5)
    rows = [(i, t, "en" if i % 2 else None, "src0") for i, t in enumerate(odd_texts())]
    base = sentence(rng, 220)
    words = base.split()
    for i in range(40):
        changed = list(words)
        for _ in range(rng.randint(0, 3)):
            changed[rng.randrange(len(changed))] = "changed"
        rows.append((100 + i, " ".join(changed), "en", "src0"))
    for i in range(60):
        lang = "fr" if i % 3 == 0 else "en"
        text = "\n".join(sentence(rng, rng.randint(3, 25), lang).capitalize() + "." for _ in range(rng.randint(1, 9)))
        rows.append((200 + i, text, lang, rng.choice(["src1", "src2", None])))
    shared = "\n".join(sentence(rng, 8) for _ in range(5))
    for i in range(8):
        rows.append((300 + i, sentence(rng, 12) + "\n" + shared + "\n" + sentence(rng, 9), "en", "Z"))
    rows += [(350, rows[0][1], "en", "Z"), (351, base, "fr", "Z"), (351, base, "fr", "Z"), (352, base, None, None),
             (None, "no id here at all", "en", "Z"), (None, base, "en", "src1"), (-7, sentence(rng, 40), "en", "Z")]
    full = [(i, t, lang, s, 0, "other", 1.5, -1) for i, t, lang, s in rows]
    return spark.createDataFrame(
        full, "doc_id long, text string, lang string, source string, n_chars long, size string, target double, _row int"
    ).repartition(5)


@pytest.fixture(scope="session")
def rows(documents):
    return documents.select("doc_id", "text", "lang", "source").collect()


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.where("false")


def counted(items):
    from collections import Counter
    return Counter(items)
