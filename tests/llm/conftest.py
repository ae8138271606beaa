"""Small tables with every odd case: nulls, empty and long texts, ties, rows that repeat, clashing column names."""

import random

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def doc(i, text, source="s", lang="en"):
    return (i, text, lang, source, None if text is None else len(text))


def odd_documents():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7)))
    rows = []
    for i in range(40):
        rows.append(doc(i, " ".join(word() for _ in range(r.randint(20, 120))).capitalize() + "."))
    base = rows[3][1]
    rows += [doc(40, base), doc(41, base), doc(41, base), doc(42, base + " tail word"), doc(43, base.upper())]
    rows += [doc(None, None, None, None), doc(44, None), doc(45, ""), doc(46, " \n\t "), doc(47, "one"), doc(48, "a b　c 漢字 🙂 é İ Σ")]
    rows += [doc(49, "same line\n" * 30), doc(50, "x" * 5000), doc(51, "ab " * 4000), doc(52, " ".join(word() for _ in range(20_000)))]
    rows += [doc(53, "<|endoftext|> it's 1234 we'll <|startoftext|>!!  \n\n x"), doc(54, "a b c"), doc(55, "A b C")]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_documents(), DOC).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)
