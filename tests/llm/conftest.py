import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, rep long, t string, src int, size long, kept boolean, `row` long, pred string"


def table(spark, rows):
    """documents with extra columns whose names the operators use themselves."""
    full = [(*r, None, 7, 7, "x", 7, 7, True, 7, "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


WORDS = {
    "en": "the of and to in that is was for with his they this have from".split(),
    "de": "der die und das nicht ein ist mit sich auf für eine auch werden über".split(),
}


def prose(rng, lang, n):
    pool = WORDS[lang]
    return " ".join(rng.choice(pool) + rng.choice(["", "", rng.choice(pool)]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(5)
    out = [(0, None, "en", "a"), (1, "", "en", "b"), (2, " \n\t ", None, None), (3, "one two", "en", "b"), (4, "ONE  two", "en", "b"), (None, "no id here at all", "en", "a")]
    base = prose(rng, "en", 120).split(" ")
    for i in range(5, 95):  # near copies: more than a hot column's bound, each with its own edit
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"edit{i}x{rng.randrange(99)}"
        out.append((i, " ".join(w), "en", "a"))
    shared = prose(rng, "en", 60)
    for i in range(100, 190):  # one passage in many documents that are otherwise unlike
        out.append((i, f"{prose(rng, 'de', rng.choice([3, 9, 14, 30, 80]))} {shared}", "de", "a" if i % 3 else None))
    for i in range(200, 240):
        lang = rng.choice(["en", "de"])
        out.append((i, prose(rng, lang, rng.randrange(1, 60)) + rng.choice(["", ".\n", "\n" + "again and again\n" * 4]), lang, rng.choice("abc")))
    out.append((250, prose(rng, "de", 20_000), "de", "c"))
    out.append((251, out[20][1] + " ", "en", "b"))
    out.append((251, out[20][1] + " ", "en", "b"))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return table(spark, rows).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])
