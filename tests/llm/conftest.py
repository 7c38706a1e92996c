import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, node int, path string, hits int"


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(7)
    syllables = ["an", "er", "th", "ing", "on", "es", "ti", "re", "or", "ou", "st", "ly"]

    def make(n, seed=None):
        r = random.Random(seed) if seed is not None else rng
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def rows(prose):
    """Documents with copies, near copies, shared passages, nulls, empty texts and a very long text."""
    base, passage = prose(300, 1), prose(70, 2)
    near = base.split()
    near[150] = "changed"
    out = [
        (1, base, "en"), (2, base, "en"), (3, " ".join(near), "en"), (4, prose(120, 3) + " " + passage, "en"), (5, passage + "\n" + prose(90, 4), None),
        (6, None, "en"), (7, "", None), (8, "  \t\n ", "fr"), (9, "one", "fr"), (10, "one", "fr"), (11, "ONE two", "fr"), (12, prose(5000, 5), "de"),
        (13, (prose(60, 6) + " ") * 3, "de"), (None, prose(80, 8), "en"), (15, "naïve café 日本語 " + prose(60, 9), "de"), (16, base.upper(), "en"),
        (17, "same line here\nsame line here\nother", "en"), (18, "a\x00b c d e", "en"), (19, passage, "en"),
    ]
    return [(i, t, lang, "s", len(t or ""), "clash", 3, "p", 1) for i, t, lang in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")
