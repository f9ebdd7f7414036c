import random

import pytest

SYLLABLES = "ka lo mi re tu ves an der ist qu e".split()


def sentence(rng, n):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): copies, near copies, shared passages, odd characters, nulls, repeated rows."""
    rng = random.Random(7)
    base = ["\n".join(sentence(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 8))) for _ in range(40)]
    passage = sentence(rng, 60)
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 2}") for i, t in enumerate(base)]
    rows += [(100 + i, base[0], "en", "s0") for i in range(5)]
    rows += [(110 + i, base[1].replace(base[1].split(" ")[3 + i], "changed", 1), "en", "s1") for i in range(4)]
    rows += [(120 + i, f"{sentence(rng, 8)}\n{passage}\n{sentence(rng, 9)}", "en", None) for i in range(4)]
    rows += [(130, "", "en", "s0"), (131, None, None, "s0"), (132, " \n\t ", "en", "s0"), (133, "one two", "en", "s1"), (134, "one two", "en", "s1")]
    rows += [(140, "naïve 日本  x 😀\x1c\ny▁z  two  spaces\r\nend ", "fr", "s1"), (141, "again " * 300, "en", "s0"), (142, sentence(rng, 12) + "\n\n\n", "en", "s0")]
    rows += [(None, base[2], "en", "s0"), (50, base[3], "en", "s0"), (50, base[3], "en", "s0")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_tokens string, score string, block string"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names clash with the operators' own."""
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in corpus], SCHEMA).repartition(3)
    path = frame.cache()
    path.count()
    return path


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
