"""Rows for the tests of the training-data operators."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def documents(spark, rows, source="a"):
    """(doc_id, text) rows as a documents table with an extra column of a clashing name."""
    return spark.createDataFrame([(i, t, "en", source, len(t or ""), "x") for i, t in rows], DOCS)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def edited(text, seed, n):
    """``text`` with ``n`` words replaced."""
    rng = random.Random(seed)
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(words)


#: Texts every operator has to stand.
ODD = [None, "", " \n\t ", "one", "\x00 \x1c ￿ \U0001f600", "a" * 50_000, "word " * 30_000, "# " * 500, "\n" * 100]
