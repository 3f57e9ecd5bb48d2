import random

import pytest


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text) pairs or longer rows, with clashing further columns."""

    def make(rows, clash=True):
        full = [(i, t, *(rest or ("en", "s"))) for i, t, *rest in rows]
        df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], "doc_id long, text string, lang string, source string, n_chars long")
        if clash:
            for c in ("bucket", "version", "score", "blob", "found", "node", "part", "copy", "rate", "value", "place"):
                df = df.selectExpr("*", f"'x' AS {c}")
        return df.repartition(3)

    return make


WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture
def prose():
    """Seeded texts of n words."""
    rng = random.Random(5)
    return lambda n: " ".join(rng.choice(WORDS) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (None, "an id that is null, here"), (7, "tie"), (7, "tie"), (7, "other text of 7"), (8, "ñ é 漢字   \x00 \U0001f600 end")]


@pytest.fixture
def odd():
    """Nulls, empty texts, ties, repeated rows and a very long text."""
    return [*ODD, (9, "long text " * 60_000)]
