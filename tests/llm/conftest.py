import random

import pytest

WORDS = [a + b + c for a in ("ka", "lo", "mi", "nu", "pe", "ro") for b in ("ta", "ve", "wi", "xo", "zu") for c in ("", "n", "rs", "ly", "th")]


@pytest.fixture()
def docs(spark):
    """Documents from texts or (id, text) pairs, with columns whose names the operators use themselves."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        kind = "doc_id long, text string, key string, node long, n int, body string, _kept int, _bad int, deal long"
        return spark.createDataFrame([(i, t, "x", 1, 2, "b", 3, 4, 5) for i, t in rows], kind)

    return make


@pytest.fixture()
def prose():
    """prose(seed, n): n words of invented prose."""

    def make(seed, n=60):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) for _ in range(n))

    return make
