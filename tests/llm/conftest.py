import random

import pytest

LONG = 30_000


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns that clash with names inside the operators."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, component long, n int, row long, digest binary, score double, part int, range int"
        data = []
        for i, row in enumerate(rows):
            doc_id, text, lang, source = (*row, None, None)[:4] if len(row) < 4 else row
            data.append((doc_id, text, lang, source, len(text or ""), 1, "k", 2, 3, 4, b"d", 0.5, i % 2, 7))
        return spark.createDataFrame(data, schema)

    return make


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]

    def make(n, seed=None):
        r = random.Random(seed) if seed is not None else rng
        return " ".join(r.choice(words) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, short, non-ASCII, very long and control-character texts."""
    return [None, "", " \n\t ", "a", "Été ß 漢字 😀 end", "x" * LONG, "word " * 6000, "a\x00b\x01c", "İstanbul ΣΑΣ", "1 2 3"]
