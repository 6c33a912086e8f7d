"""Phrase mining against a plain count, over odd texts, languages and bitmaps that are too small."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import bitmaps, phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, longest=3, least=10, top=2000, inside=50):
    counts = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        long = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        kept = []
        for p, a in long.items():
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            around = [c for q, c in long.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * c >= inside * a for c in around):
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def got(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocabulary = ["New", "york", "City", "été", "漢字", "a-b", "x.", "tax;", "q\x00r", "the", "of"]
    make = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", " ? "]) for _ in range(n))
    rows = [(make(rng.randrange(1, 60)), rng.choice(["en", "en", "de", None, "und"])) for _ in range(150)]
    rows += [("New York City hall " * 30, "en"), ("deep deep deep deep " * 20, "de"), ("same words here " * 11, "fr")] * 2
    return rows + [(None, "en"), ("", "xx"), (" .,\n", None), ("one", "yy"), ("word " * 6000, "long")]


def docs_of(make_docs, rows):
    return make_docs([(i % 90 if i % 7 else None, text, lang, "s") for i, (text, lang) in enumerate(rows)])


def test_against_a_plain_count(spark, make_docs, corpus):
    assert got(phrases.mine(docs_of(make_docs, corpus))) == plain(corpus)


def test_longer_runs_and_fewer_ranks(spark, make_docs, corpus):
    options = {"longest": 4, "least": 5, "top": 7}
    assert got(phrases.mine(docs_of(make_docs, corpus), inside_percent=30, **options)) == plain(corpus, inside=30, **options)


def test_many_flushes_and_full_bitmaps(spark, make_docs, corpus, monkeypatch):
    """Tasks count often, and bitmaps of a few bits let nearly all runs pass: the result stays."""
    monkeypatch.setattr(phrases, "FLUSH", 50)
    monkeypatch.setattr(phrases, "MAX_BITS", 1 << 14)
    monkeypatch.setattr(phrases, "bits_for", lambda count: 64)
    assert got(phrases.mine(docs_of(make_docs, corpus))) == plain(corpus)


def test_rare_runs_are_not_counted_exactly(spark, make_docs, prose):
    from graphloom.plans.scratch import Scratch

    rows = [(prose(200, i), "en") for i in range(20)] + [("alpha beta gamma " * 12, "en")]
    seen = []
    table = Scratch.table

    def spy(self, df, name="t", **options):
        out = table(self, df, name, **options)
        if name == "counts-3":
            seen.extend(r.phrase for r in out.where("phrase IS NOT NULL").collect())
        return out

    Scratch.table = spy
    try:
        phrases.mine(docs_of(make_docs, rows)).count()
    finally:
        Scratch.table = table
    assert "alpha beta gamma" in seen and len(set(seen)) < 10


def test_products_over_64_bits(spark):
    big = 9_000_000_000_000
    row = spark.sql(f"SELECT cast(1000000 AS decimal(7, 0)) * {{a}} * {{a}} DIV ({{a}} * {{a}}) AS s".replace("{a}", f"cast({big} AS decimal(14, 0))")).first()
    assert row.s == 1_000_000


def test_bucket_rows_stop_at_the_least_count():
    places = np.array([5] * 30 + [6] * 3 + [phrases.BLOCK + 1], np.int64)
    batch = next(iter(phrases._bucket_rows(places, 10)))
    assert batch.column("block").to_pylist() == [0, 1]
    assert [np.frombuffer(x, "<u2").tolist() for x in batch.column("places").to_pylist()] == [[5, 6], [1]]
    assert [np.frombuffer(x, "<u2").tolist() for x in batch.column("counts").to_pylist()] == [[10, 3], [1]]


def test_bitmap_of_positions(spark):
    passing = bitmaps.set_positions(spark.createDataFrame([(0,), (9,), (40_000,), (40_000,)], "p long"), 1 << 20)
    assert passing(np.array([0, 1, 9, 39_999, 40_000, (1 << 20) - 1])).tolist() == [True, False, True, False, True, False]


def test_empty(spark, make_docs):
    assert got(phrases.mine(make_docs([]))) == []
    assert got(phrases.mine(make_docs([(1, None, "en", "s"), (2, "a b", None, "s")]))) == []
