"""Long repeated spans against a plain version: copies, edits, loops, odd rows, hashes that collide."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import substring_dedup
from graphloom.llm.substring_dedup import sliding_least
from graphloom.plans.scratch import Scratch


def plain(rows, span):
    texts = [(doc_id, re.findall(r"[^\x20\x09-\x0d]+", text or "")) for doc_id, text in rows]
    first = {}
    for doc_id, words in texts:
        if doc_id is not None:
            for i in range(len(words) - span + 1):
                w = tuple(words[i : i + span])
                first[w] = min(first.get(w, doc_id), doc_id)
    out = []
    for doc_id, words in texts:
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - span + 1 if doc_id is not None else 0):
            if first[tuple(words[i : i + span])] < doc_id:
                gone[i : i + span] = True
        out.append((doc_id, len(words), int(gone.sum()), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return Counter(out)


def got(df):
    assert df.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept", "string")]
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    some = lambda n, kinds=300: [f"W{rng.randrange(kinds)}" for _ in range(n)]
    base, shared, loop = some(400), some(130), ["a", "b", "c"] * 70
    rows = [base, base, shared + some(20), some(15) + shared, some(9) + shared[10:90] + some(30) + shared[60:] + some(5), loop, some(30) + loop[1:120] + some(3), ["x"] * 300, ["x"] * 90 + ["y"]]
    for _ in range(25):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(len(copy))] = rng.choice(["new", "été", "漢字"])
        if rng.random() < 0.4:
            at = rng.randrange(len(copy))
            copy[at:at] = some(rng.randrange(40))
        rows.append(copy[rng.randrange(40) :])
    rows += [base[:200] + shared + base[200:], shared + shared, some(49), base[:50], base[1:50], some(2000, 4), some(900, 3)]
    texts = [rng.choice([" ", "\n", "\t "]).join(words) for words in rows]
    ids = rng.sample(range(-20, 2 * len(texts)), len(texts))
    out = list(zip(ids, texts, strict=True))
    return out + [(None, " ".join(base)), (ids[0], " ".join(shared)), (ids[0], texts[0]), (ids[1], texts[1]), (ids[1], texts[1]), (500, None), (501, ""), (502, " \n")]


@pytest.mark.parametrize("span", [50, 7, 2, 1])
def test_against_a_plain_version(spark, make_docs, corpus, span):
    assert got(substring_dedup.remove_repeats(make_docs(corpus), span)) == plain(corpus, span)


def test_odd_texts(spark, make_docs, odd_texts):
    rows = [(i, t) for i, t in enumerate(odd_texts)] + [(100 + i, t) for i, t in enumerate(odd_texts)]
    assert got(substring_dedup.remove_repeats(make_docs(rows), 50)) == plain(rows, 50)


def test_spans_name_their_sources(spark, make_docs, corpus):
    spans = substring_dedup.repeated_spans(make_docs(corpus), 50).collect()
    keys = {(r.id, r.key): r.text.split() for r in substring_dedup._keyed(make_docs(corpus)).collect()}
    assert spans
    for s in spans:
        assert s.source.id < s.doc_id
        here, there = keys[s.doc_id, s.text_key], keys[s.source.id, s.source.key]
        assert here[s["at"] : s["at"] + s.n + 49] == there[s.source["at"] : s.source["at"] + s.n + 49] and len(here) >= s["at"] + s.n + 49


def test_copies_are_one_path(spark, make_docs, prose):
    """The chunks of a text that only whole copies repeat are compacted to one row, and each later copy to one span."""
    text = prose(3000, 1)
    docs = substring_dedup._keyed(make_docs([(i, text) for i in range(6)]))
    graph = substring_dedup._Graph(docs, 50, Scratch(spark, "t"))
    rows = graph.occurrences()
    assert rows.count() > 6 * 100
    paths = graph.paths(graph.different(rows)).collect()
    assert [(p.source.id, p.source["at"], p.windows) for p in paths] == [(0, 0, 2951)]
    assert substring_dedup.repeated_spans(make_docs([(i, text) for i in range(6)])).count() == 5


def test_unique_texts_write_no_chunks(spark, make_docs, prose):
    docs = substring_dedup._keyed(make_docs([(i, " ".join(f"{i}-{k}" for k in range(300))) for i in range(40)]))
    assert substring_dedup._Graph(docs, 50, Scratch(spark, "t")).occurrences().count() < 10


def test_unlike_spans_of_one_hash_stay(spark, make_docs, prose, monkeypatch):
    """With hashes of a few bits many unlike windows are taken for one; the digests of their words tell."""
    monkeypatch.setattr(substring_dedup, "_runs", lambda sums, starts, ends: np.zeros(len(starts), np.uint64))
    rows = [(i, prose(60 + i, i)) for i in range(8)]
    assert got(substring_dedup.remove_repeats(make_docs(rows), 50)) == plain(rows, 50)


def test_merged_and_broadcast_sides_agree(spark, make_docs, corpus, monkeypatch):
    few = got(substring_dedup.remove_repeats(make_docs(corpus), 20))
    monkeypatch.setattr(substring_dedup, "side", lambda df, **_: df.hint("merge"))
    assert got(substring_dedup.remove_repeats(make_docs(corpus), 20)) == few


@pytest.mark.parametrize("n,width", [(40, 1), (40, 2), (40, 35), (40, 40), (9, 7), (33, 16)])
def test_sliding_least(n, width):
    x = np.random.default_rng(n).integers(0, 99, n)
    assert sliding_least(x, width).tolist() == [x[i : i + width].min() for i in range(n - width + 1)]


def test_empty(spark, make_docs):
    assert substring_dedup.remove_repeats(make_docs([])).count() == 0
    assert substring_dedup.repeated_spans(make_docs([])).where(F.col("n") > 0).count() == 0
