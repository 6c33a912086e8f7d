"""Pairs of terms that tell nothing alone: against a plain count of all pairs, and with terms rarer than thousands of others."""

import math
import random
import zlib
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import queries, toxicity
from graphloom.llm.toxicity import BUCKETS, Training


def pair_rows(n, seed):
    """Rows whose label is that of terms 500 and 501 standing together or both missing."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        terms = {t for t in range(60) if rng.random() < 0.3} | {BUCKETS - 1} | {t for t in (500, 501) if rng.random() < 0.5}
        rows.append((int((500 in terms) == (501 in terms)), i, sorted(terms)))
    return rows


def test_pair_terms_against_all_pairs(spark):
    how, rows = Training(min_pair_nats=6.0), pair_rows(900, 4)
    seen = np.bincount([t for _, _, terms in rows for t in terms], minlength=BUCKETS).astype(float)
    used = np.zeros(BUCKETS, bool)
    used[3] = True
    frame = spark.createDataFrame(rows, "label int, key long, terms array<int>").repartition(5)
    got = set(toxicity.pair_terms(frame, seen, used, len(rows), how).tolist())
    able = {t for t in range(BUCKETS) if how.pair_rows <= seen[t] <= 0.6 * len(rows)}
    rate = lambda h, n: math.log((h + 0.5) / (n - h + 0.5))
    hit = {t: sum(y for y, _, terms in rows if t in terms) for t in able}
    want = set()
    for a, b in combinations(sorted(able), 2):
        both = [y for y, _, terms in rows if a in terms and b in terms]
        if len(both) < how.pair_rows:
            continue
        p, s = 1 / (1 + math.exp(-(rate(hit[a], seen[a]) + rate(hit[b], seen[b]) - rate(sum(y for y, _, _ in rows), len(rows))))), sum(both) / len(both)
        nats = len(both) * sum(x * math.log(x / q) for x, q in ((s, p), (1 - s, 1 - p)) if x > 0)
        if nats >= how.min_pair_nats:
            want |= {a, b}
    assert {500, 501} <= want and got == want - {3}


def test_pairs_on_a_thinned_sample_and_on_none(spark):
    rows = [(y, zlib.crc32(str(i).encode()) * 7919, terms) for y, i, terms in pair_rows(3000, 5)]
    seen = np.bincount([t for _, _, terms in rows for t in terms], minlength=BUCKETS).astype(float)
    frame, used = spark.createDataFrame(rows, "label int, key long, terms array<int>"), np.zeros(BUCKETS, bool)
    assert {500, 501} <= set(toxicity.pair_terms(frame, seen, used, len(rows), Training(pair_entries=20_000)).tolist())
    assert not len(toxicity.pair_terms(frame.where("key < 0"), seen, used, len(rows), Training()))
    assert not len(toxicity.pair_terms(frame, seen, used, len(rows), Training(pair_rows=5000)))


def test_rare_terms_that_tell_nothing_alone(spark, make_docs):
    rng = random.Random(6)
    rows = []
    for i in range(6000):
        words = [f"w{rng.randrange(1500)}x" for _ in range(110)]
        kind, toxic = i % 25, rng.random() < 0.5
        if kind < 2:
            toxic = kind == 0
            words += ["Dolts,", "islanders"] if toxic else [rng.choice(["dolts", "Islanders!"])]
        elif toxic:
            words.append("awful")
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic), kind))
    frequent = sum(1 for _, text, _, _ in rows for w in set(text.lower().split()) if w == "w7x")
    assert frequent > sum("dolts" in text.lower() for _, text, _, _ in rows)
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows], "doc_id long, label int")
    got = {r.doc_id: r for r in toxicity.predict(make_docs([(i, t) for i, t, _, _ in rows]), labels, queries.learns(5, 0)).collect()}
    held = [(i, y) for i, _, y, kind in rows if kind < 2 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 60 and np.mean([got[i].predicted == y for i, y in held]) > 0.9
    assert np.mean([r.predicted == y for (_, _, y, _), r in zip(rows, (got[i] for i in range(6000)), strict=True)]) > 0.97


def test_the_driver_holds_few_bytes_a_term(spark):
    """Some two million terms: under 40 bytes of the driver's Python for each."""
    import tracemalloc

    terms = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(499)), lambda i: F.pmod(F.hash("id", i), F.lit(5000)).cast("int")))
    rows = spark.range(4000).select((F.col("id") % 2).cast("int").alias("label"), F.col("id").alias("key"), terms.alias("terms"))
    number = rows.agg(F.sum(F.size("terms"))).first()[0]
    seen = np.zeros(toxicity.BUCKETS)
    seen[:5000] = 400
    tracemalloc.start()
    try:
        toxicity.pair_terms(rows, seen, np.ones(toxicity.BUCKETS, bool), 4000, toxicity.Training())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert number > 1_800_000 and peak < 40 * number
