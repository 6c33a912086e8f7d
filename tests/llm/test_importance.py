"""Importance resampling against a plain version, over odd texts, ids and tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.llm import importance
from graphloom.plans.ranges import ranked
from graphloom.plans.scratch import Scratch


def plain_features(text, orders):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    return len(words), [" ".join(words[i : i + k]) for k in range(1, orders + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, orders=2, buckets=10_000, percent=25, min_words=20, seed=7):
    def tally(texts):
        return Counter(zlib.crc32(g.encode()) % buckets for t in texts for g in plain_features(t, orders)[1])

    s, t = tally(x for _, x in docs), tally(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((n + 1) * (big_t + buckets)))) for b, n in s.items()}
    rows = []
    for doc_id, text in docs:
        n_words, grams = plain_features(text, orders)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n_words])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = percent * len(able) // 100
    ranks = {id(r): i + 1 for i, r in enumerate(able[:drawn])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in rows), key=str)


def got(df):
    assert df.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    return sorted(map(tuple, df.collect()), key=str)


def test_against_a_plain_version(spark, make_docs, prose, odd_texts):
    rows = [(i, t) for i, t in enumerate(odd_texts)] + [(100 + i, prose(15 + i, i)) for i in range(40)]
    rows += [(None, prose(30, 3)), (-5, prose(25, 9)), (300, "Straße ÉTÉ x" + " Ab_c 7-UP" * 12)]
    target = [prose(40, 2), prose(50, 5), None, "7 up " * 30]
    aims = spark.createDataFrame([(t, "k", 1, 2) for t in target], "text string, bucket string, row int, gain int")
    assert got(importance.resample(make_docs(rows), aims)) == plain(rows, target)
    options = {"orders": 3, "buckets": 50, "percent": 60, "min_words": 1, "seed": 9}
    assert got(importance.resample(make_docs(rows), aims, **options)) == plain(rows, target, **options)


def test_repeated_rows_take_ranks_apart(spark, make_docs, prose):
    rows = [(4, prose(30, 1))] * 9 + [(5, prose(30, 1))] * 3
    out = importance.resample(make_docs(rows), spark.createDataFrame([(prose(30, 1),)], "text string"), percent=50)
    assert sorted(r["rank"] for r in out.collect() if r["rank"]) == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("n_docs,n_target", [(0, 0), (0, 2), (3, 0)])
def test_empty_tables(spark, make_docs, prose, n_docs, n_target):
    rows, target = [(i, prose(30, i)) for i in range(n_docs)], [prose(9, i) for i in range(n_target)]
    assert got(importance.resample(make_docs(rows), spark.createDataFrame([(t,) for t in target], "text string"))) == plain(rows, target)


def test_floored_mean_goes_down(spark):
    totals = [(-7, 2), (7, 2), (-6, 3), (0, 5), (-1, 10**12), (5, 0)]
    rows = spark.createDataFrame(totals, "t long, n long").select(importance.floored_mean(F.col("t"), F.col("n")).alias("m")).collect()
    assert [r.m for r in rows] == [-4, 3, -2, 0, -1, 0]


def test_ranks_over_many_ranges(spark):
    rows = spark.range(5000).repartition(7).selectExpr("id AS row", "(id * 7919) % 313 AS score")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranked(rows, [F.col("score").desc(), F.col("row").asc()], Scratch(spark, "t")).orderBy("place").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.place for r in out] == list(range(1, 5001))
    assert [(r.score, r.row) for r in out] == sorted(((r.score, r.row) for r in out), key=lambda x: (-x[0], x[1]))


def test_no_python_in_the_plan(spark, make_docs, prose):
    out = importance.resample(make_docs([(1, prose(30))]), spark.createDataFrame([("a b",)], "text string"))
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
