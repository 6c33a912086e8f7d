"""MinHash near-duplicates against brute force over full sets."""

import random

import numpy as np
import pyarrow as pa

from graphloom.llm import bitmaps, near_dup, text_arrays


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < size else frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, size, percent=80):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, s) in enumerate(sets):
        for b, t in sets[:n]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def edited(text, share, rng):
    words = text.split()
    for i in range(len(words)):
        if rng.random() < share:
            words[i] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_against_brute_force(spark, make_docs, prose, odd_texts):
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate(odd_texts)]
    base = [prose(120, s) for s in range(5)]
    for b in base:
        rows += [(len(rows) + 3, edited(b, share, rng)) for share in (0, 0, 0.01, 0.02, 0.04, 0.05, 0.06, 0.08, 0.1, 0.2)]
    # One large group of near copies around the limit, in which many pairs share buckets and are no links.
    rows += [(1000 + i, edited(base[0], rng.choice([0.03, 0.05, 0.07, 0.1]), rng)) for i in range(120)]
    rows += [(5000 + i, t) for i, t in enumerate(["one", "ONE", "one  two", "one two", "two one", "one two three"])]
    for size in (2, 5):
        assert got(near_dup.near_duplicates(make_docs(rows).repartition(5), size, 80)) == brute(rows, size)


def test_defined_results(spark, make_docs):
    assert got(near_dup.near_duplicates(make_docs([]), 5, 80)) == []
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (9, None), (8, "")]
    df = near_dup.near_duplicates(make_docs(rows), 2, 80)
    assert sorted(df.select("doc_id", "component_id", "kept").collect(), key=str) == sorted([(3, 2, False), (3, 2, False), (None, None, True), (2, 2, True), (9, 9, True), (8, 8, True)], key=str)


def test_keep_one(spark, make_docs):
    rows = [(5, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "x"), (7, None)]
    docs = make_docs(rows)
    kept = near_dup.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([4, None, 7], key=str)


def test_few_decisions_shuffle_no_texts(spark, make_docs):
    docs = make_docs([(5, "a b c d e f"), (4, "a b c d e f"), (7, "x y z")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = near_dup.keep_one(docs, 2, 80)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_many_decisions_shuffle_only_hits(spark, make_docs, monkeypatch):
    """Without a broadcast of the decisions the result is the same; null ids, null texts and repeats included."""
    rows = [(5, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (7, None)]
    rows += [(100 + i, f"w{i} x{i} y{i} z{i}") for i in range(200)]
    docs = make_docs(rows)
    few = near_dup.keep_one(docs, 2, 80).collect()
    monkeypatch.setattr(near_dup, "side", lambda df, **_: df.hint("merge"))
    many = near_dup.keep_one(docs, 2, 80)
    assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, many.collect())) == sorted(map(str, few)) and len(few) == 203


def test_key_filter(spark):
    keys = spark.range(0, 20000, 2).selectExpr("id a", "id * 7 b")
    position, passing = bitmaps.key_filter(keys, keys.count(), "a", "b")
    at = spark.range(20000).selectExpr("id a", "id * 7 b").select("a", position("a", "b").alias("p")).toPandas()
    set_ = passing(at["p"].to_numpy())
    assert set_[at["a"] % 2 == 0].all() and set_[at["a"] % 2 == 1].mean() < 0.05
    empty, none = bitmaps.key_filter(keys.limit(0), 0, "a", "b")
    assert not none(spark.range(1000).select(empty("id").alias("p")).toPandas()["p"].to_numpy()).any()


def test_one_id_on_several_texts(spark, make_docs, prose):
    """Each text is placed by itself: a clean text does not go because another of its id is a copy."""
    a, b, c = (prose(60, s) for s in (1, 2, 3))
    near = a.replace(a.split()[30], "changed", 1)
    docs = make_docs([(1, a), (7, near), (7, b), (7, b), (8, c), (8, c + " x"), (9, ""), (9, None), (None, a), (None, a)])
    got = sorted(((r.doc_id, r.component_id) for r in near_dup.near_duplicates(docs, 2, 80).collect()), key=str)
    assert got == sorted([(1, 1), (7, 1), (7, 7), (7, 7), (8, 8), (8, 8), (9, 9), (9, 9), (None, None), (None, None)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in near_dup.keep_one(docs, 2, 80).collect()), key=str)
    texts = [(d, t) for d, t in kept if d != 9 and d != 8]
    assert texts == sorted([(1, a), (7, b), (None, a), (None, a)], key=str)
    assert [d for d, _ in kept].count(8) == 1 and [d for d, _ in kept].count(9) == 1


def test_hot_group_of_copies(spark, make_docs, prose):
    """A third of all rows is one repeated row, another part one group of near copies."""
    rng = random.Random(9)
    base = prose(80, 4)
    rows = [(5, base)] * 150 + [(100 + i, edited(base, 0.01, rng)) for i in range(100)] + [(1000 + i, prose(70, 50 + i)) for i in range(100)]
    docs = make_docs(rows)
    found = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, 2, 80).collect()}
    assert found == {i: c for i, _, c, _ in brute(list(dict(rows).items()), 2)}
    assert sorted(r.doc_id for r in near_dup.keep_one(docs, 2, 80).collect()) == sorted(i for i, c in found.items() if i == c)


def test_estimate_follows_similarity(spark):
    a, b = near_dup._permutations()
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    rows = []
    for same in (2000, 1500, 500):
        sets = pool[:2000], np.concatenate([pool[2000 - same : 2000], pool[2000 : 4000 - same]])
        low = [text_arrays.mix(near_dup.minima(s, a, b).astype(np.uint64)) for s in sets]
        planes = [[np.packbits((x >> np.uint64(bit) & np.uint64(1)).astype(np.uint8)).view(np.int64) for bit in range(near_dup.BITS)] for x in low]
        exact = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        rows.append((exact, *[np.concatenate(p).tolist() for p in planes]))
    df = spark.createDataFrame(rows, "exact double, x array<long>, y array<long>")
    for exact, est in df.select("exact", near_dup.estimate(df.x, df.y)).collect():
        assert abs(exact - est) < 0.13
    rows_, bands = near_dup.band_shape(0.8)
    assert (1 - 0.8**rows_) ** bands <= near_dup.MISS and near_dup.estimate_floor(0.8) < 0.65


def test_word_hashes_do_not_depend_on_place():
    texts = ["Hello  wORLD", "", "world hello", "\x0bhello\tworld\n", "é hello"]
    column = pa.array(texts)
    values, part = text_arrays.byte_values(text_arrays.BLANKS)
    data, bounds = text_arrays.utf8(column)
    hashes, at = text_arrays.word_hashes(data, bounds, values, part)
    words = [w for t in texts for w in t.encode().lower().split()]
    assert len(words) == len(hashes) and at.tolist() == [0, 2, 2, 4, 6, 8]
    assert len({(w, h) for w, h in zip(words, hashes.tolist(), strict=True)}) == len(set(words)) == len(set(hashes.tolist()))
    sliced, bounds = text_arrays.utf8(column.slice(2, 2))
    assert text_arrays.word_hashes(sliced, bounds, values, part)[0].tolist() == hashes[2:6].tolist()
