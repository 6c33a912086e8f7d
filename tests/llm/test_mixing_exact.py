"""Budgets against plain water-filling over random trees, and prefixes over repeated rows."""

import random

from pyspark.sql import functions as F

from graphloom.llm import mixing
from graphloom.llm.mixing import Mix

LEVELS = ("domain", "lang", "source")


def fill(children, budget):
    """``children``: (name, capacity, weight) -> budget by name: all whose share covers them are full, again and again."""
    open_, got, rest = [c for c in children if c[2] > 0], {c[0]: 0 for c in children}, budget
    while True:
        total = sum(w for _, _, w in open_)
        full = [c for c in open_ if c[1] * total <= rest * c[2]]
        if not full:
            break
        for name, cap, _ in full:
            got[name] = cap
        rest, open_ = rest - sum(c[1] for c in full), [c for c in open_ if c not in full]
    before = 0
    for name, _, w in sorted(open_):
        got[name] = rest * (before + w) // total - rest * before // total
        before += w
    return got


def plain(leaves, mix):
    weight = lambda depth, name: mix.weights.get(mix.levels[depth], {}).get(name, mix.default_weight)

    def capacity(prefix):
        return sum(n * mix.max_epochs for path, n in leaves.items() if path[: len(prefix)] == prefix and all(weight(i, x) for i, x in enumerate(path)))

    out = {}

    def down(prefix, budget):
        depth = len(prefix)
        if depth == len(mix.levels):
            out[prefix] = budget
            return
        names = {path[depth] for path in leaves if path[:depth] == prefix}
        for name, share in fill([(n, capacity((*prefix, n)), weight(depth, n)) for n in names], budget).items():
            down((*prefix, name), share)

    down((), min(mix.budget, capacity(())))
    return out


def test_budgets_over_random_trees(spark):
    rng = random.Random(17)
    for i in range(5):
        names = [f"n{j}" for j in range(4)]
        leaves = {(rng.choice(names), rng.choice(names), f"s{rng.randrange(9)}"): rng.choice([1, 7, 40, 900, 10**6, 10**13]) for _ in range(25)}
        weights = {level: {n: rng.choice([0, 1, 2, 5]) for n in names} for level in LEVELS[:2]} | {"source": {f"s{j}": rng.choice([0, 1, 3]) for j in range(5)}}
        total = 2 * sum(leaves.values())
        mix = Mix(levels=LEVELS, weights=weights if i else {}, budget=rng.choice([total // 3, total // 50, 13, 2 * total]), max_epochs=2)
        df = spark.createDataFrame([(*path, n) for path, n in leaves.items()], "domain string, lang string, source string, supply long")
        got = {(r.domain, r.lang, r.source): r.budget for r in mixing.allocate(df, mix).collect()}
        assert got == plain(leaves, mix)


def test_weight_zero_loses_no_budget(spark):
    df = spark.createDataFrame([("a", "en", 10), ("a", "de", 1000), ("b", "en", 1000)], "domain string, lang string, supply long")
    mix = Mix(levels=("domain", "lang"), weights={"lang": {"de": 0}}, budget=400, max_epochs=1)
    assert {(r.domain, r.lang): r.budget for r in mixing.allocate(df, mix).collect()} == {("a", "en"): 10, ("a", "de"): 0, ("b", "en"): 390}


def test_repeated_rows_add_up(spark, make_docs, prose):
    """Equal rows, rows that share id and length but not text, null ids, and one row that is a third of all."""
    rows = [(1, "a b c d")] * 5 + [(2, "x y z"), (2, "p q r"), (2, "p q r"), (None, "k l")] + [(None, "m n")] * 2 + [(7, prose(9, 1))] * 40 + [(100 + i, prose(3 + i % 5, i)) for i in range(60)]
    supply = sum(len(t.split(" ")) for _, t in rows)
    levels = {"source": F.lit("s")}
    for budget in (6, supply // 2, supply + 77, 2 * supply + 5):
        docs = make_docs(rows).withColumn("nr", F.col("n_chars") + 0)
        out = mixing.mix_documents(docs, Mix(levels=("source",), budget=budget, max_epochs=2, seed=5), levels)
        assert out.columns == docs.columns
        got = out.collect()
        assert sum(len(r.text.split(" ")) for r in got) == min(budget, 2 * supply)
        texts = {t for _, t in rows}
        cut = [r for r in got if r.text not in texts]
        assert len(cut) <= 1 and all(any(t.startswith(r.text) for i, t in rows if i == r.doc_id) for r in got)


def test_rows_of_a_table_have_places(spark, make_docs, prose, tmp_path):
    rows = [(i % 20, prose(4 + i % 7, i)) for i in range(80)]
    make_docs(rows).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    _, row = mixing._numbered(docs, None)
    assert row == ("_mix_file", "_mix_row")
    out = mixing.mix_documents(docs, Mix(levels=("lang",), budget=100, seed=2), {"lang": F.col("lang")})
    assert out.columns == docs.columns and sum(len(r.text.split(" ")) for r in out.collect()) == 100
