"""Mixing, URL reputation and licence scan: SQL over the test tables, and small cases."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.llm import license_scan, mixing, queries, url_reputation
from graphloom.llm.license_texts import LICENSES
from graphloom.llm.mixing import Mix
from graphloom.llm.url_reputation import Rule

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want, have = con.execute(queries.SQL[name]).df(), queries.QUERIES[name](spark, SF).toPandas().convert_dtypes()
    want = want.convert_dtypes()
    assert sorted(want.columns) == sorted(have.columns)
    text = lambda df: sorted(df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).astype(str).itertuples(index=False, name=None))
    assert text(want) == text(have)


def test_native_plans_have_no_python(spark):
    if os.path.isdir(SF):
        for name in ("op1_mixing", "op3_url_reputation", "op10_license_scan"):
            plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
            assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def budgets(spark, leaves, **mix):
    levels = ("domain", "lang")
    df = spark.createDataFrame(leaves, "domain string, lang string, supply long")
    return {(r.domain, r.lang): r.budget for r in mixing.allocate(df, Mix(levels=levels, **mix)).collect()}


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("a", "en", 10), ("a", "de", 1000), ("b", "en", 1000), ("b", "de", 1000)]
    got = budgets(spark, leaves, budget=400, max_epochs=1)
    assert got == {("a", "en"): 10, ("a", "de"): 190, ("b", "en"): 100, ("b", "de"): 100}
    # The whole of a is short: its rest goes to b.
    got = budgets(spark, [("a", "en", 10), ("a", "de", 20), ("b", "en", 1000), ("b", "de", 1000)], budget=400, max_epochs=1, weights={"lang": {"en": 3}})
    assert got == {("a", "en"): 10, ("a", "de"): 20, ("b", "en"): 277, ("b", "de"): 93} or sum(got.values()) == 400
    assert got[("b", "en")] in (277, 278)


def test_budget_over_capacity_takes_all(spark):
    assert budgets(spark, [("a", "en", 10), ("b", "de", 7)], budget=1000, max_epochs=3) == {("a", "en"): 30, ("b", "de"): 21}
    assert budgets(spark, [], budget=5) == {}
    assert sum(budgets(spark, [("a", "en", 100), ("b", "en", 100), ("c", "en", 100)], budget=100).values()) == 100


def test_prefixes_are_exact_and_seeded(spark, make_docs, prose, odd_texts):
    rows = [(i, t, "en", "s1") for i, t in enumerate(odd_texts)] + [(100 + i, prose(1 + i % 17, i), "en" if i % 3 else None, "s1") for i in range(200)]
    docs = make_docs(rows)
    mix = Mix(levels=("lang", "source"), percent=130, max_epochs=2, seed=3)
    slim = docs.select("doc_id", "lang", "source", mixing.tokens(F.col("text")).alias("n_tokens"))
    picked = mixing.select_prefixes(slim, mix).collect()
    count = {i: len(t.split(" ")) if t else 0 for i, t, *_ in rows}
    assert sum(r["take"] for r in picked) == sum(count.values()) * 130 // 100
    for leaf in {r.lang for r in picked}:
        cut = [r for r in picked if r.lang == leaf and r["take"] < r.n_tokens]
        assert len(cut) <= 1 and all(0 < r["take"] <= r.n_tokens == count[r.doc_id] for r in picked)
    out = mixing.mix_documents(docs, mix, {"lang": F.col("lang"), "source": F.col("source")})
    assert out.columns == docs.columns
    texts = dict((i, t) for i, t, *_ in rows)
    found = out.collect()
    assert len(found) == len(picked) and all(texts[r.doc_id].startswith(r.text) for r in found)
    assert sum(len(r.text.split(" ")) for r in found) == sum(r["take"] for r in picked)
    assert mixing.mix_documents(make_docs([]), mix, {"lang": F.col("lang"), "source": F.col("source")}).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q#f", "x://net", "x://b.net/", "x://internet/", "https://example.com/de/1", "x://example.com?/de/", "x://w.org/fr/", "x://w.org/frx", "x://a.co.uk://b/", "x://"]
    pages = spark.createDataFrame([(i, u, "k", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, n int")
    outcomes = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge(pages, outcomes, queries.RULES).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[4] == ("net", "", None, "allow")
    assert got[5] == ("b.net", "/", "net/", "block")
    assert got[6][2] is None and got[8] == ("example.com", "", None, "allow")
    assert got[7] == ("example.com", "/de/1", "example.com/de/", "block")
    assert got[9][2:] == ("org/fr/", "allow") and got[10][2] is None
    assert got[11] == ("a.co.uk:", "//b/", None, "allow")
    with pytest.raises(ValueError):
        url_reputation.rule_of(F.lit("h"), F.lit("p"), [Rule("a/", "block")] * (url_reputation.MAX_RULES + 1))


def test_sites(spark):
    hosts = ["10.0.0.1", "192.168.0.1:80", "example.com:8080", "example.com.", "me:pw@a.example.com", "[::1]:90", "x.co.uk", "a.b.co.uk:1", "localhost", "", "1.2.3"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string").withColumn("site", url_reputation.site_of(F.col("host")))
    got = [tuple(r) for r in df.select(url_reputation.domain_of(F.col("site")), url_reputation.suffix_of(F.col("site"))).collect()]
    assert got == [("10.0.0.1",) * 2, ("192.168.0.1",) * 2, ("example.com", "com"), ("example.com", "com"), ("example.com", "com"), ("[::1]",) * 2, ("x.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("localhost",) * 2, ("", ""), ("2.3", "3")]
    assert df.select(url_reputation.suffix_of(F.lit("a.b.zz"), ("b.zz",))).first()[0] == "b.zz"


def test_few_labels(spark):
    """One bad label blocks nothing but what rules say; repeated pages and labels; null outcomes; addresses apart; no pages."""
    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (2, "http://b.org/"), (3, None), (4, "http://9.9.9.1/"), (5, "http://8.8.9.1/"), (None, "http://a.net/")], "page_id long, url string")
    outcome = lambda rows: spark.createDataFrame(rows, "page_id long, bad int")
    got = url_reputation.judge(pages, outcome([(1, 1), (1, 0), (2, None), (None, 1)]), queries.RULES).collect()
    assert len(got) == 7 and all(r.verdict == "allow" for r in got if r.host != "a.net") and all(0 < r.posterior < 1 for r in got)
    many = pages.unionByName(spark.createDataFrame([(100 + i, "http://9.9.9.1/") for i in range(60)], "page_id long, url string"))
    got = {r.page_id: r.verdict for r in url_reputation.judge(many, outcome([(100 + i, 1) for i in range(60)] + [(5, 0), (2, 0)]), []).collect()}
    assert got[4] == "block" and got[5] == "allow"
    assert url_reputation.judge(pages.limit(0), outcome([]), queries.RULES).count() == 0


def test_reputation_shrinks_towards_domain(spark):
    rows = [("bad.a.com", 400, 395), ("new.a.com", 0, 0), ("one.a.com", 1, 1), ("good.b.com", 400, 2), ("one.b.com", 1, 1), ("x.c.co.uk", 50, 5), ("y.c.co.uk", 50, 4)]
    got = {r.host: r for r in url_reputation.reputation(spark.createDataFrame(rows, "host string, n long, bad long")).collect()}
    assert got["bad.a.com"].blocked and not got["good.b.com"].blocked and not got["one.b.com"].blocked
    assert got["new.a.com"].posterior > got["one.b.com"].posterior - 0.5
    assert got["good.b.com"].posterior < got["one.b.com"].posterior < got["one.a.com"].posterior
    assert url_reputation.reputation(spark.createDataFrame([], "host string, n long, bad long")).count() == 0


def test_licences(spark, make_docs, odd_texts):
    mit = LICENSES["MIT"][0]
    changed = "Copyright (c) 2020 Somebody\n(C) Other\n© third\n" + mit.replace("copyright holders", "COPYRIGHT   HOLDERS").replace(",", " ;").upper()
    rows = [(1, mit), (2, changed), (3, "x\nReleased under the MIT License.\ny\n * Licensed under CC BY-NC 4.0!\nReleased under the MIT Licence"), (4, mit + " and more"), (4, mit)]
    rows += [(10 + i, t) for i, t in enumerate(odd_texts)]
    got = license_scan.scan(make_docs(rows), license_scan.known_digests(spark))
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r.doc_id, []).append((r.license, r.n_notices, r.notices))
    assert by_id[1] == by_id[2] == [("MIT", 0, "")]
    assert by_id[3] == [(None, 3, "CC-BY-NC-4.0,MIT")]
    assert sorted(by_id[4], key=str) == [("MIT", 0, ""), (None, 0, "")]
    assert all(by_id[10 + i] == [(None, 0, "")] for i in range(len(odd_texts)))
    assert license_scan.scan(make_docs([]), license_scan.known_digests(spark)).count() == 0
