"""The licence scan and its SQL say the same of notices in every form, wrapped licences, headers and whole digests."""

import random

import pytest

from graphloom.llm import license_scan, queries
from graphloom.llm.license_texts import KNOWN, LICENSES

duckdb = pytest.importorskip("duckdb")


def notices(seed):
    """Texts of lines that are notices, look like some, wrap, or open a licence."""
    rng = random.Random(seed)
    parts = ["copyright holders b", "copyright law", "copyright 2020 me", "(c) you may", "(c) me", "© 2019 x", "Copyright (C) a", "copyrighted 2020 x", "", "", " * ", "//", "\r", "a b", "see copyright 2020 of x"]
    parts += ["permission to use it", "Permission is hereby granted, all", "all rights, redistribution and use", "copyright, 2020 a permission to use b (c) 1999 c permission is hereby granted d", "notice (c) me permission to use", "x(c) 2020 y permission to use"]
    return "\n".join(rng.choice(["", "", "# ", "\t"]) + rng.choice(parts) for _ in range(rng.randrange(1, 9)))


def test_sql_says_what_the_operator_says(spark, make_docs, odd_texts):
    texts = [notices(i) for i in range(1500)] + [t for t in odd_texts if t not in ("İstanbul ΣΑΣ", "a\x00b\x01c")]
    for known in KNOWN.values():
        for text in known:
            texts += [text, f"a\n{text}\nb", f"Copyright 2020 A\n(c) B\n{text.upper()}"]
    for text in (t for known in LICENSES.values() for t in known):
        texts += [f"x license copyright (c) 2020 A {' '.join(text.split())}", f"\n\n Copyright A\n{text}\n(c) 2020 B"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, "SPDX-License-Identifier: MIT")]
    columns = ["doc_id", "canonical_sha256", "license", "n_notices", "notices"]
    got = license_scan.scan(make_docs(rows).repartition(4), license_scan.known_digests(spark)).select(columns).collect()
    documents = make_docs(rows).select("doc_id", "text").toArrow()
    con = duckdb.connect()
    con.register("documents", documents)
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    want = order(con.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL['op10_license_scan']})").fetchall())
    got = order(got)
    assert not [(g, w, texts[g[0]]) for g, w in zip(got, want, strict=True) if g != w][:5]
    assert len({r[2] for r in got}) > 5 and any(r[3] for r in got)
