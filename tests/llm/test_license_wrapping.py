"""Whole licences are found however their lines are wrapped."""

import re
import textwrap

import pytest
from pyspark.sql import functions as F

from graphloom.llm import license_scan
from graphloom.llm.license_texts import LICENSES

#: As the texts are usually distributed.
MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
ISC = """ISC License

Copyright Some Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(p, width, break_long_words=False) for p in re.split(r"\n\n+", text))


def found(spark, make_docs, texts):
    rows = license_scan.scan(make_docs(list(enumerate(texts))), license_scan.known_digests(spark)).collect()
    return [r.license for r in sorted(rows, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("name, text", [("MIT", MIT), ("ISC", ISC)])
def test_standard_wrappings(spark, make_docs, name, text):
    head = text[: text.index("Permission")]
    body = text[len(head) :]
    texts = [text, text.replace("\n", "\r\n"), "".join(f" * {line}\n" for line in text.splitlines()), text.replace("\n", "\n\n")]
    texts += [wrapped(text, width) for width in range(30, 131)] + [wrapped(text, 10_000), " ".join(body.split())]
    texts += [f"{head}{wrapped(body, 60)}", f"Copyright 2020 A\n(c) B\n© C\n{body}", f"{name} License\nCopyright (c) 2020 A\n{body}"]
    texts += [f"{name} License Copyright (c) 2020 A. All rights reserved. {' '.join(body.split())}", f"Copyright 2020 A {' '.join(body.split())}"]
    assert found(spark, make_docs, texts) == [name] * len(texts)


@pytest.mark.parametrize("name", ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"])
def test_every_width_of_the_known_texts(spark, make_docs, name):
    texts = [f"Copyright (c) 2020, A\n\n{wrapped(LICENSES[name][0], width)}" for width in range(20, 131)]
    assert found(spark, make_docs, texts) == [name] * len(texts)


def test_only_notices_are_dropped(spark):
    rows = [("a\ncopyright holders b", "a copyright holders b"), ("a\ncopyright law b", "a copyright law b"), ("a\n\ncopyright: me\n\nb", "a b"), ("a\n(C) 2020 me\nb", "a b"), ("(c) me " * 100_000, ""), ("(c) me\n" * 100_000 + "x", "x")]
    got = spark.createDataFrame(rows, "text string, want string").select(license_scan.canonical(F.col("text")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


@pytest.mark.parametrize("holders", [1, 30, 3000])
def test_notices_of_any_length_on_one_line(spark, holders):
    names = ", ".join(f"Holder Number {i}" for i in range(holders))
    line = " ".join(MIT.replace("Some Body", names).split())
    docs = spark.createDataFrame([(1, line), (2, line.replace("free of charge", "for a charge"))], "doc_id long, text string")
    found = {r.doc_id: r.license for r in license_scan.scan(docs, license_scan.known_digests(spark)).collect()}
    assert found == {1: "MIT", 2: None}


def test_marks_that_open_no_licence_stay_and_are_read_once(spark):
    line = "see copyright 2020 of x, " * 40_000
    text = spark.createDataFrame([(f"{line}\n{line}",)], "text string").select(license_scan.canonical(F.col("text")).alias("c")).first().c
    assert text == " ".join(["see copyright 2020 of x"] * 80_000)
