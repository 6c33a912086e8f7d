"""Long licences as whole texts, and header lines."""

import os
import re

import pytest

from graphloom.llm import license_scan

DIR = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isfile(f"{DIR}/Apache-2.0") or not os.path.isfile(f"{DIR}/GPL-3"), reason="no licence texts")
def test_whole_long_texts(spark, make_docs):
    apache, gpl = (open(f"{DIR}/{name}").read() for name in ("Apache-2.0", "GPL-3"))
    texts = [apache, apache[: apache.index("APPENDIX")], re.sub(r"(?<!\n)\n(?!\n)[ \t]*", " ", apache), gpl, gpl[: gpl.index("How to Apply")]]
    rows = license_scan.scan(make_docs(list(enumerate(texts))), license_scan.known_digests(spark)).collect()
    assert [r.license for r in sorted(rows, key=lambda r: r.doc_id)] == ["Apache-2.0"] * 3 + ["GPL-3.0"] * 2


def test_header_lines(spark, make_docs):
    rows = [(1, '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may'), (2, "// SPDX-License-Identifier: GPL-3.0-or-later\nx"), (3, "# spdx-license-identifier: CC-BY-NC-4.0")]
    got = license_scan.scan(make_docs(rows), license_scan.known_digests(spark)).collect()
    assert {r.doc_id: r.notices for r in got} == {1: "Apache-2.0", 2: "GPL-3.0", 3: "CC-BY-NC-4.0"}


def test_more_whole_texts(spark, make_docs):
    names = {"GPL-2": "GPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "Artistic": "Artistic-1.0-Perl"}
    here = [n for n in names if os.path.isfile(f"{DIR}/{n}")]
    texts = [open(f"{DIR}/{n}").read() for n in here]
    rows = license_scan.scan(make_docs([(i, t.replace("\n", "\r\n")) for i, t in enumerate(texts)]), license_scan.known_digests(spark)).collect()
    assert {r.doc_id: r.license for r in rows} == {i: names[n] for i, n in enumerate(here)}


def test_rows_of_one_id_have_their_own_lines(spark, make_docs):
    """Equal id and canonical digest, lines broken elsewhere; and a list of many lines."""
    line = "Released under the MIT License."
    many = "\n".join(["x", line] * 3000)
    got = license_scan.scan(make_docs([(1, f"a\n{line}"), (1, f"a {line}"), (1, f"a {line}"), (2, many), (None, line)]), license_scan.known_digests(spark)).collect()
    assert sorted((r.doc_id or 0, r.n_notices) for r in got) == [(0, 1), (1, 0), (1, 0), (1, 1), (2, 3000)]
