"""Registered graph queries read every row of their table; held against a plain union-find over the whole of it."""

import os
from collections import Counter

import pyarrow.parquet as pq
import pytest

from graphloom import queries as core
from graphloom.operators import edges as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
CC = ["cc_pa_full", "cc_pa_filtered", "cc_pa_base", "cc_alternating", "cc_alternating_hub", "cc_union_find", "cc_local_gate", "cc_no_gate"]


def order_part():
    table = pq.read_table(f"{SF}/lineitem.parquet", columns=["l_orderkey", "l_partkey"])
    return [(o, core.OFFSET + p) for o, p in zip(*(c.to_pylist() for c in table.columns), strict=True)]


def parts():
    return pq.read_table(f"{SF}/part.parquet", columns=["p_partkey"]).column(0).to_pylist()


def least(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    return {x: find(x) for x in parent}


def rows(spark, name):
    return core.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", CC)
def test_components_of_the_whole_table(spark, name):
    want = {n: c for n, c in least(order_part()).items() if n != c}
    got = rows(spark, name)
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_all_nodes_and_sizes(spark):
    want = least(order_part())
    got = rows(spark, "cc_all_nodes")
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert {r.component: r["size"] for r in rows(spark, "agg_component_sizes")} == Counter(want.values())


def test_all_parts(spark):
    chain = [(p, p + 1) for p in parts()]
    assert {r.node: r.component for r in rows(spark, "cc_blocks")} == {n: c for n, c in least(chain).items() if n != c}
    assert {r.node: r.component for r in rows(spark, "op_cc_computation")} == {p: p // 100 * 100 for p in parts() if p % 100}


def test_steps_see_every_edge(spark):
    edges = order_part()
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    groups = E.star_group(core.graph(spark, SF, core.GRAPHS["order_part"]), 7).orderBy("node", "chunk").collect()
    assert max(len(r.neighbours) for r in groups) == 7 and all(len(r.neighbours) == 7 for r, after in zip(groups, groups[1:], strict=False) if after.node == r.node)
    together = {}
    for r in groups:
        together.setdefault(r.node, []).extend(r.neighbours)
    assert {g: ",".join(map(str, x)) for g, x in together.items()} == {g: ",".join(map(str, sorted(x))) for g, x in near.items()}
    assert {r.node for r in rows(spark, "op_is_leaf")} == set(near)
    assert Counter((r.u, r.v) for r in rows(spark, "op_text_malformed")) == Counter(edges)
    assert {r.u for name in ("op_large_star", "op_pa_large_star", "op_filter_large_routes") for r in rows(spark, name)} == {v for _, v in edges}
