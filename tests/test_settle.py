"""Leaves that are settled before the rounds, roots told by labels, final solves without a sort, one round of metrics."""

import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom import RunMetrics, connected_components
from graphloom import queries as core
from graphloom.functions.partitioner import PartitionFn
from graphloom.operators import local
from graphloom.plans import algorithms
from tests.test_components import exchanges, frame, labels, non_roots, union_find

SF = "/root/testdata/sf0.001"
RNG = random.Random(5)
#: Some components whose edges are dealt over all splits.
MIXED = [(k * 1000 + RNG.randrange(80), k * 1000 + RNG.randrange(80)) for _ in range(500) for k in range(3)] + [(k * 1000 + 900, k * 1000 + 901) for k in range(3)]


@pytest.mark.parametrize("rows", [10, 500_000])
def test_rounds_see_no_leaves(spark, monkeypatch, rows):
    """A node that is in all splits is one edge, not one a split, and leaves do not enter the loop. ``rows``: in levels, and at once."""
    monkeypatch.setattr(algorithms, "TASK_ROWS", rows, raising=False)
    metrics = RunMetrics("", 0, 0)
    got = connected_components(frame(spark, MIXED).repartition(6), "pa_full", 3, 0, metrics=metrics)
    assert labels(got) == non_roots(MIXED)
    assert sum(r.lout + r.lcc + r.lin for r in metrics.rounds[:1]) < len(non_roots(MIXED)) / 2


def test_settled_edges(spark):
    """One edge a leaf; the child of a leaf's edge is in no other."""
    rows = local.settle(local.sketch(frame(spark, MIXED).where("u <> v").repartition(6))).collect()
    leaves = [r.u for r in rows if r.route == "leaf"]
    others = {x for r in rows for x in ((r.v,) if r.route == "leaf" else (r.u, r.v))}
    assert len(leaves) == len(set(leaves)) and not others & set(leaves)
    assert non_roots([(r.u, r.v) for r in rows]) == non_roots(MIXED)


@pytest.mark.parametrize("loops", [[], [(5, 5), (0, 0), (1, 1)]])
def test_roots_are_told_by_labels(spark, loops):
    """All nodes, and the edges are not exploded for them once more."""
    edges = [(0, 1), (2, 3), (3, 4), *loops]
    got = connected_components(frame(spark, edges), include_roots=True)
    assert labels(got) == union_find(edges)
    assert "ExistingRDD" not in got._jdf.queryExecution().toString()


def test_final_solve_does_not_sort(spark):
    """A partition's edges come together by its number; sorting them all would take memory by the edges."""
    edges = [(k, k % 4) for k in range(4, 60)]
    got = local.cc_computation(frame(spark, edges), PartitionFn(4, "mod"))
    assert labels(got) == non_roots(edges)
    assert exchanges(got) == 1 and "Sort" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_metrics_of_one_round_run_one_round(spark, monkeypatch):
    seen, run = [], core.connected_components
    monkeypatch.setattr(core, "connected_components", lambda *args, **options: seen.append(options["metrics"]) or run(*args, **options))
    assert core.QUERIES["op_round_metrics"](spark, SF).count() == 1 and [len(m.rounds) for m in seen] == [1]


@pytest.mark.parametrize("algorithm", ["alternating_hub", "pa_base", "alternating"])
def test_rounds_go_over_a_forest(spark, monkeypatch, algorithm):
    """More edges than a task takes are folded first, so the first round has about an edge a node, not all of them."""
    monkeypatch.setattr(algorithms, "TASK_ROWS", 10)
    metrics = RunMetrics("", 0, 0)
    got = connected_components(frame(spark, MIXED).repartition(6), algorithm, 3, 0, metrics=metrics)
    assert labels(got) == non_roots(MIXED)
    assert 0 < metrics.rounds[0].lout < len(MIXED) / 2


def test_roots_are_told_in_one_exchange(spark):
    """The sketch says which edges tell a root, so its trees are read and dealt once; a root's edges stand together."""
    trees = local.headed_sketch(frame(spark, MIXED).where("u <> v").repartition(6))
    rows = trees.withColumn("split", F.spark_partition_id()).collect()
    assert {(r.split, r.v) for r in rows} == {(r.split, r.v) for r in rows if r.head}
    runs = [(r.split, r.v) for i, r in enumerate(rows) if not i or (r.split, r.v) != (rows[i - 1].split, rows[i - 1].v)]
    assert len(runs) == len(set(runs))
    assert exchanges(local.settle(trees)) == exchanges(trees) + 1


def test_core_and_leaves_by_heads(spark):
    """Leaves and core are the same whether the roots are told by heads or made distinct."""
    trees = local.headed_sketch(frame(spark, MIXED).where("u <> v").repartition(6, "u")).localCheckpoint()
    by_heads, by_distinct = (sorted(map(tuple, local.settle(t).collect())) for t in (trees, trees.drop("head")))
    assert by_heads == by_distinct and {r[2] for r in by_heads} == {"leaf", "core"}


def test_scattered_neighbourhoods_meet_by_ranges(spark):
    """Blocks of near ids whose edges are dealt thinly over many splits leave next to no core in two levels, though each sketch has found little."""
    rng, wanted = random.Random(7), {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    edges = [(k * 100 + rng.randrange(50), 10**6 + k * 100 + rng.randrange(20)) for _ in range(200) for k in range(40)]
    nodes = {x for e in edges for x in e}
    given = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        first = local.settle(local.headed_sketch(spark.sparkContext.parallelize(edges, 20).toDF("u long, v long"))).localCheckpoint()
        second = local.settle(first.where("route = 'core'")).collect()
    finally:
        for name, value in given.items():
            spark.conf.set(name, value)
    rows = [*first.where("route = 'leaf'").collect(), *second]
    assert sum(r.route == "core" for r in second) < 0.1 * len(nodes)
    assert non_roots([(r.u, r.v) for r in rows]) == non_roots(edges)
