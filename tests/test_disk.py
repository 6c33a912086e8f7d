"""What a run moves and keeps on disk: shuffle files go with their job, and rounds go over what settling leaves alone."""

import random
import time

import pytest

from graphloom import RunMetrics, connected_components
from graphloom.operators import local
from graphloom.plans import algorithms, scratch
from graphloom.plans.scratch import Scratch
from tests.test_components import exchanges, frame, labels, non_roots
from tests.test_settle import MIXED

RNG = random.Random(11)
#: A random graph between few ids and many smaller ones, without any order: no split holds a cycle, and a range of ids neither.
SCATTERED = [(RNG.randrange(2000), 10**6 + RNG.randrange(250)) for _ in range(8000)]


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffle_files_go_with_the_job(spark):
    """A table's shuffle leaves no file behind once the table is written; the session's setting is put back."""
    name = next(iter(scratch.CLEAN))
    before, given = shuffle_files(spark), spark.conf.get(name)
    run = Scratch(spark, "files")
    out = run.table(spark.range(1000).repartition(7, "id").groupBy("id").count(), "t", counted=True)
    until = time.monotonic() + 20  # executors delete them on their own time
    while (left := shuffle_files(spark) - before) and time.monotonic() < until:
        time.sleep(0.1)
    assert not left and spark.conf.get(name) == given and out._graphloom_rows == out.count() == 1000
    run.close()


def test_scattered_ids_are_settled_in_levels(spark, monkeypatch):
    """The first level takes few edges, but with them the hubs between the leaves of the next: rounds see little."""
    monkeypatch.setattr(algorithms, "TASK_ROWS", 200)
    monkeypatch.setattr(scratch, "TASK_ROWS", 200)
    metrics = RunMetrics("", 0, 0)
    edges = spark.sparkContext.parallelize(SCATTERED, 40).toDF("u long, v long")
    got = connected_components(edges, "pa_full", 3, 0, metrics=metrics)
    assert labels(got) == non_roots(SCATTERED)
    assert sum(r.lout + r.lcc + r.lin for r in metrics.rounds[:1]) < len(SCATTERED) / 4


def test_core_tells_its_roots(spark):
    """What is settled again comes with heads, so that its roots need no distinct and no exchange of their own."""
    first = local.settle(local.headed_sketch(frame(spark, MIXED).where("u <> v").repartition(6))).localCheckpoint()
    core = first.where("route = 'core'")
    assert {r.v for r in core.collect()} == {r.v for r in core.where("head").collect()} and not first.where("route = 'leaf' AND head").count()
    assert exchanges(local.settle(core)) == 1


@pytest.mark.parametrize("algorithm", ["alternating_hub", "alternating", "pa_base"])
def test_star_rounds_see_no_leaves(spark, monkeypatch, algorithm):
    """More edges than a task takes lose their leaves first: the first round has far less than an edge a node."""
    monkeypatch.setattr(algorithms, "TASK_ROWS", 10)
    metrics = RunMetrics("", 0, 0)
    got = connected_components(frame(spark, MIXED).repartition(6), algorithm, 3, 0, metrics=metrics)
    assert labels(got) == non_roots(MIXED)
    assert sum(r.lout for r in metrics.rounds[:1]) < len(non_roots(MIXED)) / 2


@pytest.mark.parametrize("every_edge", [False, True])
def test_filtered_rounds_see_no_leaves(spark, monkeypatch, every_edge):
    """The filtered rounds do so too, unless every edge is asked for."""
    monkeypatch.setattr(algorithms, "TASK_ROWS", 10)
    metrics = RunMetrics("", 0, 0)
    got = connected_components(frame(spark, MIXED).repartition(6), "pa_filtered", 3, 0, metrics=metrics, every_edge=every_edge)
    assert labels(got) == non_roots(MIXED)
    assert (sum(r.lout + r.lcc + r.lin for r in metrics.rounds[:1]) < len(non_roots(MIXED)) / 2) != every_edge
