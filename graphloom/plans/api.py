"""Entry points of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.algorithms import ALGORITHMS, Options
from graphloom.plans.metrics import RunMetrics
from graphloom.plans.scratch import Scratch, side


def connected_components(
    edges: DataFrame,
    algorithm: str = "pa_full",
    num_partitions: int | None = None,
    local_threshold: int = 100_000,
    include_roots: bool = False,
    partition_fn: str = "hash",
    max_rounds: int = 60,
    metrics: RunMetrics | None = None,
    resume: str | None = None,
    every_edge: bool = False,
) -> DataFrame:
    """``(node, component)`` of undirected ``edges(u, v)``, component = least id reachable.

    Roots are left out unless ``include_roots``; then nodes with only self-loops appear too. Duplicate, reversed and
    self edges, negative ids and empty inputs are fine; rows with a null end are no edges. ``metrics`` is filled.
    ``every_edge``: rounds go over all edges as they are, so that ``metrics`` tells of these; dearer by far (:class:`Options`).

    ``resume`` names the run: where its driver died, the same call with the same edges goes on after the last half round that
    was finished, and a finished run gives its labels again. Its tables stay until :func:`release`. Other options under a
    name that is taken are refused.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}; one of {', '.join(ALGORITHMS)}")
    spark = edges.sparkSession
    clean = edges.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    metrics = metrics or RunMetrics("", 0, 0)
    metrics.app, metrics.threshold, metrics.partitions = algorithm, local_threshold, num_partitions or 0
    opts = Options(num_partitions, local_threshold, partition_fn, max_rounds, every_edge, metrics)
    scratch = Scratch(spark, "cc", resume)
    wanted = {"algorithm": algorithm, "num_partitions": num_partitions, "local_threshold": local_threshold, "partition_fn": partition_fn} | ({"every_edge": True} if every_edge else {})
    if (given := scratch.once("options", lambda: wanted)) != wanted:
        raise ValueError(f"run {resume!r} was begun with {given}")
    found = ALGORITHMS[algorithm](clean, opts, scratch)
    labels = scratch.table(found, "labels", work=getattr(found, "_graphloom_work", None))
    scratch.keep(labels)
    metrics.lap("compute_s")
    out = with_roots(labels, clean, scratch) if include_roots else labels
    out._graphloom_run = scratch
    return out


def release(labels: DataFrame) -> None:
    """Delete the labels that :func:`connected_components` has written, once what it has returned has been used."""
    run = getattr(labels, "_graphloom_run", None)
    if run is not None:
        run.close()


def with_roots(labels: DataFrame, edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Labels of all nodes of ``edges``: what is a component without a label is its own root, and so is a node with only self-loops.

    The roots are told by the labels; of the edges only the self-loops are looked at, and where there are none nothing is joined.
    """
    roots = labels.select("component").distinct().select(F.col("component").alias("node"), "component")
    out = labels.unionByName(roots)
    loops = (scratch or Scratch(edges.sparkSession, "roots")).table(edges.where("u = v").select(F.col("u").alias("node")).distinct(), "loops", counted=True)
    if not loops._graphloom_rows:
        return out
    known = labels.select(F.explode(F.array("node", "component")).alias("node")).join(side(loops, fixed=True), "node", "left_semi").distinct()
    alone = loops.join(known, "node", "left_anti")
    return out.unionByName(alone.select("node", F.col("node").alias("component")))


def component_sizes(labels: DataFrame) -> DataFrame:
    """``(component, size)`` of labels without roots; the root counts."""
    return labels.groupBy("component").agg((F.count("*") + 1).alias("size"))
