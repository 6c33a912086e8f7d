"""Edge-list projections, groupings and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.partitioner import PartitionFn
from graphloom.plans.ranges import ranked
from graphloom.plans.scratch import Scratch, side


def mirror(edges: DataFrame) -> DataFrame:
    """Both directions of every edge as ``(g, x)``: node and neighbour; the input is read once."""
    pairs = F.array(F.struct(F.col("u").alias("g"), F.col("v").alias("x")), F.struct(F.col("v").alias("g"), F.col("u").alias("x")))
    return edges.select(F.inline(pairs))


def neighbours(edges: DataFrame) -> DataFrame:
    """Distinct ``(g, x)`` in both directions."""
    return mirror(edges).distinct()


def mirror_by_leaf(edges: DataFrame) -> DataFrame:
    """``(g, x, leaf)``: a flagged edge gives only the row of its larger end, so that leaves get no group."""
    down = F.struct(F.col("v").alias("g"), F.col("u").alias("x"), F.col("leaf"))
    up = F.struct(F.col("u").alias("g"), F.col("v").alias("x"), F.lit(False).alias("leaf"))
    return edges.select(F.inline(F.when(F.col("leaf"), F.array(down)).otherwise(F.array(down, up))))


def neighbours_by_leaf(edges: DataFrame) -> DataFrame:
    """Distinct rows of :func:`mirror_by_leaf`."""
    return mirror_by_leaf(edges).distinct()


def canonical(edges: DataFrame) -> DataFrame:
    """Distinct edges, smaller end first, without self-loops."""
    return drop_self_loops(edges).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v")


#: Neighbours in one row of a star's group.
GROUP_ROWS = 10_000


def star_group(edges: DataFrame, size: int = GROUP_ROWS) -> DataFrame:
    """``(node, chunk, neighbours)``: the sorted neighbour set of each node in arrays of ``size``, numbered from 0.

    Neighbours are numbered by ranges of (node, neighbour), so a hub is dealt over as many tasks as it needs and no row
    holds more than ``size`` of its neighbours.
    """
    scratch = Scratch(edges.sparkSession, "groups")
    placed = scratch.table(ranked(neighbours(edges).where("g IS NOT NULL AND x IS NOT NULL"), [F.col("g").asc(), F.col("x").asc()], scratch), "placed")
    starts = scratch.table(placed.groupBy("g").agg(F.min("place").alias("start")), "starts", counted=True)
    chunk = F.floor((F.col("place") - F.col("start")) / size).cast("bigint")
    rows = placed.join(side(starts), "g").select(F.col("g").alias("node"), chunk.alias("chunk"), "x")
    return rows.groupBy("node", "chunk").agg(F.sort_array(F.collect_list("x")).alias("neighbours"))


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, degree)`` over distinct neighbours."""
    return neighbours(edges).groupBy(F.col("g").alias("node")).agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, over: int) -> DataFrame:
    """Nodes of a degree above ``over``."""
    return degrees(edges).where(F.col("degree") > over)


def group_minimum(nb: DataFrame) -> DataFrame:
    """``(g, mu)``: least of the node and its neighbours."""
    return nb.groupBy("g").agg(F.least("g", F.min("x")).alias("mu"))


def partition_minimum(nb: DataFrame, p: PartitionFn) -> DataFrame:
    """``(g, q, m)``: for each node the minimum in each partition over its neighbours and itself."""
    both = F.array(F.col("x"), F.col("g"))
    return nb.select("g", F.explode(both).alias("x")).groupBy("g", p(F.col("x")).alias("q")).agg(F.min("x").alias("m"))


def is_star(edges: DataFrame) -> DataFrame:
    """``(node, star)``: whether all neighbours are flagged leaves."""
    return neighbours_by_leaf(edges).groupBy(F.col("g").alias("node")).agg(F.bool_and("leaf").alias("star"))


def is_leaf(edges: DataFrame) -> DataFrame:
    """``(node, leaf)``: whether no neighbour is larger."""
    return neighbours(edges).groupBy(F.col("g").alias("node")).agg((F.max("x") <= F.first("g")).alias("leaf"))


def distinct_pairs(labels: DataFrame) -> DataFrame:
    return labels.dropDuplicates(["node", "component"])


def union_edges(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All edges of the inputs (bag semantics)."""
    out = first.select("u", "v")
    for other in others:
        out = out.unionByName(other.select("u", "v"))
    return out
