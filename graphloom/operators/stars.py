"""One half round each: every operator maps edges to edges and keeps connectivity.

A star needs the minima around each node beside each neighbour that it links. Only these neighbours are dealt as rows, by
``(g, q)`` with ``q`` the partition of the neighbour, so that a hub with a third of all edges falls into as many groups as
there are partitions and never sits in one task. All other neighbours count for the minima alone: each task combines them to
one row a group before they are sent. At most a row a group then goes by ``g`` to be compared, and back to the groups that
have rows. Four exchanges in all, of which the first holds each edge once and the others a row a group.

Output columns: ``u, v`` [``leaf, route``] and ``ch``, true where the row is a change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.partitioner import PartitionFn, hub_copy, plain_node
from graphloom.operators.edges import mirror, mirror_by_leaf

#: Groups that a hub falls into in the stars that know no partitions, at least; else as many as shuffles have.
SALTS = 64


def _salt(edges: DataFrame) -> PartitionFn:
    return PartitionFn(max(SALTS, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _around(rows: DataFrame, p: PartitionFn, linked: str | None = None) -> DataFrame:
    """Those ``rows(g, x[, leaf | hi])`` that are ``linked`` (None: all), without repeats, each with the minima around g over all rows.

    ``m``: least neighbour of ``g`` in x's partition; ``lo``, ``top``: least and greatest neighbour; ``own``: least
    neighbour in g's own partition, if any; ``degree``: linked neighbours of g; ``home``: x is in g's own partition;
    ``star`` (with ``leaf``): whether all neighbours are leaves; ``low_hi`` (with ``hi``): the flag of the least one.
    """
    whole = rows.withColumn("q", p(F.col("x"))).where("g IS NOT NULL AND x IS NOT NULL AND q IS NOT NULL")
    sent = whole.where(linked) if linked else whole
    dealt = sent.repartition("g", "q")
    dealt = dealt.groupBy("g", "q", "x").agg(F.bool_or("hi").alias("hi")) if "hi" in rows.columns else dealt.distinct()
    more = {"leaf": {"leafy": F.bool_and("leaf")}, "hi": {"low": F.min(F.struct("x", "hi"))}}
    found = {"m": F.min("x"), "most": F.max("x"), "d": F.count("*")} | {k: f for c in more if c in rows.columns for k, f in more[c].items()}
    groups = dealt.groupBy("g", "q").agg(*(f.alias(k) for k, f in found.items()))
    if linked:
        one = {"m": F.col("x"), "most": F.col("x"), "d": F.lit(0).cast("bigint")} | ({"leafy": F.col("leaf")} if "leaf" in rows.columns else {})
        rest = whole.where(f"NOT ({linked})").select("g", "q", *(f.alias(k) for k, f in one.items()))
        again = {"m": F.min("m"), "most": F.max("most"), "d": F.sum("d")} | ({"leafy": F.bool_and("leafy")} if "leaf" in rows.columns else {})
        groups = groups.unionByName(rest).groupBy("g", "q").agg(*(f.alias(k) for k, f in again.items()))
    groups = groups.withColumn("home", F.col("q") == p(F.col("g")))
    node = Window.partitionBy("g")  # at most a row a partition
    over = {"lo": F.min("m"), "top": F.max("most"), "own": F.min(F.when(F.col("home"), F.col("m"))), "degree": F.sum("d")}
    if "leaf" in rows.columns:
        over["star"] = F.bool_and("leafy")
    if "hi" in rows.columns:
        over["low_hi"] = F.min("low")
    minima = groups.withColumns({name: f.over(node) for name, f in over.items()}).where("d > 0")
    return dealt.join(minima.drop("most", "leafy", "low", "d"), ["g", "q"])


_LARGER, _SMALLER = "x > g", "x < g"
#: Least of x's partition with g itself, where it is there; the target that prefers it; the same for g's own row.
_LEAST = "CASE WHEN home THEN least(m, g) ELSE m END"
_TARGET = f"CASE WHEN ({_LEAST}) <> x THEN {_LEAST} ELSE least(g, lo) END"
_OWN_TARGET = "CASE WHEN least(own, g) <> g THEN own ELSE least(g, lo) END"


def large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least id around that node."""
    return _around(mirror(edges), _salt(edges), _LARGER).selectExpr("x AS u", "least(g, lo) AS v", "lo < g AS ch")


def _down(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("g"), F.col("v").alias("x"))


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them; edges come larger end first."""
    # The least neighbour has no row of its own, so its place is taken by the node's.
    return _around(_down(edges), _salt(edges)).selectExpr("CASE WHEN x = lo THEN g ELSE x END AS u", "lo AS v", "x <> lo AS ch")


def pa_large_star(edges: DataFrame, p: PartitionFn) -> DataFrame:
    """Large star that prefers the least neighbour in the linked node's own partition."""
    return _around(mirror(edges), p, _LARGER).selectExpr("x AS u", f"{_TARGET} AS v", f"({_TARGET}) <> g AS ch")


def pa_small_star(edges: DataFrame, p: PartitionFn) -> DataFrame:
    """Small star with the same preference; edges come larger end first."""
    rows = _around(_down(edges), p)
    return rows.selectExpr("CASE WHEN x = lo THEN g ELSE x END AS u", f"CASE WHEN x = lo THEN {_OWN_TARGET} ELSE {_TARGET} END AS v", "x <> lo AS ch")


def pa_large_star_routed(edges: DataFrame, p: PartitionFn) -> DataFrame:
    """:func:`pa_large_star` over ``(u, v, leaf)`` that routes settled edges out of the loop.

    ``cc``: the whole component is a finished star. ``in``: a leaf that found its partition's minimum.
    ``out``: stays in the loop.
    """
    return _around(mirror_by_leaf(edges), p, _LARGER).selectExpr(
        "x AS u",
        f"CASE WHEN star THEN g ELSE {_TARGET} END AS v",
        "false AS leaf",
        f"CASE WHEN star THEN 'cc' WHEN ({_LEAST}) <> x AND leaf THEN 'in' ELSE 'out' END AS route",
        f"(NOT star) AND ({_TARGET}) <> g AS ch",
    )


def pa_small_star_routed(edges: DataFrame, p: PartitionFn) -> DataFrame:
    """:func:`pa_small_star` over mirrored edges that routes settled nodes out and flags new leaves."""
    return _around(mirror(edges), p, _SMALLER).selectExpr(
        "CASE WHEN x = lo THEN g ELSE x END AS u",
        f"CASE WHEN x = lo THEN {_OWN_TARGET} ELSE {_TARGET} END AS v",
        "x = lo AND coalesce(least(own, g), g) = g AND top <= g AS leaf",
        "CASE WHEN x = lo AND least(own, g) <> g AND top <= g THEN 'in' ELSE 'out' END AS route",
        "x <> lo AS ch",
    )


def to_hub_edges(edges: DataFrame) -> DataFrame:
    """Plain edges in the form of the hub-splitting operators: struct ends and the flag of the smaller end."""
    return edges.select(plain_node(F.col("u")).alias("u"), plain_node(F.col("v")).alias("v"), F.lit(False).alias("hi"))


def hub_split(edges: DataFrame, parts: int) -> DataFrame:
    """Oriented hub edges ``(a, b, sp, k)``: where ``sp``, copy ``k`` of hub ``a`` stands between ``a`` and ``b``."""
    oriented = edges.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "hi")
    split = F.col("hi") & (F.col("a.cp") == 0) & (F.col("a.id") != F.col("b.id"))
    return oriented.select("a", "b", split.alias("sp"), hub_copy(F.col("a.id"), F.col("b.id"), parts).alias("k"))


def hub_large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Large star in which a node of more than ``parts`` neighbours is served by at most ``parts`` copies.

    Returns ``u, v, hi, ch``; the splits of this round count as changes through ``sp`` rows, see the plan.
    """
    rows = hub_split(edges, parts)

    def pair(g: str, x: str):
        return F.struct(F.col(g).alias("g"), F.col(x).alias("x"))

    links = F.when(F.col("sp"), F.array(pair("a", "k"), pair("k", "b"))).otherwise(F.array(pair("a", "b"), pair("b", "a")))
    # A hub's copies and its unsplit neighbours are dealt by node and salt as in the plain stars.
    around = _around(rows.select(F.inline(links)), _salt(edges), _LARGER)
    return around.withColumn("mu", F.least("g", "lo")).selectExpr(
        "x AS u", "CASE WHEN g.id = mu.id THEN g ELSE mu END AS v", f"g.id = mu.id AND degree > {int(parts)} AND g.cp = 0 AS hi", "g.id <> mu.id AS ch"
    )


def hub_small_star(edges: DataFrame) -> DataFrame:
    """Small star over hub edges; the flag of the least end goes with it."""
    rows = edges.select(F.col("u").alias("g"), F.col("v").alias("x"), "hi")
    return _around(rows, _salt(edges)).selectExpr("CASE WHEN x = lo THEN g ELSE x END AS u", "lo AS v", "low_hi.hi AS hi", "x <> lo AS ch")


def hub_labels(edges: DataFrame) -> DataFrame:
    """Labels out of converged hub edges: copies go back to their ids, and repeats go."""
    return edges.select(F.col("u.id").alias("node"), F.col("v.id").alias("component")).where("node <> component").distinct()


def localize(parents: DataFrame, p: PartitionFn) -> DataFrame:
    """Split each star of ``(u child, v parent)`` into one sub-star for each partition of its children.

    One exchange: the children of a parent in one partition, which fit in a task, come together.
    """
    kids = parents.select("u", "v").withColumn("q", p(F.col("u"))).repartition("v", "q").distinct()
    least = F.min("u").over(Window.partitionBy("v", "q"))
    return kids.withColumn("m", least).selectExpr("u", "CASE WHEN u <> m THEN m ELSE v END AS v")
