"""Fixpoint plans for connected components: ``(node, component)``, component = least reachable id.

Every half round is one job that writes a shared scratch table and gathers its counters on the way; the next half
round reads that table, so lineage stays short and a lost executor costs one half round at most. A plan decides by these
counters alone; where the run has a name, they are kept with its tables, and a restarted driver walks the same way over
the half rounds that are finished and goes on with the first that is not.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.functions.partitioner import PartitionFn
from graphloom.operators import local, stars
from graphloom.operators.edges import drop_self_loops, union_edges
from graphloom.plans.metrics import RoundMetrics, RunMetrics
from graphloom.plans.scratch import TASK_ROWS, Scratch, side

#: Edges in one partition of the final local solve when the number of partitions is left open.
EDGES_PER_PARTITION = 1_000_000
#: A local solve holds about 150 bytes an edge in its one task.
MAX_LOCAL_THRESHOLD = 20_000_000
#: Edges of a sketch that ``union_find`` solves in one task (about 300 MB); more go through rounds.
ONE_TASK = 2_000_000


@dataclass
class Options:
    """``num_partitions`` None: by the number of edges. ``local_threshold``: at most so many edges are solved in one task.
    ``every_edge``: all edges go through the rounds (not in ``pa_full`` and ``union_find``), however many they are."""

    num_partitions: int | None = None
    local_threshold: int = 100_000
    partition_fn: str = "hash"
    max_rounds: int = 60
    every_edge: bool = False
    metrics: RunMetrics = field(default_factory=lambda: RunMetrics("", 0, 0))

    def __post_init__(self) -> None:
        if self.local_threshold > MAX_LOCAL_THRESHOLD:
            raise ValueError(f"local_threshold over {MAX_LOCAL_THRESHOLD} does not fit a task")

    def partitions_for(self, edges: int) -> PartitionFn:
        return PartitionFn(self.num_partitions or max(1, math.ceil(edges / EDGES_PER_PARTITION)), self.partition_fn)


def _counters(*routes: str) -> list:
    def number(condition):
        return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0))

    return [F.count("*").alias("size"), number(F.col("ch")).alias("changes"), *(number(F.col("route") == r).alias(r) for r in routes)]


_ROUTES = ("out", "in", "cc")


def _routed_step(scratch: Scratch, rows: DataFrame, name: str, work: int) -> tuple[DataFrame, list[DataFrame], dict]:
    """Write one half round over ``work`` edges apart by route: the edges that stay, tables of settled ones, and the counters."""
    seen = Observation()
    whole = scratch.table(rows.observe(seen, *_counters(*_ROUTES)), name, partition_by=("route",), found=lambda: seen.get, work=work)
    counts = whole._graphloom_found
    parts = scratch.parts(whole, "route", {r: counts[r] for r in _ROUTES})
    stay = parts.pop("out", None)
    return stay, list(parts.values()), counts


def _step(scratch: Scratch, rows: DataFrame, name: str, counters: list, work: int, source: Observation | None = None) -> tuple[DataFrame, dict]:
    """Write one half round over ``work`` edges; its counters, and those of ``source`` that its rows have passed, come from the same job."""
    seen = Observation()
    table = scratch.table(rows.observe(seen, *counters), name, found=lambda: seen.get | (source.get if source else {}), work=work)
    return table, table._graphloom_found


def _count(scratch: Scratch, edges: DataFrame) -> int:
    return scratch.once("edges", lambda: {"n": edges.count()})["n"]


#: Leaves are settled again where two levels have left no more than this share of the edges: a level costs a third of a round over them.
#: Of two levels, as one may take the hubs away that stand between the many leaves of the next.
SHRINKS = 0.85


class NotConverged(RuntimeError):
    """The plan did not reach its fixpoint in ``max_rounds``."""


Rounds = Callable[[DataFrame, int, Options, Scratch], DataFrame]


def _reduced(edges: DataFrame, opts: Options, scratch: Scratch, rounds: Rounds) -> DataFrame:
    """Labels by ``rounds`` over the edges and their number. Of more than a task's rows the leaves of all sketches are settled first,
    so that rounds go over what is left, however often a node is met; fewer go as they are."""
    now = drop_self_loops(edges)
    size = _count(scratch, now)
    if opts.every_edge or size <= TASK_ROWS:
        return rounds(now, size, opts, scratch)
    trees = scratch.table(local.headed_sketch(now), "sketch", counted=True)
    # Half rounds over a few tasks' rows are cheap: these plans keep them.
    return _settled(trees, trees._graphloom_rows, opts, scratch, rounds, 4 * TASK_ROWS)


def alternating(edges: DataFrame, opts: Options, scratch: Scratch) -> DataFrame:
    """Large-star and small-star until neither changes an edge."""
    return _reduced(edges, opts, scratch, _alternating)


def _alternating(edges: DataFrame, size: int, opts: Options, scratch: Scratch) -> DataFrame:
    now = prior = edges
    opts.metrics.lap("init_s")
    for i in range(opts.max_rounds):
        large, a = _step(scratch, stars.large_star(now), "large", _counters(), size)
        scratch.drop(prior)
        small, b = _step(scratch, stars.small_star(large), "small", _counters(), a["size"])
        scratch.drop(large)
        opts.metrics.rounds.append(RoundMetrics(i, lout=a["size"], sout=b["size"], lchange=a["changes"], schange=b["changes"]))
        now, prior, size = small, small, b["size"]
        if not a["changes"] and not b["changes"]:
            opts.metrics.lap("rounds_s")
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise NotConverged(f"alternating: {opts.max_rounds} rounds")


def alternating_hub(edges: DataFrame, opts: Options, scratch: Scratch) -> DataFrame:
    """Alternating stars in which hubs are served by copies."""
    return _reduced(edges, opts, scratch, _alternating_hub)


def _alternating_hub(edges: DataFrame, size: int, opts: Options, scratch: Scratch) -> DataFrame:
    parts = opts.num_partitions or 16
    now, prior = stars.to_hub_edges(edges), edges
    opts.metrics.lap("init_s")
    for i in range(opts.max_rounds):
        splits = Observation()
        seen = now.observe(splits, F.coalesce(F.sum((F.col("hi") & (F.least("u", "v")["cp"] == 0) & (F.col("u.id") != F.col("v.id"))).cast("bigint")), F.lit(0)).alias("splits"))
        large, a = _step(scratch, stars.hub_large_star(seen, parts), "hub-large", _counters(), size, splits)
        scratch.drop(prior)
        small, b = _step(scratch, stars.hub_small_star(large), "hub-small", _counters(), a["size"])
        scratch.drop(large)
        changes = a["changes"] + a["splits"]
        opts.metrics.rounds.append(RoundMetrics(i, lout=a["size"], sout=b["size"], lchange=changes, schange=b["changes"]))
        now, prior, size = small, small, b["size"]
        if not changes and not b["changes"]:
            opts.metrics.lap("rounds_s")
            return stars.hub_labels(now)
    raise NotConverged(f"alternating_hub: {opts.max_rounds} rounds")


def pa_base(edges: DataFrame, opts: Options, scratch: Scratch) -> DataFrame:
    """Partition-aware stars, then a local solve in each partition."""
    return _reduced(edges, opts, scratch, _pa_base)


def _pa_base(edges: DataFrame, size: int, opts: Options, scratch: Scratch) -> DataFrame:
    now = prior = edges
    p = opts.partitions_for(size)
    opts.metrics.lap("init_s")
    for i in range(opts.max_rounds):
        if size <= opts.local_threshold:
            now = local.local_cc(now, opts.local_threshold)
            break
        large, a = _step(scratch, stars.pa_large_star(now, p), "pa-large", _counters(), size)
        scratch.drop(prior)
        small, b = _step(scratch, stars.pa_small_star(large, p), "pa-small", _counters(), a["size"])
        scratch.drop(large)
        opts.metrics.rounds.append(RoundMetrics(i, lout=a["size"], sout=b["size"], lchange=a["changes"], schange=b["changes"]))
        now, prior, size = small, small, b["size"]
        if not a["changes"] and not b["changes"]:
            break
    else:
        raise NotConverged(f"pa_base: {opts.max_rounds} rounds")
    opts.metrics.lap("rounds_s")
    return local.cc_computation(now, p)


def _filtered_rounds(edges: DataFrame, size: int, p: PartitionFn, opts: Options, scratch: Scratch) -> DataFrame:
    """Rounds over the edges still open. Settled ones are written apart and wait for the final solve; edges that the next
    half round has read are deleted, so that the disk holds the settled edges and two half rounds."""
    now, last = edges.select("u", "v", F.lit(False).alias("leaf")), edges
    settled: list[DataFrame] = []
    for i in range(opts.max_rounds):
        if size <= opts.local_threshold:
            now = local.local_cc(now, opts.local_threshold)
            break
        large, done, a = _routed_step(scratch, stars.pa_large_star_routed(now, p), "large", size)
        settled += done
        scratch.drop(last)
        b = dict.fromkeys((*_ROUTES, "changes"), 0)
        now = last = None
        if large is not None:
            now, done, b = _routed_step(scratch, stars.pa_small_star_routed(large, p), "small", a["out"])
            settled += done
            scratch.drop(large)
            last, now = now, now and now.drop("ch")
        opts.metrics.rounds.append(RoundMetrics(i, a["out"], a["cc"], a["in"], b["out"], b["in"], a["changes"], b["changes"]))
        size = b["out"]
        if not size or not a["changes"] and not b["changes"]:
            break
    else:
        raise NotConverged(f"filtered rounds: {opts.max_rounds}")
    opts.metrics.lap("rounds_s")
    tables = [t for t in (now, *settled) if t is not None]
    return union_edges(*tables) if tables else edges.limit(0).select("u", "v")


def pa_filtered(edges: DataFrame, opts: Options, scratch: Scratch) -> DataFrame:
    """:func:`pa_base` in which settled edges leave the loop."""
    return _reduced(edges, opts, scratch, _pa_filtered)


def _pa_filtered(edges: DataFrame, size: int, opts: Options, scratch: Scratch) -> DataFrame:
    p = opts.partitions_for(size)
    opts.metrics.lap("init_s")
    return local.cc_computation(_filtered_rounds(edges, size, p, opts, scratch), p)


def pa_full(edges: DataFrame, opts: Options, scratch: Scratch) -> DataFrame:
    """Sketch each split and settle the leaves of all sketches; the rest is localised and solved by :func:`pa_filtered`, then the
    leaves take the label of the node that they hang on.

    Where the sketch is within the local threshold, no round runs at all.
    """
    trees = scratch.table(local.headed_sketch(drop_self_loops(edges)), "sketch", counted=True)
    size = trees._graphloom_rows
    if size <= opts.local_threshold:
        opts.metrics.lap("init_s")
        return local.local_cc(trees, opts.local_threshold).toDF("node", "component")
    return _settled(trees, size, opts, scratch, _core, max(TASK_ROWS, opts.local_threshold))


def _settled(trees: DataFrame, size: int, opts: Options, scratch: Scratch, rounds: Rounds, enough: int, before: float = math.inf) -> DataFrame:
    """Labels of ``trees``: the leaves are settled and wait for the labels of the rest, which is settled again as long as it
    shrinks and is more than ``enough``, and goes through ``rounds`` then. ``before``: edges of the level before, if any."""
    seen = Observation()
    settled = local.settle(trees).observe(seen, *(F.coalesce(F.sum((F.col("route") == r).cast("bigint")), F.lit(0)).alias(r) for r in ("leaf", "core")))
    whole = scratch.table(settled, "settled", partition_by=("route",), found=lambda: seen.get, work=size)
    scratch.drop(trees)
    parts, left = scratch.parts(whole, "route", whole._graphloom_found), whole._graphloom_found["core"]
    leaves, core, labels = parts.get("leaf"), parts.get("core"), None
    if core is None:
        opts.metrics.lap("init_s")
    else:
        again = enough < left <= before * SHRINKS
        found = _settled(core, left, opts, scratch, rounds, enough, size) if again else rounds(core, left, opts, scratch)
        labels = scratch.table(found, "core-labels", counted=True, work=left)
    if leaves is None:
        return labels
    out = leaves.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if labels is not None:
        above = side(labels.toDF("component", "least"), rows=labels._graphloom_rows, fixed=True)
        out = out.join(above, "component", "left").select("node", F.coalesce("least", "component").alias("component")).unionByName(labels)
    out._graphloom_work = size
    return out


def _core(core: DataFrame, size: int, opts: Options, scratch: Scratch) -> DataFrame:
    """Labels of the edges that are left when the leaves are settled."""
    if size <= opts.local_threshold:
        opts.metrics.lap("init_s")
        return local.local_cc(core, opts.local_threshold).toDF("node", "component")
    p = opts.partitions_for(size)
    now = scratch.table(stars.localize(core, p), "localized", counted=True, work=size)
    scratch.drop(core)
    opts.metrics.lap("init_s")
    return local.cc_computation(_filtered_rounds(now, now._graphloom_rows, p, opts, scratch), p)


def union_find(edges: DataFrame, opts: Options, scratch: Scratch) -> DataFrame:
    """Union-find of each split, then of all that is left in one task; where that is over ``ONE_TASK`` edges, by the rounds of :func:`pa_full`."""
    return pa_full(edges, replace(opts, local_threshold=max(opts.local_threshold, ONE_TASK)), scratch)


ALGORITHMS = {f.__name__: f for f in (pa_full, pa_filtered, pa_base, alternating, alternating_hub, union_find)}
