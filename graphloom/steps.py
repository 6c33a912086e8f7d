"""``python -m graphloom.steps STEP INPUT OUTPUT``: one step of a plan by itself, Parquet to Parquet.

Steps read edges ``(u, v)`` (routed steps also ``leaf``), write their rows, and print the rows read and written and the
changes. ``init`` reads a text edge list, ``union-find`` reads text and writes text labels with the roots, ``local-cc``
solves Parquet edges in one task where a sketch of them fits, by rounds above. The ``hub-`` steps work on the edges that ``hub-init`` makes of plain ones; ``hub-labels``
makes labels of converged ones.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.partitioner import KINDS, PartitionFn
from graphloom.operators import local, stars
from graphloom.plans.algorithms import MAX_LOCAL_THRESHOLD, ONE_TASK
from graphloom.plans.api import connected_components
from graphloom.sources.edges import counted_edges_text, read_edges_text, write_labels_text, write_routed


def _with_leaf(edges: DataFrame) -> DataFrame:
    return edges if "leaf" in edges.columns else edges.withColumn("leaf", F.lit(False))


STEPS: dict[str, Callable[[DataFrame, PartitionFn], DataFrame]] = {
    "large-star": lambda e, p: stars.large_star(e),
    "small-star": lambda e, p: stars.small_star(e),
    "pa-large-star": stars.pa_large_star,
    "pa-small-star": stars.pa_small_star,
    "pa-large-star-routed": lambda e, p: stars.pa_large_star_routed(_with_leaf(e), p),
    "pa-small-star-routed": stars.pa_small_star_routed,
    "sketch": lambda e, p: local.sketch(e),
    "localize": stars.localize,
    "sketch-localize": lambda e, p: stars.localize(local.sketch(e), p),
    "cc-computation": lambda e, p: local.cc_computation(e, p),
    "local-cc": lambda e, p: connected_components(e, local_threshold=MAX_LOCAL_THRESHOLD),
    "hub-init": lambda e, p: stars.to_hub_edges(e),
    "hub-large-star": lambda e, p: stars.hub_large_star(e, p.parts),
    "hub-small-star": lambda e, p: stars.hub_small_star(e),
    "hub-labels": lambda e, p: stars.hub_labels(e),
}


def convert_text(spark: SparkSession, source: str, target: str, mode: str = "DROPMALFORMED") -> dict[str, int]:
    """A text edge list to Parquet in one pass; returns the lines read, the edges kept and the malformed lines skipped."""
    edges, seen = counted_edges_text(spark, source)
    if mode == "FAILFAST":
        seen = Observation()
        edges = read_edges_text(spark, source).observe(seen, F.count("*").alias("read"), F.lit(0).cast("bigint").alias("skipped"))
    edges.write.mode("overwrite").parquet(target)
    found = seen.get
    return {"input": found["read"], "output": found["read"] - found["skipped"], "skipped": found["skipped"]}


def label_text(spark: SparkSession, source: str, target: str, limit: int = ONE_TASK) -> int:
    """Text edges to text labels of all nodes, solved in one task where a sketch has at most ``limit`` edges; returns the number of nodes."""
    labels = connected_components(read_edges_text(spark, source), local_threshold=limit, include_roots=True)
    seen = Observation()
    write_labels_text(labels.observe(seen, F.count(F.lit(1)).alias("n")), target)
    return seen.get["n"]


def run_step(spark: SparkSession, step: str, source: str, target: str, p: PartitionFn) -> dict[str, int]:
    edges = spark.read.parquet(source)
    rows = STEPS[step](edges, p)
    (write_routed if "route" in rows.columns else lambda df, path: df.write.mode("overwrite").parquet(path))(rows, target)
    done = spark.read.parquet(target)
    changes = done.where("ch").count() if "ch" in done.columns else 0
    return {"input": edges.count(), "output": done.count(), "changes": changes}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = argparse.ArgumentParser(prog="graphloom.steps")
    args.add_argument("step", choices=["init", "union-find", *STEPS])
    args.add_argument("input")
    args.add_argument("output")
    args.add_argument("-p", "--num-partitions", type=int, default=1)
    args.add_argument("--partition-fn", choices=KINDS, default="hash")
    got = args.parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"graphloom {got.step}").getOrCreate()
    if got.step == "init":
        print(*(f"{k} {v}" for k, v in convert_text(spark, got.input, got.output).items()))
    elif got.step == "union-find":
        print("output", label_text(spark, got.input, got.output))
    else:
        print(*(f"{k} {v}" for k, v in run_step(spark, got.step, got.input, got.output, PartitionFn(got.num_partitions, got.partition_fn)).items()))


if __name__ == "__main__":
    main()
