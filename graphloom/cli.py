"""``python -m graphloom.cli INPUT OUTPUT``: label a text edge list."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from graphloom.functions.partitioner import KINDS
from graphloom.plans.algorithms import ALGORITHMS
from graphloom.plans.api import connected_components, release
from graphloom.plans.metrics import RunMetrics
from graphloom.sources.edges import read_edges_parquet, read_edges_text, write_labels_parquet, write_labels_text


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="graphloom", description="Connected components of an edge list.")
    out.add_argument("input")
    out.add_argument("output")
    out.add_argument("-a", "--algorithm", choices=list(ALGORITHMS), default="pa_full")
    out.add_argument("-t", "--local-threshold", type=int, default=100_000)
    out.add_argument("-p", "--num-partitions", type=int)
    out.add_argument("--partition-fn", choices=KINDS, default="hash")
    out.add_argument("--max-rounds", type=int, default=60)
    out.add_argument("--include-roots", action="store_true")
    out.add_argument("--mode", choices=["FAILFAST", "DROPMALFORMED"], default="FAILFAST")
    out.add_argument("--format", choices=["text", "parquet"], default="text")
    out.add_argument("--resume", metavar="NAME", help="name the run; the same call goes on after the last finished half round")
    out.add_argument("-q", "--quiet", action="store_true", help="print no report")
    out.add_argument("-v", "--verbose", action="store_true", help="also print a line for each round")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> RunMetrics:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("graphloom").getOrCreate()
    edges = read_edges_text(spark, args.input, mode=args.mode) if args.format == "text" else read_edges_parquet(spark, args.input)
    metrics = RunMetrics("", 0, 0, input=args.input)
    labels = connected_components(edges, args.algorithm, args.num_partitions, args.local_threshold, args.include_roots, args.partition_fn, args.max_rounds, metrics, args.resume)
    (write_labels_text if args.format == "text" else write_labels_parquet)(labels, args.output)
    release(labels)
    if args.verbose:
        for r in metrics.rounds:
            print(r)
    if not args.quiet:
        print(metrics.row())
    return metrics


if __name__ == "__main__":
    main()
