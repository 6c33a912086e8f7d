"""Extension: keep a label table up to date under a stream of new edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.plans.api import connected_components, release
from graphloom.plans.scratch import Scratch, remove, shared_dir, side


def merge_labels(labels: DataFrame | None, new_edges: DataFrame, **options) -> DataFrame:
    """Labels after ``new_edges``. Only the components that these touch are solved, each as the one node of its root.

    Ends become their roots by a join; the edges between roots are as few as the batch; what they join gets its new
    label by a second join, and all other labels pass as they are.
    """
    if labels is None:
        return connected_components(new_edges, **options)
    scratch = Scratch(new_edges.sparkSession, "merge")
    edges = scratch.table(new_edges.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).where("u IS NOT NULL AND v IS NOT NULL"), "batch", counted=True)
    ends = scratch.table(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "ends", counted=True)
    known = scratch.table(labels.join(side(ends, fixed=True), "node").select("node", "component"), "known", counted=True)
    root = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"{end}_root"))
    between = edges.join(side(root("u"), rows=known._graphloom_rows), "u", "left").join(side(root("v"), rows=known._graphloom_rows), "v", "left")
    moved = connected_components(between.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v")), **options)
    solved, moved = moved, scratch.table(moved, "moved", counted=True)
    release(solved)
    again = moved.select(F.col("node").alias("component"), F.col("component").alias("least"))
    old = labels.join(side(again, rows=moved._graphloom_rows, fixed=True), "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    out = old.unionByName(moved).distinct() if options.get("include_roots") else old.unionByName(moved)
    out._graphloom_run = scratch
    return out


def maintain(edges: DataFrame, path: str, checkpoint: str | None = None, **options) -> StreamingQuery:
    """Start a query that writes the labels after batch ``n`` to ``path/v<n>``.

    A batch that runs again overwrites its own version and reads the one before, so a restart repeats nothing. Two versions
    stay, and no table of a batch outlives it.
    """
    spark = edges.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{path}/v{number - 1}") if number else None
        labels = merge_labels(before, batch, **options)
        labels.write.mode("overwrite").parquet(f"{path}/v{number}")
        release(labels)
        if number > 1:  # a restart reads the version before its own at most
            remove(spark, f"{path}/v{number - 2}")

    where = checkpoint or f"{shared_dir(spark)}/labels-stream"
    return edges.writeStream.foreachBatch(each).option("checkpointLocation", where).start()
