"""Edge sources: text, Parquet and any DataFrame with two id columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Blank characters between the ids of a line: space, tab, carriage return, form feed.
BLANKS = "[ \\t\\r\\f]+"


def read_edges_text(spark: SparkSession, *paths: str, mode: str = "FAILFAST", glob: str | None = None) -> DataFrame:
    """Lines ``<long> <long> [ignored...]``; ``mode`` FAILFAST raises on a malformed line, DROPMALFORMED skips it."""
    if mode not in ("FAILFAST", "DROPMALFORMED"):
        raise ValueError(f"unknown mode: {mode}")
    ids = _lines(spark, paths, glob)
    if mode == "DROPMALFORMED":
        return ids.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL")
    bad = F.raise_error(F.concat(F.lit("malformed edge line: "), F.col("value"))).cast("bigint")
    return ids.select(*(F.when(F.col("u").isNull() | F.col("v").isNull(), bad).otherwise(F.col(c)).alias(c) for c in ("u", "v")))


def _lines(spark: SparkSession, paths: tuple[str, ...], glob: str | None = None) -> DataFrame:
    """``(value, u, v)`` of every line, an end null where it is no number."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    parts = F.split(F.regexp_replace("value", "^[ \\t\\r\\f]+", ""), BLANKS)
    lines = reader.text(list(paths)).select("value", parts.alias("p"))
    return lines.select("value", *(F.expr(f"try_cast(try_element_at(p, {i}) AS BIGINT)").alias(c) for i, c in ((1, "u"), (2, "v"))))


def counted_edges_text(spark: SparkSession, *paths: str, glob: str | None = None) -> tuple[DataFrame, Observation]:
    """The edges of text lines, malformed ones skipped, and an observation that the job which reads them fills: ``read`` lines and ``skipped`` ones."""
    seen, bad = Observation(), F.col("u").isNull() | F.col("v").isNull()
    rows = _lines(spark, paths, glob).observe(seen, F.count("*").alias("read"), F.coalesce(F.sum(bad.cast("bigint")), F.lit(0)).alias("skipped"))
    return rows.where(~bad).select("u", "v"), seen


def read_edges_parquet(spark: SparkSession, *paths: str, u: str = "u", v: str = "v", glob: str | None = None) -> DataFrame:
    """Edge columns of Parquet tables; other columns are not read. ``glob``: only files of such names."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return edges_from(reader.parquet(*paths), F.col(u), F.col(v))


def edges_from(df: DataFrame, u: Column | str, v: Column | str) -> DataFrame:
    """``(u, v)`` longs out of any DataFrame; rows with a null end are no edges and go."""
    u, v = (F.col(c) if isinstance(c, str) else c for c in (u, v))
    return df.select(u.cast("bigint").alias("u"), v.cast("bigint").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")


def write_labels_text(labels: DataFrame, path: str) -> None:
    """``node TAB component`` lines, replacing what is there."""
    labels.select(F.concat_ws("\t", "node", "component").alias("value")).write.mode("overwrite").text(path)


def read_labels_text(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_labels_text` wrote."""
    return read_edges_text(spark, path).toDF("node", "component")


def write_labels_parquet(labels: DataFrame, path: str) -> None:
    labels.select("node", "component").write.mode("overwrite").parquet(path)


def write_routed(routed: DataFrame, path: str) -> None:
    """Routed edges, a folder for each route, so that later readers prune by route."""
    routed.write.mode("overwrite").partitionBy("route").parquet(path)
