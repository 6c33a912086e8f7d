"""Numbers of rows in a global order, by sorted ranges: no task holds more than a range, whatever the keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import Scratch


def ranked(rows: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """``rows`` with ``place``, their number from 1 in ``order``, which must tell all rows apart or leave ties open."""
    # The number holds the range in its upper 31 bits and the place within it in the others.
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    dealt = scratch.table(dealt, "ranges")
    part = F.shiftright("place", 33)
    sizes = sorted((r["part"], r["n"]) for r in dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "part bigint, start bigint"))
    return dealt.withColumn("part", part.cast("bigint")).join(offsets, "part").withColumn("place", F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "start")
