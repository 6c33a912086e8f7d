"""Table functions for SQL: ``SELECT * FROM local_components(TABLE(edges) PARTITION BY p)``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from graphloom.operators.local import Folding


class LocalComponents:
    """``(node, component)`` of the non-roots among the edges ``u, v`` of each partition, solved apart.

    The columns are found by name, others are ignored; rows with a null end are no edges. Edges are folded as they come,
    so a task holds the nodes of one partition. Without ``PARTITION BY`` each task solves what it happens to read, which is a
    sketch. A component that reaches over partitions has labels in each.
    """

    def __init__(self) -> None:
        self._folding = Folding()

    def eval(self, edges: pa.RecordBatch) -> Iterator[pa.Table]:
        ends = pa.table({c: edges.column(c).cast(pa.int64()) for c in ("u", "v")})
        for batch in ends.drop_null().to_batches():
            self._folding.add(batch)
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        for out in self._folding.rows():
            yield pa.Table.from_batches([out]).rename_columns(["node", "component"])


local_components = arrow_udtf(LocalComponents, returnType="node bigint, component bigint")


def register(spark: SparkSession) -> None:
    """Make the table functions known to the SQL of a session."""
    spark.udtf.register("local_components", local_components)
