"""Small Arrow batches for what a step runs itself, with the session's setting put back behind it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Texts go to Python workers in Arrow batches of about so many bytes at most. Spark's own bound of 64 MB a batch makes each of
#: an executor's tasks hold several buffers of that size on both sides, outside of the heap, where they are hardly given back.
BATCH_BYTES = 4 << 20
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Lower the session's bound for the jobs run inside; a lower one stays. Lazy results that run later have the old one."""
    before = spark.conf.get(_BOUND)
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BOUND, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BOUND, before)
