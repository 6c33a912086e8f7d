"""Bitmaps of bounded size that executors get by broadcast: filters that let all given keys pass, and few others.

Position p is bit p mod 8 of byte p div 8. The driver sees a bitmap of at most ``MAX_BITS`` bits, never the keys. A bitmap
that is too small for its keys only lets more of the others pass: what follows a filter must be right for any of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits for a key, and the largest bitmap (64 MB).
BITS_A_KEY, MAX_BITS = 32, 1 << 29
#: Rows to be merged with texts up to this number are broadcast; of more, those texts that meet the bitmap are shuffled.
FEW = 1_000
#: Bits of a block of Spark's bitmap functions.
_BLOCK = 32_768

Passing = Callable[[np.ndarray], np.ndarray]


def bits_for(count: int) -> int:
    """A power of two with room for ``count`` keys, up to the largest bitmap."""
    return min(MAX_BITS, max(1 << 20, 1 << (count * BITS_A_KEY).bit_length()))


def shared(spark: SparkSession, blocks: Iterable[tuple[int, bytes]], bits: int) -> Passing:
    """A broadcast test of positions, out of the bytes of the bitmap from some places on."""
    flags = np.zeros(bits // 8 + _BLOCK // 8, np.uint8)
    for at, found in blocks:
        flags[at : at + len(found)] = np.frombuffer(found, np.uint8)
    sent = spark.sparkContext.broadcast(flags)
    return lambda p: (sent.value[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)


def set_positions(places: DataFrame, bits: int) -> Passing:
    """The test for the bitmap of the positions ``places(p)``, each at least 0 and under ``bits``."""
    blocks = places.groupBy(F.expr("bitmap_bucket_number(p + 1)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p + 1))").alias("map"))
    return shared(places.sparkSession, (((row["n"] - 1) * (_BLOCK // 8), row["map"]) for row in blocks.toLocalIterator()), bits)


def key_filter(keys: DataFrame, count: int, *columns: str) -> tuple[Callable[..., Column], Passing]:
    """The bitmap of ``count`` distinct keys: the position of a key, and which positions are set."""
    bits = bits_for(count)
    position = lambda *c: F.pmod(F.xxhash64(*c), F.lit(bits).cast("bigint"))
    return position, set_positions(keys.select(position(*columns).alias("p")), bits)


def parted(rows: DataFrame, own: list, keys: DataFrame, count: int, *columns: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose key ``own`` may be among ``keys``, and those whose key is not. Only a number a row goes to Python, never its texts."""
    position, passing = key_filter(keys, count, *columns)
    hit = F.pandas_udf(lambda p: pd.Series(passing(p.to_numpy())), "boolean")(position(*own))
    return rows.where(hit), rows.where(~hit)
