"""Partition functions over node ids, as columns.

One :class:`PartitionFn` drives every step of a partition-aware run: the minimum per partition, the
localisation and the final local solve must all agree on where a node lives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("hash", "mod", "long_hash", "tabular")


@dataclass(frozen=True)
class PartitionFn:
    """``kind``: ``hash`` (xxhash64, the default), ``mod`` (pmod of the id), ``long_hash`` (JVM Long.hashCode)
    or ``tabular`` (the four 16-bit limbs hashed apart and xor-ed)."""

    parts: int
    kind: str = "hash"

    def __post_init__(self) -> None:
        if self.parts < 1:
            raise ValueError("a partition function needs at least one partition")
        if self.kind not in KINDS:
            raise ValueError(f"unknown partition function: {self.kind}")

    def __call__(self, node: Column) -> Column:
        parts = F.lit(self.parts).cast("bigint")
        if self.kind == "mod":
            return F.pmod(node, parts)
        if self.kind == "long_hash":
            return F.pmod(long_hash(node), parts)
        if self.kind == "tabular":
            return F.pmod(tabular(node), parts)
        return F.pmod(F.xxhash64(node), parts)


#: The prime modulus of the tabulation hash; squares of residues fit a long.
TABULAR_PRIME = 2**31 - 1


def tabular_factor(place: int) -> int:
    """The odd multiplier of the limb at ``place``."""
    return 1_664_525 * (2 * place + 1) + 2 * place


def tabular(node: Column) -> Column:
    """Tabulation hash: a function of each limb and its place instead of a table for it.

    A limb's value is ``y * y + limb`` modulo the prime, for ``y`` its product with the place's factor; in plain long
    arithmetic, so that any SQL engine can give the same partition.
    """
    out, prime = None, F.lit(TABULAR_PRIME).cast("bigint")
    for place in range(4):
        limb = F.shiftrightunsigned(node, 16 * place).bitwiseAND(F.lit(0xFFFF).cast("bigint"))
        y = (limb + 1) * F.lit(tabular_factor(place)).cast("bigint") % prime
        hashed = (y * y + limb) % prime
        out = hashed if out is None else out.bitwiseXOR(hashed)
    return out


def long_hash(node: Column) -> Column:
    """JVM ``Long.hashCode``: both halves xor-ed, read as a signed 32-bit value (kept as a long)."""
    low = node.bitwiseXOR(F.shiftrightunsigned(node, 32)).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    return F.when(low >= 2**31, low - 2**32).otherwise(low)


def hub_copy(node: Column, other: Column, parts: int) -> Column:
    """The copy of hub ``node`` that serves neighbour ``other``: a struct that sorts after the plain node."""
    return F.struct(node.alias("id"), F.lit(1).alias("cp"), F.pmod(other, F.lit(parts).cast("bigint")).alias("ci"))


def plain_node(node: Column) -> Column:
    """A node that is no copy, in the same struct form as :func:`hub_copy`."""
    return F.struct(node.alias("id"), F.lit(0).alias("cp"), F.lit(0).cast("bigint").alias("ci"))
