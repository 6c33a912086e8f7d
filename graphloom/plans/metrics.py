"""Counters of an iterative run, gathered by the jobs that write the scratch tables."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class RoundMetrics:
    """Edges that left each half round by route, and rows that changed."""

    round: int
    lout: int = 0
    lcc: int = 0
    lin: int = 0
    sout: int = 0
    sin: int = 0
    lchange: int = 0
    schange: int = 0


@dataclass
class RunMetrics:
    """One run: ``row()`` is the tab-separated report line."""

    app: str
    threshold: int
    partitions: int
    input: str = ""
    init_s: float = 0.0
    rounds_s: float = 0.0
    compute_s: float = 0.0
    total_s: float = 0.0
    rounds: list[RoundMetrics] = field(default_factory=list)
    _at: float = field(default_factory=time.monotonic)

    def lap(self, name: str) -> None:
        """Add the time since the last lap to ``name`` and to the total."""
        now = time.monotonic()
        took, self._at = now - self._at, now
        setattr(self, name, getattr(self, name) + took)
        self.total_s += took

    def row(self) -> str:
        parts = (self.app, self.input, self.threshold, self.partitions, len(self.rounds), f"{self.init_s:.3f}", f"{self.rounds_s:.3f}", f"{self.compute_s:.3f}", f"{self.total_s:.3f}")
        return "\t".join(map(str, parts))

    def rounds_df(self, spark: SparkSession) -> DataFrame:
        schema = "round long, lout long, lcc long, lin long, sout long, sin long, lchange long, schange long"
        return spark.createDataFrame([tuple(asdict(r).values()) for r in self.rounds], schema)
