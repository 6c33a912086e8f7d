"""Shared scratch tables: cut lineage by writing Parquet into the folder of ``spark.checkpoint.dir``.

A written table survives the loss of any executor and is compressed. The planner compares its *compressed* bytes with the
broadcast threshold, so each table also knows its rows: :func:`side` asks for a shuffle where these are many. Nothing is
written to executor-local folders.
"""

from __future__ import annotations

import atexit
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.manifest import Manifest

#: A narrow table of more rows is never broadcast.
BROADCAST_ROWS = 50_000

#: Rows of the input for each task of a sized job, at most.
TASK_ROWS = 500_000

_own: dict[str, str] = {}


@contextmanager
def sized(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Shuffles and scans of the jobs run inside have a task for each ``TASK_ROWS`` of the ``rows`` they work on.

    Else as many shuffle partitions as ever share a growing table, and adaptive execution, which sees compressed bytes,
    puts them together again: a task's hash maps and sorts grow with the input until they spill. What needs no more tasks
    than the cluster runs at once is left as it is. The session's settings are put back.
    """
    tasks = math.ceil((rows or 0) / TASK_ROWS)
    if tasks <= spark.sparkContext.defaultParallelism:
        yield
        return
    shuffles = "spark.sql.shuffle.partitions"
    wanted = {
        shuffles: str(max(tasks, int(spark.conf.get(shuffles)))),
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.minPartitionNum": str(tasks),
    }
    with _conf(spark, wanted):
        yield


#: Shuffle files go with the job that has written them. Else they stay on the executors until the driver's heap is collected, which
#: a driver that sees counters alone has no cause for: the disk would hold those of all half rounds.
CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def _conf(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Jobs run inside have these settings; the session's are put back."""
    given = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in given.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a session in one process may name none and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(_remove_local, _own[app])
    return f"file://{_own[app]}"


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


class Scratch:
    """Tables of one run in one folder of the shared directory.

    ``resume`` names a run that a restarted driver goes on with: its folder has that name, a manifest tells the tables
    that are finished and what their jobs have counted, and these are read instead of written again. Such a run stays
    until it is closed; two drivers must not share one.
    """

    def __init__(self, spark: SparkSession, name: str = "run", resume: str | None = None):
        if resume is not None and not re.fullmatch("[A-Za-z0-9_.-]+", resume):
            raise ValueError(f"a run's name has letters, digits, '.', '_' and '-' only: {resume!r}")
        self.spark = spark
        self.root = f"{shared_dir(spark)}/graphloom-{name}-{resume or uuid.uuid4().hex[:12]}"
        self._count = 0
        self._paths: list[str] = []
        self._manifest = Manifest(spark, self.root) if resume else None
        if not resume:
            _OPEN.append(self)

    def once(self, step: str, find: Callable[[], dict]) -> dict:
        """What ``find`` tells; a resumed run that has committed ``step`` takes it from its manifest."""
        if self._manifest is None:
            return find()
        if step not in self._manifest.done:
            self._manifest.commit(step, find())
        return self._manifest.done[step]

    def table(
        self, df: DataFrame, name: str = "t", codec: str = "zstd", partition_by: tuple[str, ...] = (), counted: bool = False, found: Callable[[], dict] = dict, work: int | None = None
    ) -> DataFrame:
        """Write ``df`` and read it back; column names must differ. ``counted``: its rows are counted by the same job.
        ``found`` tells, once written, what else that job has counted; it is kept as ``_graphloom_found``. ``work``: the rows
        that the job works on, where its tasks are to be :func:`sized` by them."""
        self._count += 1
        step = f"{self._count:03d}-{name}"
        path = f"{self.root}/{step}"

        def write() -> dict:
            seen = Observation()
            rows = df.observe(seen, F.count(F.lit(1)).alias("n")) if counted else df
            writer = rows.write.mode("overwrite").option("compression", codec)
            with _conf(self.spark, CLEAN), sized(self.spark, work):
                (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
            return {"rows": seen.get["n"] if counted else None, "found": found()}

        facts = self.once(step, write)
        out = self.read(path, df.schema)
        out._graphloom_rows, out._graphloom_found = facts["rows"], facts["found"]
        return out

    def read(self, path: str, schema) -> DataFrame:
        # What a resumed run has used and deleted before stands as an empty table; only finished steps read it.
        gone = self._manifest is not None and not self._manifest.exists(path)
        out = self.spark.createDataFrame([], schema) if gone else self.spark.read.schema(schema).parquet(path)
        out._graphloom_path = path
        self._paths.append(path)
        return out

    def split(self, df: DataFrame, name: str, by: str, counts: Callable[[], dict[str, int]]) -> dict[str, DataFrame]:
        """Write ``df`` apart by the values of ``by``; ``counts`` tells, once written, the rows of each: value -> table without ``by``."""
        whole = self.table(df, name, partition_by=(by,), found=counts)
        return self.parts(whole, by, whole._graphloom_found)

    def parts(self, whole: DataFrame, by: str, counts: dict[str, int]) -> dict[str, DataFrame]:
        """The tables that a table written apart by ``by`` consists of, but for those without rows."""
        schema = whole.drop(by).schema
        return {value: self.read(f"{whole._graphloom_path}/{by}={value}", schema) for value, n in counts.items() if n}

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that no later step reads."""
        path = getattr(df, "_graphloom_path", None)
        if path:
            remove(self.spark, path)

    def keep(self, df: DataFrame) -> None:
        """Delete all tables of this run but one."""
        for path in self._paths:
            if not f"{df._graphloom_path}/".startswith(f"{path}/"):
                remove(self.spark, path)
        self._paths = [df._graphloom_path]

    def close(self) -> None:
        """Delete all tables of this run. Lazy results that read them must have been used."""
        remove(self.spark, self.root)
        if self in _OPEN:
            _OPEN.remove(self)


def side(df: DataFrame, most: int = BROADCAST_ROWS, rows: int | None = None, fixed: bool = False) -> DataFrame:
    """A counted table as the side of a join: merged, not broadcast, where it has more than ``most`` rows.

    ``fixed``: its rows are a few numbers each, so up to ``most`` rows it is broadcast whatever its files weigh.
    """
    rows = getattr(df, "_graphloom_rows", None) if rows is None else rows
    if rows is None:
        raise ValueError("the table was written without a count")
    if rows > most:
        return df.hint("merge")
    return F.broadcast(df) if fixed else df


_OPEN: list[Scratch] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def close_all() -> None:
    """Delete every scratch table of this process, for long sessions between queries; runs at the end by itself."""
    while _OPEN:
        run = _OPEN.pop()
        if run.spark.sparkContext._jsc is not None:
            run.close()


atexit.register(close_all)
