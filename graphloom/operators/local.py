"""Solvers inside one task: sketch of an input split, local solve of a partition, solve of a small input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.partitioner import PartitionFn

_LABELS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(node, least reachable node)`` of the edges ``u[i] - v[i]``, nodes ascending.

    Hook-and-jump over ranks instead of a pointer-chasing union-find: every root with a smaller neighbouring root
    hooks to the least of them, then paths are halved until flat. At least half of the touching roots go in each
    pass, so chains of any length take few passes and no recursion.
    """
    nodes, ranks = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ranks[: len(u)], ranks[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(flat := root[root], root):
            root = flat
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def forest(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Non-root nodes with their roots."""
    nodes, roots = components(u, v)
    child = nodes != roots
    return pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(roots[child])], schema=_LABELS)


def _ends(batch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v"))


#: Edges gathered before they are folded into the forest, at least.
FOLD = 1 << 20


class Folding:
    """A forest that takes edges in portions; it holds at most the distinct nodes seen, and edges that wait.

    A fold waits until as many edges are gathered as the forest has, so each edge takes part in few folds.
    """

    def __init__(self) -> None:
        self._tree, self._waiting, self._size = (np.empty(0, np.int64), np.empty(0, np.int64)), [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        self._waiting.append(_ends(batch))
        self._size += batch.num_rows
        if self._size >= max(FOLD, len(self._tree[0])):
            self._fold()

    def _fold(self) -> None:
        parts = [self._tree, *self._waiting]
        self._tree, self._waiting, self._size = _ends(forest(*(np.concatenate([part[i] for part in parts]) for i in (0, 1)))), [], 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Non-root nodes with their roots, a root's nodes together: what repeats is next to each other where rows are sent and written."""
        self._fold()
        order = np.argsort(self._tree[1], kind="stable")
        u, v = (x[order] for x in self._tree)
        for i in range(0, len(u), FOLD):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + FOLD]) for x in (u, v)], schema=_LABELS)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold batches into one forest; the state is at most the distinct nodes of the split."""
    folding = Folding()
    for batch in batches:
        folding.add(batch)
    yield from folding.rows()


def sketch(edges: DataFrame) -> DataFrame:
    """A spanning forest of each input split: connectivity stays, edges fall below the split's node count."""
    return edges.select("u", "v").mapInArrow(_sketch, "u long, v long")


def _firsts(v: np.ndarray) -> np.ndarray:
    """True where a run of equal values begins."""
    return np.append(True, v[1:] != v[:-1])[: len(v)]


def _headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for out in _sketch(batches):
        yield out.append_column("head", pa.array(_firsts(_ends(out)[1])))


def headed_sketch(edges: DataFrame) -> DataFrame:
    """:func:`sketch` with ``head``: true in one edge of each root and split at least, so that the roots are told without a distinct."""
    return edges.select("u", "v").mapInArrow(_headed, "u long, v long, head boolean")


_ROUTED = pa.schema([*_LABELS, ("route", pa.string()), ("head", pa.bool_())])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    folding, marks = Folding(), [np.empty(0, np.int64)]
    for batch in batches:
        marks.append(np.unique(_ends(batch)[1]))
        folding.add(batch)
    marked = np.unique(np.concatenate(marks))
    for out in folding.rows():
        u, v = _ends(out)
        core = np.isin(u, marked)
        head = np.zeros(len(u), bool)
        head[core] = _firsts(v[core])
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.where(core, "core", "leaf"), pa.string()), pa.array(head)], schema=_ROUTED)


def settle(trees: DataFrame) -> DataFrame:
    """``(u, v, route, head)``: the forests ``(u child, v root)`` of many splits as one edge a child and task.

    All edges of a child come into one task, which folds them, so there are as many edges as nodes and those between the
    roots of splits. A child has a row a split at most, so no task gets a hub. A root tells by a loop, dealt the same way,
    that it has children elsewhere; trees with ``head`` tell it in the same exchange, of others the roots are made distinct
    first. Children are dealt by ranges: where near ids tend to be linked, a task meets whole neighbourhoods and folds their
    cycles, though no split of the input has held two edges of one. ``leaf``: ``u`` has no other edge, its component is that of ``v``. ``core``: all others, with
    ``head`` as in :func:`headed_sketch`, so that they are settled again by one exchange.
    """
    edge, loop = F.struct("u", "v"), F.struct(F.col("v").alias("u"), "v")
    if "head" in trees.columns:
        ends = trees.select(F.inline(F.when(F.col("head"), F.array(edge, loop)).otherwise(F.array(edge))))
    else:
        ends = trees.select("u", "v").unionByName(trees.select(F.inline(F.array(loop))).distinct())
    return ends.repartitionByRange("u").mapInArrow(_settle, "u long, v long, route string, head boolean")


def cc_computation(edges: DataFrame, p: PartitionFn) -> DataFrame:
    """``(node, component)`` of the non-roots, solved apart in each partition ``p(u)``.

    Right for edges in which every non-root reaches its root inside its own partition, as the partition-aware
    plans leave them. Edges are folded as they stream by, so a task holds the nodes of its partition, not its edges.
    """

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None

        def ends() -> Iterator[pa.RecordBatch]:
            nonlocal part
            for batch in batches:
                part = batch.column("part")[0].as_py() if batch.num_rows else part
                yield batch.select(["u", "v"])

        for out in _sketch(ends()):
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(out.num_rows, part, np.int32))], names=["node", "component", "part"])

    # A task for each partition, dealt by its number: nothing is sorted to bring a partition together.
    dealt = edges.select("u", "v", p(F.col("u")).cast("int").alias("part")).repartitionById(p.parts, "part")
    solved = dealt.mapInArrow(solve, "node long, component long, part int")
    # Each node's own partition labels it; a parent seen from elsewhere is labelled there again and goes.
    return solved.where(p(F.col("node")) == F.col("part")).select("node", "component")


def local_cc(edges: DataFrame, limit: int) -> DataFrame:
    """Solve all edges in one task, for small graphs: no rounds, and nothing is collected to the driver.

    The task fails above ``limit`` edges, so that its memory stays bounded.
    """

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal seen
            for batch in batches:
                seen += batch.num_rows
                if seen > limit:
                    raise ValueError(f"more than {limit} edges for a local solve")
                yield batch

        return _sketch(counted())

    return edges.select("u", "v").repartition(1).mapInArrow(solve, "u long, v long")
