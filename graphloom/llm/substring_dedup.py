"""Long repeated spans by de Bruijn compaction: every word that an earlier document already has in a run of ``span`` words.

The graph's edges are the runs of ``span`` words (windows) and its nodes the runs one word shorter. It is never written out
window by window:

1. *Chunks.* A window's minimizer is the least hash among its runs of ``SEED`` words. Windows in a row with one minimizer are
   a chunk, some 17 windows on average. Equal windows have equal minimizers, so only chunks whose minimizer is met
   again can hold a repeat; a bitmap lets these pass (and few others), and only they are written.
2. *Paths.* Of each different chunk the occurrences are counted and the least (doc_id, place) is kept as its source. A join
   of chunks with their successors finds the nonbranching links: two chunks that always follow one another, as equal
   counts, one successor and adjoining sources tell. Linked chunks stand in a row in their source's text, so numbering the
   links there makes each path one row, however long. Where a path occurs in a document after its source's, all its windows
   are repeats.
3. *Branches.* Chunks that share a minimizer but are not equal share some windows at most. Their windows are listed one by
   one, but only for the first document that has the chunk: all later ones are settled by step 2. The least (doc_id, place)
   of each window is its source; windows in a row with sources in a row are one span.
4. *Verification.* Every span has the coordinates of its source. The words of both are digested from the texts, and only
   spans of equal digests count.
5. The words that spans cover are taken out of each text.

Chunks and windows are told apart by two 64-bit hashes. Texts are shuffled only where a bitmap says that they are needed.
A hot chunk or window is one row on one side of its joins; adaptive execution splits the other side.

Defined results: null and empty texts and those of fewer words than a window lose nothing. Rows that repeat a doc_id are each
judged by their own text and never against one another; rows with a null doc_id lose nothing and are no source. A run that
repeats within its own document alone stays. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.arrow_batches import small_batches
from graphloom.llm.bitmaps import FEW, Passing, bits_for, parted, set_positions
from graphloom.llm.text_arrays import BLANKS, byte_values, chunks, gathered, mix, powers_to, span_hashes, utf8, word_spans
from graphloom.plans.scratch import Scratch, side

#: Rows whose texts a worker rewrites at once.
SLICE = 512
#: Words of the runs that minimizers are taken from.
SEED = 16
_SECOND = np.uint64(0x7FB5D329728EA185)


def _prefix(words: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers_to(len(words))[0][: len(words)], out=sums[1:])
    return sums


def _runs(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of the words from each start to its end, whatever their place."""
    return mix((sums[ends] - sums[starts]) * powers_to(len(sums))[1][starts])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= width:
        x, reach = np.minimum(x[:-reach], x[reach:]), 2 * reach
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if reach < width else x


class _Words:
    """The words of some rows in a row: hashes, the row of each, and the first of each row."""

    def __init__(self, own: np.ndarray, bounds: np.ndarray, values: np.ndarray, part: np.ndarray):
        starts, ends, self.first = word_spans(own, bounds, part)
        self.rows = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))
        self.hashes = span_hashes(own, starts, ends, values)
        self.sums = _prefix(self.hashes)
        self._second = None

    def pairs(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes for the words from each start to its end."""
        if self._second is None:
            self._second = _prefix(mix(self.hashes ^ _SECOND))
        return _runs(self.sums, starts, ends).view(np.int64), _runs(self._second, starts, ends).view(np.int64)

    def chunks(self, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(starts, windows, minimizers)`` of the chunks, places counted in words of all rows."""
        n = len(self.hashes) - span + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        seed = min(SEED, span)
        at = np.arange(len(self.hashes) - seed + 1)
        least = sliding_least(_runs(self.sums, at, at + seed), span - seed + 1)
        inside = self.rows[:n] == self.rows[span - 1 :]
        opens = inside.copy()
        opens[1:] &= ~(inside[:-1] & (least[1:] == least[:-1]) & (self.rows[1:n] == self.rows[: n - 1]))
        starts = np.flatnonzero(opens)
        # A chunk ends where the next one opens, or where windows leave their row.
        outside = np.append(np.flatnonzero(~inside), n)
        ends = np.minimum(np.append(starts[1:], n), outside[np.searchsorted(outside, starts)])
        return starts, ends - starts, least[starts]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, _Words]]:
    """The words of runs of rows: the batch, the first row of the run, the words."""
    values, part = byte_values(BLANKS, fold=False)
    for batch in batches:
        data, bounds = utf8(batch.column("text"))
        for top, end in chunks(bounds):
            own = data[bounds[top] : bounds[end]]
            if len(own):
                yield batch, top, _Words(own, bounds[top : end + 1], values, part)


def _minimizers(span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, words in _each(batches):
            least, n = np.unique(words.chunks(span)[2], return_counts=True)
            if len(n):
                yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(n)], names=["m", "n"])

    return run


def _chunk_rows(span: int, passing: Passing, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, top, words in _each(batches):
            starts, windows, least = words.chunks(span)
            kept = np.flatnonzero(passing((least & np.uint64(bits - 1)).astype(np.int64)))
            if not len(kept):
                continue
            rows = words.rows[starts]
            c1, c2 = words.pairs(starts, starts + windows + span - 1)
            follows = np.zeros(len(starts), bool)
            follows[:-1] = (starts[1:] == starts[:-1] + windows[:-1]) & (rows[1:] == rows[:-1])
            after = pa.array(np.append(c1[1:], 0)[kept], mask=~follows[kept])
            at = pa.array(top + rows[kept])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("key").take(at), pa.array(starts[kept] - words.first[rows[kept]]), pa.array(windows[kept]), pa.array(least[kept].view(np.int64)), pa.array(c1[kept]), pa.array(c2[kept]), after],
                names=["id", "key", "at", "n", "m", "c1", "c2", "after"],
            )

    return run


def _wanted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the array column ``wanted(at, n)``: the row of each element, its place and its length."""
    column = batch.column("wanted")
    flat, counts = column.flatten(), column.value_lengths().fill_null(0).to_numpy()
    return np.repeat(np.arange(len(counts)), counts), flat.field("at").to_numpy(), flat.field("n").to_numpy()


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, _Words]]:
    """Runs of rows with what is wanted of them: the rows' numbers in the batch, places in the run's words, lengths."""
    for batch, top, words in _each(batches):
        rows, at, n = _wanted(batch)
        here = (rows >= top) & (rows < top + len(words.first) - 1)
        if here.any():
            yield batch, rows[here], words.first[rows[here] - top] + at[here], n[here], words


def _window_rows(span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, at, n, words in _asked(batches):
            first = np.cumsum(n) - n
            places = np.repeat(at - first, n) + np.arange(n.sum())
            places = np.unique(places)
            own = words.rows[places]
            base = rows[0] - words.rows[at[0]]
            h1, h2 = words.pairs(places, places + span)
            take = pa.array(base + own)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("key").take(take), pa.array(places - words.first[own]), pa.array(h1), pa.array(h2)], names=["id", "key", "at", "h1", "h2"])

    return run


def _digests(span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A digest of the words of each wanted run of windows, out of the text itself."""
    part = byte_values(BLANKS)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, n = _wanted(batch)
            data, bounds = utf8(batch.column("text"))
            ends = np.cumsum(batch.column("wanted").value_lengths().fill_null(0).to_numpy())
            for row in np.flatnonzero(np.diff(ends, prepend=0)):
                text, cuts = _joined(data[bounds[row] : bounds[row + 1]], part)
                mine = np.flatnonzero(rows == row) if row == 0 else np.arange(ends[row - 1], ends[row])
                tops = 2 * (at[mine] + n[mine] + span - 1)
                # Hashes that collide may ask for words that the text does not have: no digest, no span.
                found = [hashlib.blake2b(text[cuts[2 * a] : cuts[top]].tobytes(), digest_size=16).digest() if top < len(cuts) else None for a, top in zip(at[mine], tops, strict=True)]
                take = pa.array(np.full(len(mine), row))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("key").take(take), pa.array(at[mine]), pa.array(n[mine]), pa.array(found, pa.binary())], names=["id", "key", "at", "n", "digest"])

    return run


def _joined(own: np.ndarray, part: np.ndarray, stays: Callable[[int], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The words of a text, each with a blank behind it, and the bounds of words and blanks in turn."""
    starts, ends, _ = word_spans(own, np.array([0, len(own)]), part) if len(own) else (np.empty(0, np.int64),) * 3
    if stays is not None:
        kept = stays(len(starts))
        starts, ends = starts[kept], ends[kept]
    data = np.append(own, np.uint8(32))
    between = lambda spans, blank: np.stack([spans, np.full(len(spans), blank)], axis=1).reshape(-1)
    return gathered(data, between(starts, len(own)), between(ends, len(own) + 1))


def _stripped(span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``n_words``, ``n_removed`` and the words that stay, joined by blanks."""
    part = byte_values(BLANKS)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            rows, at, n = _wanted(batch)
            data, bounds = utf8(batch.column("text"))
            cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            totals, left, texts = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), []
            for row in range(batch.num_rows):
                mine = slice(cuts[row], cuts[row + 1])

                def stays(words: int, row: int = row, mine: slice = mine) -> np.ndarray:
                    cover = np.zeros(words + 1, np.int64)
                    np.add.at(cover, at[mine], 1)
                    np.add.at(cover, at[mine] + n[mine] + span - 1, -1)
                    kept = np.cumsum(cover)[:words] == 0
                    totals[row], left[row] = words, kept.sum()
                    return np.flatnonzero(kept)

                text, _ = _joined(data[bounds[row] : bounds[row + 1]], part, stays)
                texts.append(text[:-1].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(totals), pa.array(totals - left), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


class _Graph:
    """The compacted graph of one corpus. ``docs``: ``id, key, text`` without null ids."""

    def __init__(self, docs: DataFrame, span: int, scratch: Scratch):
        self.docs, self.span, self.scratch = docs, span, scratch

    def occurrences(self) -> DataFrame:
        """Chunks whose minimizer is met again (and few others), each where it stands: ``id, key, at, n, m, c1, c2, after``."""
        met = self.docs.select("text").mapInArrow(_minimizers(self.span), "m long, n long").groupBy("m").agg(F.sum("n").alias("n")).where("n > 1")
        met = self.scratch.table(met.select("m"), "minimizers", counted=True)
        bits = bits_for(met._graphloom_rows)
        passing = set_positions(met.select(F.col("m").bitwiseAND(F.lit(bits - 1).cast("bigint")).alias("p")), bits)
        rows = self.docs.mapInArrow(_chunk_rows(self.span, passing, bits), "id long, key long, at long, n long, m long, c1 long, c2 long, after long")
        rows = self.scratch.table(rows, "chunks", counted=True)
        self.scratch.drop(met)
        return rows

    def different(self, rows: DataFrame) -> DataFrame:
        """A row a different chunk: its number of occurrences, its source, and its successor where it is always the same."""
        source = F.min(F.struct("id", "key", "at")).alias("source")
        one = (F.min("after") == F.max("after")) & (F.count("after") == F.count("*"))
        made = rows.groupBy("c1", "c2").agg(source, F.count("*").alias("met"), F.first("n").alias("n"), F.first("m").alias("m"), F.when(one, F.min("after")).alias("after"))
        return self.scratch.table(made, "different", counted=True)

    def paths(self, chunks_: DataFrame) -> DataFrame:
        """Nonbranching paths of repeated chunks: the first chunk of each with the windows of all."""
        often = chunks_.where("met > 1")
        ahead = often.where("after IS NOT NULL").select(F.col("after").alias("c1"), F.col("met").alias("met_b"), F.struct("source.id", "source.key", (F.col("source.at") + F.col("n")).alias("at")).alias("joins"))
        ahead = side(self.scratch.table(ahead, "ahead", counted=True), fixed=True)
        linked = often.join(ahead, "c1", "left").withColumn("linked", F.coalesce((F.col("met") == F.col("met_b")) & (F.col("source") == F.col("joins")), F.lit(False)))
        linked = linked.groupBy("c1", "c2", "source", "n").agg(F.max("linked").alias("linked"))
        # A path's chunks stand in a row in the text of its source, and each but the first is linked to the one before.
        text = Window.partitionBy("source.id", "source.key").orderBy("source.at")
        numbered = linked.withColumn("path", F.sum((~F.col("linked")).cast("bigint")).over(text))
        return numbered.groupBy("source.id", "source.key", "path").agg(F.min_by(F.struct("c1", "c2", "source"), "source.at").alias("head"), F.sum("n").alias("windows")).select("head.*", "windows")

    def whole_paths(self, rows: DataFrame, chunks_: DataFrame) -> DataFrame:
        """Spans of paths that begin in an earlier document."""
        paths = self.scratch.table(self.paths(chunks_), "paths", counted=True)
        spans = rows.select("id", "key", "at", "c1", "c2").join(side(paths, fixed=True), ["c1", "c2"]).where("source.id < id")
        return spans.select("id", "key", "at", F.col("windows").alias("n"), "source")

    def branch_windows(self, rows: DataFrame, chunks_: DataFrame) -> DataFrame:
        """Spans of windows that unlike chunks share, for the first document of each chunk."""
        scratch = self.scratch
        shared = scratch.table(chunks_.groupBy("m").agg(F.count("*").alias("k")).where("k > 1").select("m"), "branching", counted=True)
        unlike = scratch.table(chunks_.join(side(shared, fixed=True), "m", "left_semi").select("c1", "c2", F.col("source.id").alias("first")), "unlike", counted=True)
        wanted = rows.select("id", "key", "at", "n", "c1", "c2").join(side(unlike, fixed=True), ["c1", "c2"]).where("id = first").select("id", "key", "at", "n")
        windows = scratch.table(self.texts(wanted, "windows").mapInArrow(_window_rows(self.span), "id long, key long, at long, h1 long, h2 long"), "windows")
        place = F.struct("id", "key", "at")
        known = windows.groupBy("h1", "h2").agg(F.min(place).alias("source"), F.max("id").alias("last")).where("source.id < last").drop("last")
        known = scratch.table(known, "known", counted=True)
        found = windows.join(side(known, fixed=True), ["h1", "h2"]).where("source.id < id").select("id", "key", "at", "source").distinct()
        found = found.withColumn("ahead", F.col("at") - F.col("source.at"))
        way = Window.partitionBy("id", "key", "source.id", "source.key", "ahead")
        runs = found.withColumn("run", F.col("at") - F.row_number().over(way.orderBy("at")))
        runs = runs.groupBy("id", "key", F.col("source.id").alias("sid"), F.col("source.key").alias("skey"), "ahead", "run").agg(F.min("at").alias("at"), F.count("*").alias("n"))
        return runs.select("id", "key", "at", "n", F.struct(F.col("sid").alias("id"), F.col("skey").alias("key"), (F.col("at") - F.col("ahead")).alias("at")).alias("source"))

    def texts(self, wanted: DataFrame, name: str) -> DataFrame:
        """The texts of which windows are ``wanted(id, key, at, n)``, each with the array of these."""
        grouped = self.scratch.table(wanted.distinct().groupBy("id", "key").agg(F.collect_list(F.struct("at", "n")).alias("wanted")), f"wanted-{name}", counted=True)
        hits, _ = parted(self.docs, ["id", "key"], grouped, grouped._graphloom_rows, "id", "key")
        return hits.join(side(grouped, most=FEW), ["id", "key"])

    def verified(self, spans: DataFrame) -> DataFrame:
        """Those spans whose words are the same at their source."""
        spans = self.scratch.table(spans, "spans")
        sources = spans.select("source.id", "source.key", "source.at", "n")
        both = self.texts(spans.select("id", "key", "at", "n").unionByName(sources), "digests")
        digests = both.mapInArrow(_digests(self.span), "id long, key long, at long, n long, digest binary").dropDuplicates(["id", "key", "at", "n"])
        digests = self.scratch.table(digests, "digests", counted=True)
        right = digests.select(F.struct("id", "key", "at").alias("source"), "n", F.col("digest").alias("there"))
        here = spans.join(side(digests, fixed=True), ["id", "key", "at", "n"])
        return here.join(side(right, rows=digests._graphloom_rows, fixed=True), ["source", "n"]).where("digest = there").select("id", "key", "at", "n", "source")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def repeated_spans(docs: DataFrame, span: int = 50) -> DataFrame:
    """``doc_id, text_key, at, n, source``: in the text, ``n`` windows of ``span`` words from word ``at`` on that also stand at ``source(id, key, at)``.

    Each window of a document that also starts in a document of a smaller doc_id is in one of its spans at least.
    """
    return _spans(_keyed(docs), span, Scratch(docs.sparkSession, "spans")).withColumnsRenamed({"id": "doc_id", "key": "text_key"})


def _spans(keyed: DataFrame, span: int, scratch: Scratch) -> DataFrame:
    graph = _Graph(keyed.where("id IS NOT NULL"), span, scratch)
    with small_batches(keyed.sparkSession):
        rows = graph.occurrences()
        different = graph.different(rows)
        return graph.verified(graph.whole_paths(rows, different).unionByName(graph.branch_windows(rows, different)))


def remove_repeats(docs: DataFrame, span: int = 50) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_words, n_removed, kept``, one row a document; ``kept``: the other words, joined by blanks.

    The result is a written table.
    """
    scratch, keyed = Scratch(docs.sparkSession, "repeats"), _keyed(docs)
    spans = scratch.table(_spans(keyed, span, scratch).groupBy("id", "key").agg(F.collect_list(F.struct("at", "n")).alias("wanted")), "found", counted=True)
    hits, clear = parted(keyed, ["id", "key"], spans, spans._graphloom_rows, "id", "key")
    # An array of no spans stands for the texts that lose nothing.
    hits = hits.join(side(spans, most=FEW), ["id", "key"], "left").select("id", "text", "wanted")
    clear = clear.select("id", "text", F.lit(None).cast("array<struct<at: bigint, n: bigint>>").alias("wanted"))
    stripped = clear.unionByName(hits).mapInArrow(_stripped(span), "doc_id long, n_words long, n_removed long, kept string")
    with small_batches(docs.sparkSession):
        return scratch.table(stripped, "kept")
