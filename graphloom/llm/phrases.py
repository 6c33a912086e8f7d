"""Phrase collocations by bucket hashing and Apriori pruning: frequent word runs and how firmly they hold together.

Pass k over the texts counts the runs of k words exactly, in each task first, and in the same pass counts the runs of k + 1
words in buckets of their hash. Two bitmaps of bounded size go with the next pass: the frequent runs of k words, and the
buckets that reached the least count. A run of k + 1 words is counted only where both of its runs of k words may be frequent
(Apriori) and its bucket may be (hashing); the same test decides what is counted in buckets for the pass after. The bitmaps
let everything frequent pass, so counts of frequent runs are exact, and rare runs, which are nearly all, are never shuffled.

Bucket counts stop at the least count within a batch and travel sorted, a few bytes a bucket; each block of buckets is
added up as its rows stream by. The number of buckets grows with the corpus up to ``MAX_BITS``; in a corpus beyond some
17 billion characters more rare runs are counted exactly instead, with the same results.

Words of a language are told apart by 64-bit hashes of at most ``FLUSH`` words at once, and by their texts everywhere else.

Defined results: null and empty texts hold no words; a null lang is ``und``, one group with the lang of that name. Rows that
repeat a doc_id, or a whole text, all count; doc_id and other columns are ignored. An empty table gives no phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrow_batches import small_batches
from graphloom.llm.bitmaps import MAX_BITS, Passing, bits_for, set_positions, shared
from graphloom.llm.text_arrays import byte_values, chunks, gathered, mix, span_hashes, utf8, word_spans
from graphloom.plans.ranges import ranked
from graphloom.plans.scratch import Scratch, side

UNKNOWN = "und"
#: Between words of a piece, and between pieces.
BLANKS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: Words that a task gathers before it counts them.
FLUSH = 1 << 20
#: Characters of the corpus for a bucket: some three runs share one.
CHARACTERS_A_BUCKET = 32
#: Buckets of a block, which is added up by itself.
BLOCK = 1 << 14

_CHAIN = np.uint64(0xC2B2AE3D27D4EB4F)
_COUNTED = "lang string, phrase string, n long, block int, places binary, counts binary"


def _language_keys(langs: pa.Array) -> tuple[np.ndarray, list[str]]:
    """The number of each row's language among the batch's, and their names."""
    coded = pc.dictionary_encode(pc.fill_null(langs.cast(pa.string()), UNKNOWN))
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def _salts(names: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in names] or [0], np.uint64)


def run_keys(words: np.ndarray, salts: np.ndarray, size: int) -> list[np.ndarray]:
    """Keys of the runs of 1 to ``size`` words that begin at each word, of one language each."""
    keys = [mix(words + salts)]
    for k in range(1, size):
        keys.append(mix(keys[-1][: max(0, len(words) - k)] * _CHAIN + words[k:]))
    return keys


class _Tally:
    """Runs of ``size`` words and buckets of longer ones that a task has seen since it last counted."""

    def __init__(self, size: int, least: int):
        self.size, self.least = size, least
        self.clear()

    def clear(self) -> None:
        self.keys, self.starts, self.ends, self.langs, self.bytes, self.places = [], [], [], [], [], []
        self.names: dict[str, int] = {}
        self.at = self.words = 0

    def number(self, names: list[str]) -> np.ndarray:
        return np.array([self.names.setdefault(n, len(self.names)) for n in names] or [0], np.int64)

    def counts(self) -> Iterator[pa.RecordBatch]:
        if self.keys and sum(map(len, self.keys)):
            keys, first, n = np.unique(np.concatenate(self.keys), return_index=True, return_counts=True)
            data = np.concatenate([*self.bytes, np.frombuffer(b" ", np.uint8)])
            starts, ends, langs = (np.concatenate(x)[first] for x in (self.starts, self.ends, self.langs))
            blank = np.full((len(first), 1), len(data) - 1)
            between = lambda spans, more: np.concatenate([x for i in range(self.size) for x in ([blank + more] if i else []) + [spans[:, i : i + 1]]], axis=1).reshape(-1)
            text, bounds = gathered(data, between(starts, 0), between(ends, 1))
            bounds = bounds[:: 2 * self.size - 1].astype(np.int32)
            names = pa.DictionaryArray.from_arrays(pa.array(langs), pa.array(list(self.names), pa.string())).cast(pa.string())
            phrases = pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(text))
            yield _batch(lang=names, phrase=phrases, n=pa.array(n))
        if self.places and sum(map(len, self.places)):
            yield from _bucket_rows(np.concatenate(self.places), self.least)
        self.clear()


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("block", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema)


def _bucket_rows(places: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """A row a block: the buckets that were met in it, and how often, at most ``least`` times."""
    buckets, n = np.unique(places, return_counts=True)
    blocks, at = np.unique(buckets // BLOCK, return_index=True)
    ends = np.append(at[1:], len(buckets))
    inner = (buckets % BLOCK).astype("<u2").view(np.uint8)
    n = np.minimum(n, least).astype("<u2").view(np.uint8)
    cut = lambda data: pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(2 * at, 2 * ends[-1]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    yield _batch(block=pa.array(blocks.astype(np.int32)), places=cut(inner), counts=cut(n))


def _together(own: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether each word but the last is followed in its own piece."""
    breaks = np.zeros(256, bool)
    breaks[list(BREAKS)] = True
    seen = np.zeros(len(own) + 1, np.int64)
    np.cumsum(breaks[own], out=seen[1:])
    return (rows[1:] == rows[:-1]) & (seen[starts[1:]] == seen[ends[:-1]])


def counter(size: int, least: int, frequent: tuple[Passing, int] | None, full: tuple[Passing, int] | None, next_buckets: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass: exact counts of the runs of ``size`` words that may be frequent, and buckets of the next longer ones.

    ``frequent``: the bitmap of frequent runs one word shorter, and its bits; ``full``: that of the buckets of this size.
    """
    values, part = byte_values(BLANKS + BREAKS)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32

    def passes(keys: np.ndarray, test: tuple[Passing, int]) -> np.ndarray:
        return test[0]((keys & np.uint64(test[1] - 1)).astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(size, least)
        for batch in batches:
            codes, names = _language_keys(batch.column("lang"))
            salts = _salts(names)
            data, bounds = utf8(batch.column("text"))
            for top, end in chunks(bounds):
                own = data[bounds[top] : bounds[end]]
                if not len(own):
                    continue
                starts, ends, first = word_spans(own, bounds[top : end + 1], part)
                rows = np.repeat(np.arange(end - top), np.diff(first))
                langs = codes[top:end][rows]
                keys = run_keys(span_hashes(own, starts, ends, values), salts[langs], size + (next_buckets is not None))
                follows = _together(own, starts, ends, rows)
                whole = np.ones(len(starts), bool)  # the run that begins here is within a piece
                for k in range(1, size):
                    whole = whole[:-1] & follows[k - 1 :] if len(whole) else whole
                if frequent is not None:
                    common = passes(keys[size - 2], frequent)
                    whole &= common[: len(whole)] & common[1 : len(whole) + 1] & passes(keys[size - 1], full)
                at = np.flatnonzero(whole)
                numbers = tally.number(names)
                spans = at[:, None] + np.arange(size)
                tally.keys.append(keys[size - 1][at])
                tally.starts.append(starts[spans] + tally.at)
                tally.ends.append(ends[spans] + tally.at)
                tally.langs.append(numbers[langs[at]])
                tally.bytes.append(lower[own])
                tally.at += len(own)
                tally.words += len(starts)
                if next_buckets is not None and len(whole):
                    longer = whole[:-1] & whole[1:] & follows[size - 1 :]
                    tally.places.append((keys[size][longer] & np.uint64(next_buckets - 1)).astype(np.int64))
                if tally.words >= FLUSH:
                    yield from tally.counts()
        yield from tally.counts()

    return run


def _full_buckets(rows: DataFrame, least: int, buckets: int) -> Passing:
    """The bitmap of the buckets that were met ``least`` times in all, block by block."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK, np.int64)
        for batch in batches:
            for places, n in zip(batch.column("places"), batch.column("counts"), strict=True):
                total[np.frombuffer(places.as_buffer(), "<u2")] += np.frombuffer(n.as_buffer(), "<u2")
        yield pa.RecordBatch.from_pydict({"block": [key[0].as_py()], "map": [np.packbits(total >= least, bitorder="little").tobytes()]}, pa.schema([("block", pa.int32()), ("map", pa.binary())]))

    blocks = rows.where("block IS NOT NULL").select("block", "places", "counts").groupBy("block").applyInArrow(add, "block int, map binary")
    return shared(rows.sparkSession, ((r["block"] * (BLOCK // 8), r["map"]) for r in blocks.toLocalIterator()), buckets)


def _frequent_bitmap(runs: DataFrame, size: int, count: int) -> tuple[Passing, int]:
    """The bitmap of the keys of ``runs(lang, phrase)`` of ``size`` words."""
    bits = bits_for(count)
    values, part = byte_values(BLANKS + BREAKS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, names = _language_keys(batch.column("lang"))
            data, bounds = utf8(batch.column("phrase"))
            own = data[bounds[0] : bounds[-1]]
            if not len(own):
                continue
            starts, ends, first = word_spans(own, bounds, part)
            rows = np.repeat(np.arange(len(codes)), np.diff(first))
            keys = run_keys(span_hashes(own, starts, ends, values), _salts(names)[codes[rows]], size)[-1][first[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array((keys & np.uint64(bits - 1)).astype(np.int64))], names=["p"])

    return set_positions(runs.select("lang", "phrase").mapInArrow(places, "p long"), bits), bits


def frequent_runs(docs: DataFrame, longest: int, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(lang, n)``: words of each language; ``(lang, phrase, size, f)``: the runs of 1 to ``longest`` words met ``least`` times."""
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("text <> ''")
    characters = texts.agg(F.coalesce(F.sum(F.length("text").cast("bigint")), F.lit(0)).alias("n")).first()["n"]
    buckets = min(MAX_BITS, max(1 << 20, 1 << (characters // CHARACTERS_A_BUCKET).bit_length()))
    totals, found, frequent, full = None, [], None, None
    for size in range(1, longest + 1):
        run = counter(size, least, frequent, full, buckets if size < longest else None)
        rows = scratch.table(texts.mapInArrow(run, _COUNTED), f"counts-{size}")
        counted = rows.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if size == 1:
            counted = scratch.table(counted, "words")
            totals = scratch.table(counted.groupBy("lang").agg(F.sum("f").alias("n")), "totals", counted=True)
        kept = scratch.table(counted.where(F.col("f") >= least).select("lang", "phrase", F.lit(size).alias("size"), "f"), f"frequent-{size}", counted=True)
        found.append(kept)
        if size < longest:
            frequent = _frequent_bitmap(kept, size, kept._graphloom_rows)
            full = _full_buckets(rows, least, buckets), buckets
        scratch.drop(rows)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every._graphloom_rows = sum(t._graphloom_rows for t in found)
    return totals, every


def mine(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, inside_percent: int = 50) -> DataFrame:
    """``docs(text, lang)`` -> ``lang, rank, phrase, a, l, r, n, score``: the firmest phrases of 2 to ``longest`` words of each lang.

    ``a``: how often the phrase occurs, at least ``least`` times; ``l``, ``r``: how often its parts do, at its weakest cut;
    ``score``: floor(1000000 * a * a / (l * r)). Phrases inside a longer one that occurs at least ``inside_percent`` of a
    hundred times as often go.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    with small_batches(docs.sparkSession):
        totals, runs = frequent_runs(docs, longest, least, scratch)
    words = F.split("phrase", " ")
    joined = lambda at, n: F.array_join(F.slice(words, at, n), " ")
    long = runs.where("size > 1")
    parts = side(runs.select("lang", "phrase", "f"), rows=runs._graphloom_rows)
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "size", F.col("f").alias("a"), "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = cuts.join(parts.toDF("lang", "left", "l"), ["lang", "left"]).join(parts.toDF("lang", "right", "r"), ["lang", "right"])
    # In decimals of at most 35 digits; the whole quotient goes down, as counts are positive.
    exact = {c: f"cast({c} AS decimal(14, 0))" for c in "alr"}
    scored = cuts.withColumn("score", F.expr("cast(1000000 AS decimal(7, 0)) * {a} * {a} DIV ({l} * {r})".format(**exact)))
    weakest = scored.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Every shorter run within a longer candidate, with the most frequent longer one.
    spans = F.filter(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: joined(i, n)))), lambda s: s != "")
    within = long.where("size > 2").select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = weakest.join(within, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < inside_percent * F.col("a"), F.lit(True)))
    kept = scratch.table(kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")), "scored")
    placed = scratch.table(ranked(kept, [F.col("lang").asc(), F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], scratch), "placed")
    starts = placed.groupBy("lang").agg(F.min("place").alias("start")).join(totals, "lang")
    starts = side(scratch.table(starts, "starts", counted=True))
    out = placed.join(starts, "lang").withColumn("rank", F.col("place") - F.col("start") + 1).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
