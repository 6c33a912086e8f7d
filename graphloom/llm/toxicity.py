"""Toxicity by a factorization machine over hashed terms.

Terms of a text: its distinct words (letters, digits and all non-ASCII bytes; A-Z in lower case) and their prefixes of
``PREFIXES`` bytes, hashed into ``BUCKETS``. Score: the logistic of w0 + sum w_i + sum over i < j of <v_i, v_j>, so that
two terms together, such as an insult and a group's name, can weigh more than each alone.

It learns from a bounded sample of labelled documents (about ``train_rows``, by hash of the id). Spark extracts and
counts the sample's terms; the driver gets the counts of the buckets and, of each row, the few terms that may take part. Terms
take part if their share among positives differs from that among negatives with a chi-square of at least ``min_chi2``; in
long texts other terms would add up to noise. So do the terms of every pair in ``pair_rows`` rows or more, but for terms of
most rows, whose rate of positives the two rates by themselves would make with a chance under exp(-``min_pair_nats``): terms
that tell nothing alone, but much together. Spark counts the pairs, on at most about ``pair_entries`` terms of the sample.
The broadcast model has a fixed size.

Defined results: null and empty texts have no terms and score the logistic of w0. Without labels, or with labels of one
class only, every text scores that class's smoothed share. Several labels of a document: the greatest. Null labels and null
doc_ids do not train; a null doc_id is held out. Repeated rows are all scored and train once. Scores at a limit count as
reaching it. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrow_batches import small_batches
from graphloom.llm.bitmaps import FEW, parted
from graphloom.llm.text_arrays import NON_WORD, byte_values, chunks, mix, powers_to, utf8
from graphloom.plans.scratch import Scratch, side

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class Training:
    train_rows: int = 20_000
    min_chi2: float = 12.0
    min_pair_nats: float = 30.0
    pair_rows: int = 20
    pair_entries: int = 8_000_000
    factors: int = 4
    epochs: int = 12
    least_steps: int = 1500
    rate: float = 0.5
    decay: float = 1e-4
    seed: int = 11


def term_buckets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, end, terms, bounds)``: row ``first + i`` has the distinct ``terms[bounds[i]:bounds[i + 1]]``."""
    values, part = byte_values(NON_WORD)
    data, rows = utf8(column)
    for first, end in chunks(rows):
        at = rows[first : end + 1] - rows[first]
        own = data[rows[first] : rows[end]]
        n = end - first
        if not len(own):
            yield first, end, np.empty(0, np.int64), np.zeros(n + 1, np.int64)
            continue
        up, down = powers_to(len(own))
        inside = part[own]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        heads, tails = at[:-1][at[:-1] < len(own)], at[1:][at[1:] > 0] - 1
        opens[heads], closes[tails] = inside[heads], inside[tails]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(values[own] * up[: len(own)], out=sums[1:])
        of = np.searchsorted(at, starts, "right").astype(np.uint64) - np.uint64(1)
        keys = []
        for kind, size in enumerate((None, *PREFIXES)):
            use = slice(None) if size is None else ends - starts > size
            s, e = starts[use], ends[use] if size is None else starts[use] + size
            hashed = mix((sums[e] - sums[s]) * down[s] + np.uint64(kind))
            keys.append((of[use] << np.uint64(18)) | (hashed >> np.uint64(46)))
        distinct = np.unique(np.concatenate(keys))
        yield first, end, (distinct & np.uint64(BUCKETS - 1)).astype(np.int64), np.searchsorted(distinct, np.arange(n + 1, dtype=np.uint64) << np.uint64(18))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, terms, bounds in term_buckets(batch.column("text")):
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(terms.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, end - first) for c in ("label", "key")), lists], names=["label", "key", "terms"])


@dataclass
class Machine:
    """``base`` is w0; ``linear`` (buckets) and ``factors`` (buckets x factors) are zero for terms that take no part."""

    base: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, terms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = len(bounds) - 1
        active = self.linear[terms] != 0
        counts = np.concatenate([[0], np.cumsum(active)])[bounds]
        terms = terms[active]
        of = np.repeat(np.arange(n), np.diff(counts))
        total = self.base + np.bincount(of, self.linear[terms], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[terms, f]
            total += 0.5 * (np.bincount(of, v, n) ** 2 - np.bincount(of, v * v, n))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def informative(seen: np.ndarray, hit: np.ndarray, n: int, positive: int, how: Training) -> np.ndarray:
    """Which buckets take part, from the rows and the positive rows that have them."""
    rate = positive / max(n, 1)
    expected = seen * rate
    chi2 = np.where(seen > 0, (hit - expected) ** 2 / np.maximum(expected * (1 - rate) * (1 - seen / max(n, 1)), 1e-9), 0.0)
    return (chi2 >= how.min_chi2) & (seen >= 3) & (seen < n)


def telling(both: np.ndarray, hits: np.ndarray, rate: np.ndarray, how: Training) -> np.ndarray:
    """Whether ``hits`` of ``both`` rows are too far from ``rate``: by Chernoff's bound the chance is under exp(-``min_pair_nats``)."""
    share, rate = hits / np.maximum(both, 1), np.clip(rate, 1e-9, 1 - 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        more = np.where(share > 0, share * np.log(share / rate), 0.0)
        less = np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - rate)), 0.0)
    return (both >= how.pair_rows) & (both * (more + less) >= how.min_pair_nats)


def _partners(shared, how: Training) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the terms asked for, those with a partner that makes a telling pair. A task holds one term's counts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, base, odds, positive, terms, bounds, rows, starts = shared.value
        lists = np.split(terms.astype(np.int64), bounds[1:-1])
        for batch in batches:
            found = []
            for a in asked[batch.column("id").to_numpy()]:
                # Rows are in the order of their labels, positive ones first.
                own = rows[starts[a] : starts[a + 1]]
                cut = int(np.searchsorted(own, positive))
                counts = []
                for part in (own[:cut], own[cut:]):
                    count = np.zeros(len(odds), np.int64)
                    for i in range(0, len(part), 1024):
                        count += np.bincount(np.concatenate([lists[r] for r in part[i : i + 1024]]), minlength=len(odds))
                    counts.append(count)
                near = np.flatnonzero(counts[0] + counts[1] >= how.pair_rows)
                near = near[near != a]
                rate = 1 / (1 + np.exp(-np.clip(odds[a] + odds[near] - base, -30, 30)))
                if telling(counts[0][near] + counts[1][near], counts[0][near], rate, how).any():
                    found.append(a)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], names=["at"])

    return run


def _counted(terms: np.ndarray, portion: int = 1 << 20) -> np.ndarray:
    """Occurrences of each bucket, by portions, as each is widened to eight bytes a term."""
    return sum((np.bincount(terms[i : i + portion], minlength=BUCKETS) for i in range(0, len(terms), portion)), np.zeros(BUCKETS, np.int64))


def pair_terms(rows: DataFrame, seen: np.ndarray, used: np.ndarray, n: int, how: Training) -> np.ndarray:
    """Buckets not ``used`` yet that are in a pair whose rate of positives their own rates do not explain.

    Every pair that stands in ``pair_rows`` rows is counted, however rare its terms. ``rows(label, key, terms)`` are thinned
    out by hash to about ``pair_entries`` terms, so the broadcast has a fixed bound; each task counts the partners of its terms.
    """
    spark = rows.sparkSession
    able = (seen >= how.pair_rows) & (seen <= 0.6 * n)
    share = min(1.0, how.pair_entries / max(1.0, seen[able].sum()))
    labels, terms, bounds = gathered(rows.where(F.pmod("key", F.lit(1 << 30)) < int(share * (1 << 30))), able)
    if not len(terms):
        return terms
    # The driver holds a few arrays of four bytes a term, and each only as long as it is read; positive rows come first.
    order = np.argsort(-labels, kind="stable")
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(terms)).take(pa.array(order))
    labels, lengths, terms = labels[order], np.diff(bounds)[order], lists.flatten().to_numpy()
    del lists
    bounds, positive = np.concatenate([[0], np.cumsum(lengths)]), int(labels.sum())
    counts, hits = (_counted(part) for part in (terms, terms[: bounds[positive]]))
    names = np.flatnonzero(counts)
    counts, hits, place = counts[names], hits[names], np.zeros(BUCKETS, np.int32)
    place[names] = np.arange(len(names), dtype=np.int32)
    terms = place[terms]
    rows_of = np.repeat(np.arange(len(labels), dtype=np.int32), lengths)[np.argsort(terms, kind="stable")]
    odds = lambda r: np.log(r / (1 - r))
    asked = np.flatnonzero(~used[names])
    starts = np.concatenate([[0], np.cumsum(counts)])
    shared = spark.sparkContext.broadcast((asked, odds((positive + 0.5) / (len(labels) + 1)), odds((hits + 0.5) / (counts + 1)), positive, terms, bounds, rows_of, starts))
    del terms, rows_of
    found = spark.range(0, len(asked), 1, max(1, len(asked) // 256)).mapInArrow(_partners(shared, how), "at int").toArrow().column("at").to_numpy()
    # The driver's own copy goes too, which ``unpersist`` would leave.
    shared.destroy()
    pa.default_memory_pool().release_unused()
    return names[found]


def gathered(rows: DataFrame, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, terms and bounds of the sample's rows, with the ``used`` terms alone."""

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            terms, lengths = lists.flatten().to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False)
            keep = used[terms]
            ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.ListArray.from_arrays(pa.array(ends), pa.array(terms[keep]))], names=["label", "terms"])

    table = rows.select("label", "terms").mapInArrow(narrow, "label int, terms array<int>").toArrow()
    lists = pa.concat_arrays(table.column("terms").chunks) if table.num_rows else pa.array([], pa.list_(pa.int32()))
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return table.column("label").to_numpy().astype(float), lists.flatten().to_numpy(), bounds


def fit(labels: np.ndarray, terms: np.ndarray, bounds: np.ndarray, how: Training = Training()) -> Machine:
    """AdaGrad on the log-loss over the given terms, mini-batches in a seeded order."""
    n = len(labels)
    positive = int(labels.sum())
    share = (positive + 0.5) / (n + 1)
    flat = Machine(float(np.log(share / (1 - share))), np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, how.factors), np.float32))
    if not positive or positive == n:
        return flat
    if not len(terms):
        return flat
    used, local = np.unique(terms, return_inverse=True)
    rng = np.random.default_rng(how.seed)
    w, v, w0 = np.zeros(len(used)), rng.normal(0, 0.02, (len(used), how.factors)), flat.base
    gw, gv, g0 = np.full(len(used), 1e-2), np.full(v.shape, 1e-2), 1e-2
    for _ in range(max(how.epochs, how.least_steps * 256 // n)):
        order = rng.permutation(n)
        for i in range(0, n, 256):
            rows = order[i : i + 256]
            lengths = bounds[rows + 1] - bounds[rows]
            at = np.repeat(bounds[rows] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            t, r = local[at], np.repeat(np.arange(len(rows)), lengths)
            vt = v[t]
            sums = np.stack([np.bincount(r, vt[:, f], len(rows)) for f in range(how.factors)], axis=1)
            squares = np.bincount(r, (vt * vt).sum(axis=1), len(rows))
            z = w0 + np.bincount(r, w[t], len(rows)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[rows]
            touched, inverse = np.unique(t, return_inverse=True)
            dw = np.bincount(inverse, error[r], len(touched)) / len(rows) + how.decay * w[touched]
            gw[touched] += dw**2
            w[touched] -= how.rate * dw / np.sqrt(gw[touched])
            inner = error[r][:, None] * (sums[r] - vt)
            dv = np.stack([np.bincount(inverse, inner[:, f], len(touched)) for f in range(how.factors)], axis=1) / len(rows) + how.decay * v[touched]
            gv[touched] += dv**2
            v[touched] -= 0.3 * how.rate * dv / np.sqrt(gv[touched])
            d0 = error.mean()
            g0 += d0**2
            w0 -= how.rate * d0 / np.sqrt(g0)
    flat.base = float(w0)
    flat.linear[used] = np.where(w == 0, 1e-12, w)
    flat.factors[used] = v
    return flat


def train(docs: DataFrame, labels: DataFrame, training: Column, how: Training = Training()) -> Machine:
    """``docs(doc_id, text)``, ``labels(doc_id, label)``; only rows where ``training`` (of doc_id) is true are read."""
    known = labels.where("label IS NOT NULL").where(training).groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    total = known.count()
    if total > how.train_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(how.train_rows / total * (1 << 30)))
    # At most about train_rows pairs of numbers: a proven bound for the broadcast.
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("label", F.xxhash64("doc_id", "text").alias("key"), "text")
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.table(sample.mapInArrow(_terms, "label int, key long, terms array<int>"), "terms", counted=True)
    # One id may stand on any number of rows: equal ones train once, and what is still too much is thinned out by hash.
    distinct = rows.agg(F.count_distinct("key")).first()[0]
    if distinct < rows._graphloom_rows:
        share = min(1.0, 1.2 * how.train_rows / max(1, distinct))
        rows = scratch.table(rows.where(F.pmod("key", F.lit(1 << 30)) <= int(share * (1 << 30))).dropDuplicates(["key"]), "distinct")
    # Spark counts the terms; the driver sees a row a bucket, then the rows' terms that may take part.
    counts = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("seen"), F.sum("label").alias("hit")).toArrow()
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    seen, hit, at = np.zeros(BUCKETS), np.zeros(BUCKETS), counts.column("term").to_numpy()
    seen[at], hit[at] = counts.column("seen").to_numpy(), counts.column("hit").to_numpy()
    used = informative(seen, hit, n, positive, how)
    if 0 < positive < n:
        used[pair_terms(rows, seen, used, n, how)] = True
    machine = fit(*gathered(rows, used), how)
    scratch.close()
    return machine


def _scorer(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(*shared.value)
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for first, end, terms, bounds in term_buckets(batch.column("text")):
                scores[first:end] = machine.scores(terms, bounds)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(scores)], names=[*(c for c in batch.schema.names if c != "text"), "score"])

    return run


def predict(docs: DataFrame, labels: DataFrame, training: Column, how: Training = Training()) -> DataFrame:
    """-> ``doc_id, held_out, score, predicted``; ``training`` is a condition on doc_id."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    machine = train(docs, labels, training, how)
    shared = docs.sparkSession.sparkContext.broadcast((machine.base, machine.linear, machine.factors))
    rows = docs.select("doc_id", (~F.coalesce(training, F.lit(False))).alias("held_out"), "text")
    scored = rows.mapInArrow(_scorer(shared), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, training: Column, how: Training = Training(), limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score under ``limit``.

    The scores are taken once; what they reject is a narrow table, and only texts that its bitmap takes for rejected ones
    are shuffled.
    """
    own = [F.col("doc_id").cast("bigint"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))]
    plain = docs.select(own[0].alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        machine = train(plain, labels, training, how)
        shared = docs.sparkSession.sparkContext.broadcast((machine.base, machine.linear, machine.factors))
        scored = plain.select("doc_id", own[1].alias("text_key"), "text").mapInArrow(_scorer(shared), "doc_id long, text_key long, score double")
        rejected = Scratch(docs.sparkSession, "toxicity").table(scored.where(F.col("score") >= limit).select("doc_id", "text_key").distinct(), "rejected", counted=True)
    name = "_" * (1 + max(map(len, docs.columns)))
    said = rejected.select(F.struct("doc_id", "text_key").alias(name))
    same = own[0].eqNullSafe(F.col(f"{name}.doc_id")) & (own[1] == F.col(f"{name}.text_key"))
    hits, clear = parted(docs, own, rejected, rejected._graphloom_rows, "doc_id", "text_key")
    return clear.unionByName(hits.join(side(said, most=FEW, rows=rejected._graphloom_rows, fixed=True), same, "left_anti"))
