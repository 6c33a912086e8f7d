"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are taken in lower case, all other characters as blanks. The n-grams of ``ORDERS`` fall into ``BUCKETS``
hashed buckets. Counts of a bounded sample of labelled documents (about ``train_rows``, by hash of the id) are summed
in Spark; what is broadcast is one float32 row of log-probabilities a bucket, of a size that does not depend on the
corpus. Scoring gathers the rows of a chunk's n-grams and sums them by document in numpy.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any training row so is every
text. The ``MAX_LANGUAGES`` languages of most labelled rows are learned, of equal ones the first by name; rarer ones are never
predicted, so a lang column of any content is fine. Ties go to the first language in order. Rows with a null lang do not train. Repeated rows count as often as they
occur. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = (2, 3)
BUCKETS = 1 << 16
#: Languages that are learned at most: the broadcast table has 256 KB for each.
MAX_LANGUAGES = 256
CHUNK_CHARS = 500_000
UNKNOWN = "und"

_folding: list[np.ndarray] = []


def folding() -> np.ndarray:
    """For every code point its lower-case letter, or 32 for what is no letter."""
    if not _folding:
        table = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _folding.append(table)
    return _folding[0]


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(buckets, starts, letters)``: a row of buckets a character; document i begins at ``starts[i]``.

    A blank follows every document, so that no n-gram reaches into the next: those that would are in the extra
    bucket ``BUCKETS``, which weighs nothing. ``letters``: letters in each document.
    """
    joined = "\n".join([*texts, "\n\n"])
    codes = folding()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(sizes)
    starts, total = ends - sizes, int(ends[-1]) if len(texts) else 0
    rows = np.empty((total, len(ORDERS)), np.uint32)
    for j, order in enumerate(ORDERS):
        h = np.full(total, order, np.uint64)
        for i in range(order):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + total]
        rows[:, j] = (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)
        for back in range(1, order):
            rows[np.maximum(ends - back, starts), j] = BUCKETS
    letters = np.add.reduceat((codes[:total] != 32).astype(np.int64), starts) if total else np.zeros(0, np.int64)
    return rows, starts, letters


def text_chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``limit`` characters together, with the index of their first."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        if run and size + len(text or "") > limit:
            yield first, run
            first, run, size = i, [], 0
        run.append(text or "")
        size += len(text or "")
    if run:
        yield first, run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum n-grams and documents by language within a task; the sums have a fixed size a language."""
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for first, texts in text_chunks(batch.column("text").to_pylist()):
            rows, starts, _ = ngram_buckets(texts)
            own = langs[first : first + len(texts)]
            names = sorted(set(own))
            of = np.repeat(np.array([names.index(x) for x in own]), np.diff(np.append(starts, len(rows))))
            flat = (rows.astype(np.int64) + of[:, None] * (BUCKETS + 1)).reshape(-1)
            counts = np.bincount(flat, minlength=len(names) * (BUCKETS + 1)).reshape(len(names), BUCKETS + 1)
            for name, row in zip(names, counts, strict=True):
                sums[name] = sums.get(name, 0) + row
                docs[name] = docs.get(name, 0) + own.count(name)
    for name, row in sums.items():
        row[BUCKETS] = docs[name]  # the extra bucket's place holds the number of documents
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(row[at])], names=["lang", "bucket", "n"])


def _common(labelled: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The rows of the ``most`` languages of most rows (of equal ones the first by name), and their number."""
    by_lang = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most + 1).collect()
    total = sum(r["n"] for r in by_lang[:most])
    if len(by_lang) <= most:
        return labelled, total
    learned = labelled.sparkSession.createDataFrame([(r["lang"],) for r in by_lang[:most]], "lang string")
    return labelled.join(F.broadcast(learned), "lang", "left_semi"), total


def train(docs: DataFrame, train_rows: int = 50_000, smoothing: float = 0.5, max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``docs(doc_id, text, lang)`` -> languages, log-probabilities (bucket x language), log-priors."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    labelled, total = _common(labelled, max_languages)
    if total > train_rows:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(train_rows / total * (1 << 30)))
    counts = labelled.select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    table = np.zeros((BUCKETS + 1, len(langs)))
    places = {x: i for i, x in enumerate(langs)}
    table[counts.column("bucket").to_numpy(), [places[x] for x in counts.column("lang").to_pylist()]] = counts.column("n").to_numpy()
    prior = np.log(table[BUCKETS] / max(1, table[BUCKETS].sum())) if langs else np.zeros(0)
    table[BUCKETS] = 0
    logs = np.log((table + smoothing) / (table.sum(axis=0) + smoothing * BUCKETS))
    logs[BUCKETS] = 0
    return langs, logs.astype(np.float32), prior


def _scorer(langs: list[str], shared, prior: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in batches:
            names, scores = [], []
            for _, texts in text_chunks(batch.column("text").to_pylist()):
                rows, starts, letters = ngram_buckets(texts)
                if not langs:
                    names += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                sums = sum(np.add.reduceat(logs[rows[:, j]], starts, axis=0, dtype=np.float64) for j in range(len(ORDERS))) + prior
                best = sums.argmax(axis=1)
                chance = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                names += [langs[b] if some else UNKNOWN for b, some in zip(best, letters, strict=True)]
                scores += np.where(letters > 0, chance, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*(c for c in batch.schema.names if c != "text"), "lang_pred", "score"])

    return run


def predict(docs: DataFrame, training: Column, train_rows: int = 50_000, smoothing: float = 0.5) -> DataFrame:
    """``docs(doc_id, text, lang)`` -> ``doc_id, held_out, lang_pred, score``; rows where ``training`` is true train."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.coalesce(training, F.lit(False)).alias("trains"))
    langs, logs, prior = train(docs.where("trains"), train_rows, smoothing)
    rows = docs.select("doc_id", (~F.col("trains")).alias("held_out"), "text")
    return rows.mapInArrow(_scorer(langs, spark.sparkContext.broadcast(logs), prior), "doc_id long, held_out boolean, lang_pred string, score double")
