"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; of each window of w hashes the least is chosen, the rightmost of equal
ones; each choice is kept once, with its position. So any passage of at least ``k + w - 1`` code points that two texts
share gives them a common fingerprint.

Defined results: null and empty texts have no fingerprint; a text shorter than k has one, the hash of all of it at 0;
one with fewer than w k-grams has one window. Likeness is the Jaccard similarity of the distinct hashes: 1 for two
empty fingerprints, 0 for one. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text_arrays import mix, powers_to

_NONE = np.empty(0, np.uint64)
_LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Winnow:
    k: int = 8
    w: int = 16


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def kgram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit hash (in 64 bits) of every k-gram: differences of prefix sums, brought to one place."""
    n = len(codes)
    if not n:
        return _NONE
    k = min(k, n)
    up, down = powers_to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(0x1F123BB5)) * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1]) >> np.uint64(32)


def fingerprint(codes: np.ndarray, how: Winnow) -> np.ndarray:
    """Chosen ``hash << 32 | position``, positions ascending."""
    hashes = kgram_hashes(codes, how.k)
    n = len(hashes)
    if not n:
        return hashes
    place = np.arange(n, dtype=np.uint64)
    least = (hashes << np.uint64(32)) | (_LOW - place)  # of equal hashes the rightmost is least
    w, span = min(how.w, n), 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: span - w], least[w - span :])
    chosen = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return chosen ^ _LOW  # low half: LOW - (LOW - place) = place


def as_text(chosen: np.ndarray) -> str:
    """16 hex digits for each: hash, then position."""
    return chosen.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a >> np.uint64(32)), np.unique(b >> np.uint64(32))
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, how: Winnow = Winnow()) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, hash, position``, a row a fingerprint; the general form, for joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                all_ = [fingerprint(code_points(t), how) for t in part.column("text").to_pylist()]
                flat = np.concatenate(all_) if all_ else _NONE
                rows = pa.array(np.repeat(np.arange(len(all_)), [len(x) for x in all_]))
                hashes, places = (flat >> np.uint64(32)).astype(np.int64), (flat & _LOW).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(rows), pa.array(hashes), pa.array(places)], names=["doc_id", "hash", "position"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, hash long, position long")


_EDITS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _edit_row(doc_id, text: str, own: np.ndarray, codes: np.ndarray, next_text: str, next_own: np.ndarray, how: Winnow) -> tuple:
    cut = len(codes) // 4
    edited = text[: len(text) - cut] + next_text[:cut]
    chosen = fingerprint(code_points(edited), how)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(codes), digest, as_text(own), as_text(chosen), likeness(own, chosen), likeness(own, next_own)


#: Bytes of input, as stored, for a range.
RANGE_BYTES = 128 << 20


def ranges_for(docs: DataFrame) -> int:
    """Ranges of about ``RANGE_BYTES``, and at least as many as shuffles have; the planner knows the size of a table, else it is summed up."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known >= 1 << 60:  # the planner's word for unknown
        known = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(least, -(-known // RANGE_BYTES))


def compare_edited(docs: DataFrame, how: Winnow = Winnow()) -> DataFrame:
    """Fingerprints of every text, of its edit (last quarter from the next document's start) and their likeness.

    The next document is the next row by doc_id, then text; after the last comes the first. One shuffle carries every
    text once: rows go to ranges of doc_id, and the first document of each range also goes, as a guest, to the range
    before it. The number of ranges follows the size of the input, and range i is partition i. A task streams through its
    sorted range and holds two texts. Null doc_ids sort first.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    parts = ranges_for(docs)
    quantiles = F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], max(10_000, min(10 * parts, 200_000)))
    found = docs.agg(F.min(key).alias("least"), quantiles.alias("q")).first()
    bounds = np.array(sorted({found["least"], *found["q"]} if found["least"] is not None else {0}), np.int64)
    count = len(bounds)

    @F.pandas_udf("array<int>")
    def ranges(ids):
        import pandas as pd

        at = np.searchsorted(bounds, ids.to_numpy(), "right") - 1
        opens = bounds[at] == ids.to_numpy()
        return pd.Series([[a, (a - 1) % count] if first else [a] for a, first in zip(at.tolist(), opens.tolist(), strict=True)])

    placed = docs.withColumn("key", key).withColumn("to", ranges("key")).select("doc_id", "text", "key", F.posexplode("to").alias("guest", "range"))
    dealt = placed.repartitionById(count, F.col("range")).sortWithinPartitions("range", "guest", "key", "text").select("doc_id", "text", "range", "guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, out, size = None, None, [], 0
        for batch in batches:
            for doc_id, text, part, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "guest")), strict=True):
                if part != now:
                    held, now = None, part
                if guest and held is None:
                    continue
                codes = code_points(text)
                own = fingerprint(codes, how)
                if held is not None:
                    out.append(_edit_row(*held, text, own, how))
                    size += len(held[1])
                held = None if guest else (doc_id, text, own, codes)
                if size > 4_000_000:
                    yield _edit_batch(out)
                    out, size = [], 0
        yield _edit_batch(out)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _edit_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in _EDITS]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _EDITS, strict=True)], schema=_EDITS)
