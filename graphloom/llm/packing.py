"""Packing token sequences by best-fit decreasing.

A document is its token ids and an end id. Overlong documents are first cut into full windows; the rest of each is one
piece. Pieces are packed, longest first, into the open window of the least remaining capacity that still fits, found
by a segment tree over remaining capacities.

Tokens are made once, in one pass without a shuffle, and only numbers go on: doc_id, start, length, checksum. These go
by hash of their row's number to groups of about ``GROUP`` pieces, and each group is packed by itself; a group leaves a
window or two less full, a small part of its thousand. Neither a hot source nor repeated rows have a part in the grouping.

Chunks between blanks are tokenised once for each worker and kept as bytes in a table of at most ``CACHED_BYTES``; chunks
over ``CACHED_CHARS`` are never kept. Very long texts go in parts. No rule of the
tokenizer reaches over a blank or a line feed. Plain words with marks after them go straight to the tokenizer's model
if a probe shows that it takes them so. The tests compare both with whole texts.

Defined results: a null or empty text is the end id alone. Repeated rows are packed each. Ties of length go by doc_id,
start, then checksum. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrow_batches import small_batches
from graphloom.plans.scratch import Scratch

GROUP = 2048
#: Bound of a worker's table; what an entry costs beside its characters and ids; longest chunk that is kept.
CACHED_BYTES, ENTRY_BYTES, CACHED_CHARS = 256 << 20, 200, 64
#: Characters of the texts that are taken apart at once.
PART_CHARS = 1 << 20
_MARK = "\x01"
#: Small Latin-1 letters, then ASCII marks but for the apostrophe and what may begin a special token.
_WORD_MARKS = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=-@\\[-`{-~]*)")
_PROBES = ("word", "stra\u00dfe", "\u00e9l\u00e8ve", "ni\u00f1o", "qzxkvw")


def _byte_letters() -> dict[int, int]:
    """Bytes without a visible Latin-1 character are numbered from 256 on, as byte-level vocabularies write them."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


class ChunkEncoder:
    """Token ids of texts as little-endian 32-bit bytes, by a Hugging Face tokenizer file."""

    def __init__(self, path: str, cached: int = CACHED_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cached = cached
        self.known: dict[str, bytes] = {"": b""}
        self.size = 0
        self.mark = self._plain(_MARK)
        # Only a tokenizer that takes such words as they are, in any case of their letters, is asked word by word.
        self.direct = all(self._plain(shown + ",") == self._word(w) + self._plain(",") for w in _PROBES for shown in {w, w.capitalize(), w.upper()} if shown.lower() == w)

    def _plain(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _word(self, word: str) -> bytes:
        """Ids of a word of small letters, straight from the model; the other steps would leave it as it is."""
        if (own := self.known.get(word)) is None:
            tokens = self.tokenizer.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS))
            own = b"".join([t.id.to_bytes(4, "little") for t in tokens])
            if len(word) <= CACHED_CHARS:
                self._keep(word, own)
        return own

    def _keep(self, chunk: str, ids: bytes) -> None:
        self.size += ENTRY_BYTES + 2 * len(chunk) + len(ids)
        self.known[chunk] = ids

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Words with marks after them by the model, in two parts; all else in joined runs that a mark tells apart.

        Short chunks are kept; returns the ids of the long ones, for this once.
        """
        other, once = [], {}
        for chunk in chunks:
            if self.direct and (parts := _WORD_MARKS.fullmatch(chunk.lower())):
                word, marks = parts.groups()
                if marks not in self.known and len(marks) <= CACHED_CHARS:
                    self._keep(marks, self._plain(marks))
                ids = self._word(word) + (self.known[marks] if marks in self.known else self._plain(marks))
                if len(chunk) <= CACHED_CHARS:
                    self._keep(chunk, ids)
                else:
                    once[chunk] = ids
            elif len(chunk) > CACHED_CHARS:
                once[chunk] = self._plain(chunk)
            else:
                other.append(chunk)
        self._learn_joined(other)
        return once

    def _learn_joined(self, chunks: list[str]) -> None:
        mark = int.from_bytes(self.mark, "little")
        alone = (lambda c: True) if len(self.mark) != 4 else (lambda c: _MARK in c)
        for chunk in filter(alone, chunks):
            self._keep(chunk, self._plain(chunk))
        plain = [c for c in chunks if not alone(c)]
        for i in range(0, len(plain), 4096):
            run = plain[i : i + 4096]
            ids = self.tokenizer.encode_batch_fast([f" {_MARK} ".join(run)], add_special_tokens=False)[0].ids
            at, got = 0, []
            for end in [j for j, x in enumerate(ids) if x == mark] + [len(ids)]:
                got.append(ids[at:end])
                at = end + 1
            if len(got) != len(run):
                for chunk in run:
                    self._keep(chunk, self._plain(chunk))
                continue
            for chunk, own in zip(run, got, strict=True):
                self._keep(chunk, b"".join([x.to_bytes(4, "little") for x in own]))

    def _parts(self, parts: list[str]) -> Iterator[bytes]:
        """The ids of each part; the table of chunks is emptied when it is full."""
        if self.size > self.cached:
            self.known, self.size = {"": b""}, 0
        split = [t.replace("\n", " ").split(" ") for t in parts]
        known = self.known
        new = set().union(*split).difference(known)
        once = self._learn(list(new)) if new else {}
        find = (lambda c: known[c] if c in known else once[c]) if once else known.__getitem__
        for chunks in split:
            yield b"".join(map(find, chunks))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text."""
        run: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if run and size + len(text) > PART_CHARS:
                yield from self._parts(run)
                run, size = [], 0
            if len(text) <= PART_CHARS:
                run.append(text)
                size += len(text)
                if len(run) == 64:
                    yield from self._parts(run)
                    run, size = [], 0
                continue
            pieces, at = [], 0
            while at < len(text):
                # A part ends at the last blank of its reach, or else at the first after it.
                end = len(text) if len(text) - at <= PART_CHARS else max(text.rfind(" ", at, at + PART_CHARS), text.rfind("\n", at, at + PART_CHARS))
                if end < at:
                    after = [x for x in (text.find(" ", at), text.find("\n", at)) if x >= 0]
                    end = min(after, default=len(text))
                pieces += self._parts([text[at:end]])
                at = end + 1
            yield b"".join(pieces)
        if run:
            yield from self._parts(run)


class CapacityTree:
    """Counts of open windows by remaining capacity; finds the least capacity that holds a piece."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.counts = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = {}

    def add(self, capacity: int, number: int) -> None:
        if capacity:
            self.open.setdefault(capacity, []).append(number)
            self._bump(capacity, 1)

    def _bump(self, capacity: int, by: int) -> None:
        at = capacity + self.size
        while at:
            self.counts[at] += by
            at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """``(capacity, number)`` of the tightest window for ``length``, no longer open; None if none fits."""
        counts, at = self.counts, length + self.size
        if not counts[at]:
            while at > 1 and (at & 1 or not counts[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if counts[2 * at] else 2 * at + 1
        capacity = at - self.size
        self._bump(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """``(window number, offset)`` of each piece; lengths must come longest first."""
    tree, used, out = CapacityTree(window), 0, []
    for length in lengths:
        if length == window or (found := tree.take(length)) is None:
            found = (window, used)
            used += 1
        capacity, number = found
        out.append((number, window - capacity))
        tree.add(capacity - length, number)
    return out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cutter(path: str, end_id: int, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = ChunkEncoder(path), end_id.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pieces(docs: DataFrame, path: str, end_id: int = 1, window: int = 2048) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, start, length, ids_crc32, doc_tokens``: full windows and rests."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(cutter(path, end_id, window), _PIECES)


def pack(cut: DataFrame, window: int = 2048, group: int = GROUP) -> DataFrame:
    """``pieces`` with ``sequence_id, offset``. A sequence id is its group's number times 2^32 and the window's there."""
    # The number of a row stands in the written table, so repeated rows part and a lost task deals as before.
    with small_batches(cut.sparkSession):
        cut = Scratch(cut.sparkSession, "pack").table(cut.withColumn("nr", F.monotonically_increasing_id()), "pieces", counted=True)
    groups = max(1, -(-cut._graphloom_rows // group))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        placed = best_fit_decreasing(order.column("length").to_pylist(), window)
        base = key[0].as_py() << 32
        out = order.drop_columns(["part"])
        out = out.append_column("sequence_id", pa.array([base + n for n, _ in placed], pa.int64()))
        return out.append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    keyed = cut.withColumn("part", F.pmod(F.xxhash64("nr"), F.lit(groups).cast("bigint"))).drop("nr")
    return keyed.groupBy("part").applyInArrow(run, f"{_PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, window: int = 2048) -> DataFrame:
    return pack(pieces(docs, path, end_id, window), window)
