"""Interleaved document sequences with media columns.

HTML is parsed into an ordered sequence of text and media-reference structs: position, kind, text, reference, caption.
Captions stand with their media: a figure's caption, else the alternative text; a caption that no
media takes is text. An open caption ends with its figure or the page. References of the form
``sha256:<hex>`` are resolved by a digest join against a media store; the sequence keeps its order and positions.

The store keeps payloads losslessly as 8-bit grey samples (binary PGM, 64 samples a row), in Parquet binary columns
that are written to the shared folder and read back before anything is computed from them. Payloads are padded with
bytes 0 to a positive multiple of 64; the unpadded length stands in the image's comment line.

Defined results: null HTML is an empty sequence; null payloads are empty. Media references that the store lacks stay, with null
payload columns. Equal media are one store entry however often they are stored or referenced. Text in scripts,
styles and templates is no text; one that is left open ends with its parent. A reference is the element's source, else the
first of its sizes. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import zlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import Scratch

ROW = 64
_SOURCES = {"img": ("src", "data-src", "srcset", "data-srcset"), "video": ("src", "data-src"), "audio": ("src", "data-src"), "source": ("src", "data-src", "srcset", "data-srcset"), "embed": ("src",), "object": ("data",)}
_BLOCKS = {"p", "div", "li", "ul", "ol", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "nav", "header", "footer", "br", "figure", "figcaption", "title", "blockquote", "pre", "body", "main"}
_SILENT = {"script", "style", "template", "noscript"}
_EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


def reference_of(tag: str, attrs: dict[str, str | None]) -> str | None:
    """The first reference among the element's attributes; of a list of sizes the first."""
    for name in _SOURCES[tag]:
        value = (attrs.get(name) or "").strip()
        if value and name.endswith("srcset"):
            value = value.split()[0].rstrip(",")
        if value:
            return value
    return None


class SequenceParser(HTMLParser):
    """Collects ``[kind, text, reference, caption]`` in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self._text: list[str] = []
        self._open: list[str] = []  # elements that are open
        self._counts: Counter[str] = Counter()
        self._silent: list[int] = []  # depths of the silent ones among them
        self._figures: list[int] = []  # index of the first item of each open figure
        self._captions: list[list[tuple[int, str]]] = []  # place and text of the captions of each
        self._place = 0
        self._settled: set[int] = set()  # media of closed figures that have their caption
        self._caption: list[str] | None = None
        self._waiting = ""

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text = []
        if text:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SILENT:
            self._silent.append(len(self._open))
        if tag not in _EMPTY:
            self._open.append(tag)
            self._counts[tag] += 1
        if self._silent:
            return
        if tag in _BLOCKS and self._caption is None:
            self._flush()
        if tag == "figure":
            self._end_caption()
            self._figures.append(len(self.items))
            self._captions.append([])
        elif tag == "figcaption":
            self._end_caption()
            self._caption, self._place = [], len(self.items)
        elif tag in _SOURCES:
            named = dict(attrs)
            if reference := reference_of(tag, named):
                self._flush()
                self.items.append(["media", None, reference, named.get("alt") or None])

    def handle_endtag(self, tag: str) -> None:
        hidden = bool(self._silent)
        if self._counts[tag]:
            # Ends what was left open inside, silent elements too: an open template ends with its parent.
            while True:
                ended = self._open.pop()
                self._counts[ended] -= 1
                if ended == tag:
                    break
            while self._silent and self._silent[-1] >= len(self._open):
                self._silent.pop()
        if hidden and (self._silent or tag in _SILENT):
            return
        if tag == "figcaption":
            self._end_caption()
        elif tag == "figure" and self._figures:
            self._end_figure()
        elif tag in _BLOCKS and self._caption is None:
            self._flush()

    def _end_caption(self) -> None:
        if self._caption is None:
            return
        caption, self._caption = " ".join("".join(self._caption).split()), None
        if not self._figures:
            self.items += [["text", caption, None, None]] if caption else []
            return
        for item in self.items[self._figures[-1] :]:
            if item[0] == "media" and caption and id(item) not in self._settled:
                item[3] = caption
        self._waiting = caption  # the figure's media may still come
        if caption:
            self._captions[-1].append((self._place, caption))

    def _end_figure(self) -> None:
        self._end_caption()
        self._flush()
        first, captions = self._figures.pop(), self._captions.pop()
        media = [item for item in self.items[first:] if item[0] == "media"]
        for item in media:
            if self._waiting and id(item) not in self._settled:
                item[3] = self._waiting
        taken = {item[3] for item in media}
        self._settled.update(id(item) for item in media if item[3] in {caption for _, caption in captions})
        for place, caption in reversed(captions):
            if caption not in taken:
                self.items.insert(place, ["text", caption, None, None])
        self._waiting = ""

    def close(self) -> None:
        super().close()
        self._end_caption()
        while self._figures:
            self._end_figure()

    def handle_data(self, data: str) -> None:
        if self._silent:
            return
        (self._text if self._caption is None else self._caption).append(data)


def parse(html: str | None) -> list[tuple]:
    """``(position, kind, text, reference, caption)``, positions from 0 without gaps."""
    parser = SequenceParser()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    return [(i, *item) for i, item in enumerate(parser.items)]


def sequences(pages: DataFrame) -> DataFrame:
    """``pages(page_id, html)`` -> ``page_id, position, kind, text, reference, caption``, a row an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(page, *item) for page, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True) for item in parse(html)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page_id", "position", "kind", "text", "reference", "caption"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, position int, kind string, text string, reference string, caption string")


def encode(payload: bytes) -> bytes:
    """Binary PGM of the padded payload."""
    padded = payload + bytes(-len(payload) % ROW or (0 if payload else ROW))
    return b"P5\n# bytes %d\n%d %d\n255\n" % (len(payload), ROW, len(padded) // ROW) + padded


def decode(media: bytes) -> tuple[int, np.ndarray]:
    """``(unpadded length, samples)``; raises on what is no whole image."""
    magic, comment, shape, depth, samples = media.split(b"\n", 4)
    width, height = map(int, shape.split())
    if magic != b"P5" or depth != b"255" or width != ROW or width * height != len(samples):
        raise ValueError("not a stored payload")
    return int(comment.split()[-1]), np.frombuffer(samples, np.uint8).reshape(height, width)


def feature(samples: np.ndarray) -> str:
    """Shape, sum, least and greatest sample, and the shares of 8 grey bands in parts of 65535."""
    flat = samples.reshape(-1)
    levels = np.bincount(flat, minlength=256)
    used = np.flatnonzero(levels)
    bands = levels.reshape(8, 32).sum(axis=1) * 65535 // len(flat)
    total = int((levels * np.arange(256)).sum())
    return f"{samples.shape[1]}x{samples.shape[0]};sum={total};min={used[0]};max={used[-1]};bands=" + "".join(f"{b:04x}" for b in bands.tolist())


def _slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``limit`` bytes in ``column``, so that no step holds much more."""
    first = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        size += n or 0
        if size >= limit:
            yield batch.slice(first, i + 1 - first)
            first, size = i + 1, 0
    if first < batch.num_rows:
        yield batch.slice(first)


def store_payloads(payloads: DataFrame, scratch: Scratch) -> DataFrame:
    """``payloads(id, payload binary)`` -> written ``id, reference, media``; the reference is the stored form's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "payload"):
                media = [encode(p or b"") for p in batch.column("payload").to_pylist()]
                names = [f"sha256:{hashlib.sha256(m).hexdigest()}" for m in media]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names), pa.array(media, pa.binary())], names=["id", "reference", "media"])

    return scratch.table(payloads.mapInArrow(run, "id long, reference string, media binary"), "media")


_READ_BACK = "reference string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(stored: DataFrame) -> DataFrame:
    """Features of the stored media, one row a reference, computed from the bytes read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, media in zip(batch.column("reference").to_pylist(), batch.column("media"), strict=True):
                data = media.as_py()
                length, samples = decode(data)
                payload = samples.tobytes()
                rows.append((name, length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _READ_BACK.split(", ")])

    return stored.select("reference", "media").mapInArrow(run, _READ_BACK).distinct()


def resolve(items: DataFrame, store: DataFrame) -> DataFrame:
    """``items`` with the columns of ``store`` (one row a reference) at their media references.

    Both sides are narrow; a reference that a third of all items share is split by adaptive execution.
    """
    return items.join(store, "reference", "left")


def payload_page(doc_id: int | str | None, reference: str) -> str:
    """The page that shows a stored payload as a captioned figure."""
    return f'<article><p>Document {doc_id}</p><figure><img src="{entities.escape(reference)}" alt="payload"><figcaption>Payload of document {doc_id}</figcaption></figure></article>'


def payload_sequences(docs: DataFrame) -> DataFrame:
    """Every text stored as media, shown on a page of its own, parsed and resolved: a row a document."""
    scratch = Scratch(docs.sparkSession, "media")
    payload = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    stored = store_payloads(docs.select(F.col("doc_id").cast("bigint").alias("id"), payload.alias("payload")), scratch)
    label = F.coalesce(F.col("id").cast("string"), F.lit("None"))
    html = F.format_string(payload_page("%1$s", "%2$s"), label, F.col("reference"))
    items = sequences(stored.select(F.col("id").alias("page_id"), html.alias("html"))).where("kind = 'media'")
    return resolve(items, scratch.table(read_back(stored), "features"))


def illustrated_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``pages(page_id, html)`` with the stored text of the document of the page's id as a captioned figure at the article's end.

    -> ``page_id, position, kind, text, reference, caption`` and the features of resolved payloads: the whole sequence of
    every page, texts and media in order. Pages without such a document have texts only; of several documents of one id the
    one of the least reference is shown, so that each page stands once, its positions in a row.
    """
    scratch = Scratch(pages.sparkSession, "media")
    payload = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    stored = store_payloads(docs.select(F.col("doc_id").cast("bigint").alias("id"), payload.alias("payload")), scratch)
    shown = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).join(stored.groupBy(F.col("id").alias("page_id")).agg(F.min("reference").alias("shown")), "page_id", "left")
    figure = F.concat(F.lit('<figure><img src="'), "shown", F.lit('" alt="payload"><figcaption>Payload of document '), F.col("page_id").cast("string"), F.lit("</figcaption></figure>"))
    head = F.substring_index("html", "</article>", 1)
    html = F.when(F.col("shown").isNull(), F.col("html")).otherwise(F.concat(head, figure, F.expr("substring(html, length(substring_index(html, '</article>', 1)) + 1)")))
    return resolve(sequences(shown.select("page_id", html.alias("html"))), scratch.table(read_back(stored), "features"))
