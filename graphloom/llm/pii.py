"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

Base kinds are e-mail, IP and card numbers and phones. They are the seeds: the words to the left and right of a seed are
lexical patterns. Strings in the shape of a secret (32 hexadecimal digits or more) count nearly as seeds, but are found only
where a pattern confirms them. Candidate instances of the patterns around them are runs of words with a digit or @ that
are no seed, the first word of each, and whatever word follows a label such as "login:" or "key=". Spark scores the graph of patterns and
instances in rounds: a pattern by the mean score of what stands in it (seeds 1, others by the round before, all other words
and ``damping`` more 0), an instance by 1 - product(1 - pattern) over patterns of at least ``min_pattern``, with
``min_support`` distinct seeds or found instances of their own. So "login:" can be a pattern, while "of", which mostly has
other words beside it, cannot. Instances that patterns give at least ``min_score`` are found identifiers, kind ``id``, wherever
they stand; those of letters only, or shorter than ``SURE`` characters, only behind a good pattern.

A pattern is the whole word beside, in lower case; a word without letters and digits takes the one before it along, up to
``REACH`` words ("token ="). Long words and instances are told apart by digest, never cut. All work on a text is linear in
its length.

Only occurrences with their contexts are shuffled, never texts. All sums are pre-aggregated; a pattern such as
"the" may own a third of the graph.

Defined results: a null text is an empty one; it has no spans. Base spans are found by kind, leftmost and not
overlapping; kinds may overlap each other. Found identifiers that overlap a base span are none. Repeated rows are each
answered; distinct instances count once. Scores at a limit count as reaching it. Empty tables give empty results. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrow_batches import small_batches
from graphloom.llm.bitmaps import FEW, parted
from graphloom.llm.text_arrays import chunks, utf8
from graphloom.plans.scratch import Scratch, side

#: The kinds in their order; found identifiers come last.
KINDS = ("email", "ip", "card", "phone", "id")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run is tried from its start only: from inside it the same rest would have to follow.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"\S+")
_LABEL = re.compile(r"[a-z_]+[=:]")
_SECRET = re.compile(r"[0-9a-f]{32,}")
_ALNUM = re.compile(r"[^\W_]")
_LIKE = re.compile(r"[0-9@]")
_EDGE = "\"'`.,;:!?()[]{}<>|*#%&$"
_ENDS = tuple(".,;:!?)|")
#: Characters of a word or instance that are kept as they are; longer ones become a digest.
KEPT = 64
#: Words of one pattern, at most; shortest instance that is found wherever it stands; what the shape of a secret counts.
REACH, SURE, SHAPE = 3, 4, 0.8


@dataclass(frozen=True)
class Bootstrap:
    rounds: int = 3
    damping: int = 2
    min_pattern: float = 0.5
    min_support: int = 3
    min_score: float = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the local part before it and a domain after it; linear in any text."""
    low = 0
    at = text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        low = domain.end() if domain else at + 1
        if domain:
            yield start, low
        at = text.find("@", low)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str, digits: bool = True) -> list[tuple[int, int, int]]:
    """``(start, rank of the kind, end)`` in order."""
    out = [(s, 0, e) for s, e in emails(text)]
    if digits:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if 14 <= len(m[0]) and 14 <= len(own := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(own):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def whole(text: str) -> str:
    """``text`` in lower case, or the start and digest of a long one: equal for equal texts, whatever their length."""
    text = text.lower()
    if len(text) <= KEPT:
        return text
    return f"{text[:24]}#{hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"


def contexts(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str, str, str, bool, float, bool, int, int]]:
    """``(start, end, instance, left, right, seed, prior, sure, left_n, right_n)`` of seeds and of candidates outside of them.

    ``left_n, right_n``: how often the context stands in the text, whatever is beside it. ``sure``: may be found by its
    instance alone.
    """
    places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    names = [whole(text[s:e]) for s, e in places]
    labels = [m[0] if (m := _LABEL.match(name)) else "" for name in names]
    before = [""]  # the context to the left of each word, and of the end
    for i in range(1, len(names) + 1):
        if _ALNUM.search(names[i - 1]):
            before.append(names[i - 1])
            continue
        first = i - 1
        while first > 0 and i - first < REACH and not _ALNUM.search(names[first]):
            first -= 1
        before.append(whole(" ".join(names[max(first, 0) : i])))
    left_often, often, label_often = Counter(before), Counter(names), Counter(labels)

    def left_n(context: str) -> int:
        return max(1, label_often[context] if context in label_often else left_often[context])

    covered = [False] * len(names)
    first, done = 0, 0
    heads: list[tuple] = []
    for start, _, end in spans:  # in order, so that words are passed once; kinds may overlap
        while first < len(places) and places[first][1] <= start:
            first += 1
        last = first
        while last < len(places) and places[last][0] < end:
            covered[last] = True
            last += 1
        head = whole(text[max(places[first][0], min(done, start)) : start].lstrip(_EDGE))
        done = max(done, end)
        heads.append((start, end, head, before[first], names[last] if last < len(names) else ""))
    head_often = Counter(h for _, _, h, _, _ in heads)
    for start, end, head, left, right in heads:
        n = max(head_often[head], label_often.get(head, 0)) if head else left_n(left)
        yield start, end, whole(text[start:end]), head or left, right, True, 1.0, True, max(1, n), max(1, often[right])

    i = 0
    while i < len(places):
        at, (start, end) = i, places[i]
        i += 1
        if covered[at]:
            continue
        left, label = before[at], labels[at]
        if label and end - start > len(label):
            left, start = label, start + len(label)
        elif not (_LIKE.search(names[at]) or left.endswith((":", "="))):
            continue
        elif _LIKE.search(names[at]):
            while i < len(places) and not covered[i] and not labels[i] and _LIKE.search(names[i]) and not text[places[i - 1][0] : places[i - 1][1]].endswith(_ENDS) and "\n" not in text[places[i - 1][1] : places[i][0]]:
                i += 1
            end = places[i - 1][1]
        right = names[i] if i < len(names) else ""
        ends = {end, places[at][1]}  # of a run also its first word alone
        for end in sorted(ends):
            word = text[start:end]
            first = start + len(word) - len(word.lstrip(_EDGE))
            word = word.strip(_EDGE)
            if not _ALNUM.search(word):
                continue
            name, last = whole(word), right if end == max(ends) else names[at + 1]
            sure = len(word) >= SURE and bool(_LIKE.search(word))
            yield first, first + len(word), name, left, last, False, SHAPE if _SECRET.fullmatch(word.lower()) else 0.0, sure, left_n(left), max(1, often[last])


_SPAN = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())])
_COLUMNS = ("start", "end", "instance", "left", "right", "seed", "prior", "sure", "left_n", "right_n")
_SEEN = pa.struct(list(zip(_COLUMNS, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()), strict=True)))
_SEEN_SQL = "start:int,end:int,instance:string,left:string,right:string,seed:boolean,prior:double,sure:boolean,left_n:bigint,right_n:bigint"
_READ = f"row long, doc_id long, text_key long, base_sha256 string, base array<struct<start:int,rank:int,end:int>>, seen array<struct<{_SEEN_SQL}>>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        data, bounds = utf8(batch.column("text"))
        # Texts without a digit, an @ and the end of a label have neither spans nor candidates.
        digits, signs = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for first, end in chunks(bounds):
            part, at = data[bounds[first] : bounds[end]], bounds[first : end + 1] - bounds[first]
            for out, flags in ((digits, (part >= 48) & (part <= 57)), (signs, (part == 64) | (part == 58) | (part == 61))):
                out[first:end] = np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
        hashes, base, seen = [nothing] * batch.num_rows, [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
        texts = batch.column("text")
        for i in np.flatnonzero((digits > 0) | (signs > 0)).tolist():
            text = texts[i].as_py()
            spans = base_spans(text, bool(digits[i]))
            if spans:
                hashes[i] = hashlib.sha256(as_text(spans).encode()).hexdigest()
                base[i] = [{"start": s, "rank": k, "end": e} for s, k, e in spans]
            seen[i] = [dict(zip(_COLUMNS, x, strict=True)) for x in contexts(text, spans)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), batch.column("text_key"), pa.array(hashes, pa.string()), pa.array(base, pa.list_(_SPAN)), pa.array(seen, pa.list_(_SEEN))],
            names=["row", "doc_id", "text_key", "base_sha256", "base", "seen"],
        )


def found_instances(seen: DataFrame, how: Bootstrap, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``seen(row, instance, left, right, seed, prior, left_n, right_n)`` -> ``(instance, score)`` of the identifiers found, ``(pattern, confidence)`` of good patterns."""
    sides = F.array(F.struct(F.concat(F.lit("l "), "left").alias("pattern"), F.col("left_n").alias("n")), F.struct(F.concat(F.lit("r "), "right").alias("pattern"), F.col("right_n").alias("n")))
    sided = seen.select("row", "instance", "seed", "prior", F.inline(sides)).where("length(pattern) > 2")
    totals = sided.groupBy("row", "pattern").agg(F.max("n").alias("n")).groupBy("pattern").agg(F.sum("n").alias("total"))
    totals = scratch.table(totals, "totals", counted=True)
    edges = scratch.table(sided.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.max("prior").alias("prior"), F.count("*").alias("times")), "edges")
    scores = edges.groupBy("instance").agg(F.max("seed").alias("seed"), F.max("prior").alias("prior"))
    scores = scratch.table(scores.select("instance", "seed", "prior", F.col("prior").alias("score"), F.lit(0.0).alias("gained")), "scores", counted=True)
    good = None
    for i in range(how.rounds):
        strong = (F.col("score") >= how.min_score).cast("bigint")
        by_pattern = edges.select("pattern", "instance", "times").join(side(scores.select("instance", "score"), rows=scores._graphloom_rows), "instance")
        by_pattern = by_pattern.groupBy("pattern").agg(F.sum(F.col("score") * F.col("times")).alias("found"), F.sum("times").alias("times"), F.sum(strong).alias("support"))
        # Most patterns have too little support: they need no total.
        by_pattern = by_pattern.where(F.col("support") >= how.min_support).join(side(totals), "pattern").withColumn("confidence", F.col("found") / (F.greatest("total", "times") + how.damping))
        good = scratch.table(by_pattern.where(F.col("confidence") >= how.min_pattern).select("pattern", "confidence"), f"patterns-{i}", counted=True)
        gained = edges.join(side(good), "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("gained"))
        gained = scratch.table(gained, f"gained-{i}", counted=True)
        fresh = scores.select("instance", "seed", "prior").join(side(gained), "instance", "left").withColumn("gained", F.coalesce("gained", F.lit(0.0)))
        fresh = fresh.select("instance", "seed", "prior", F.when(F.col("seed"), 1.0).otherwise(F.greatest("prior", "gained")).alias("score"), "gained")
        scores = scratch.table(fresh, f"scores-{i}", counted=True)
    found = scores.where((~F.col("seed")) & (F.col("gained") >= how.min_score)).select("instance", F.col("gained").alias("score"))
    return scratch.table(found, "found", counted=True), good


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(F.get(names, s["rank"]), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def find(docs: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_email, n_ip, n_card, n_phone, n_id, base_sha256, spans, all_spans, text_key``.

    ``all_spans``: base spans and found identifiers as structs of code points, ends exclusive, in order. ``text_key``: the
    text's xxhash64, which tells rows of one doc_id apart.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("text_key", F.xxhash64("text"))
    with small_batches(docs.sparkSession):
        read = scratch.table(texts.mapInArrow(_read, _READ), "read")
    seen = read.where(F.size("seen") > 0).select("row", F.explode("seen").alias("s")).select("row", "s.*")
    found, good = found_instances(seen, how, scratch)
    hits = seen.where("NOT seed").join(side(found), "instance").select("row", "sure", "start", "end", F.concat(F.lit("l "), "left").alias("pattern"))
    hits = scratch.table(hits, "hits")
    unsure = hits.where("NOT sure").join(side(good), "pattern").select("row", "start", "end")
    # Of a run and its first word the run.
    extra = hits.where("sure").select("row", "start", "end").unionByName(unsure).groupBy("row", "start").agg(F.max("end").alias("end"))
    span = F.struct("start", F.lit(len(KINDS) - 1).alias("rank"), "end")
    extra = extra.groupBy("row").agg(F.collect_list(span).alias("extra"))
    extra = scratch.table(extra, "extra", counted=True)
    out = read.select("row", "doc_id", "text_key", "base_sha256", "base").join(side(extra), "row", "left")
    out = out.withColumn("all_spans", F.array_sort(F.concat("base", F.coalesce("extra", F.filter("base", lambda s: F.lit(False))))))
    count = lambda rank: F.size(F.filter("all_spans", lambda s: s["rank"] == rank)).cast("bigint")
    return out.select("doc_id", *(count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)), "base_sha256", spans_text(F.col("all_spans")).alias("spans"), "all_spans", "text_key")


def redacted(text: str, spans: list[dict]) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become the first one's."""
    out, at = [], 0
    for span in spans:
        if span["start"] >= at:
            out += (text[at : span["start"]], f"[{KINDS[span['rank']].upper()}]")
        at = max(at, span["end"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """All rows and columns of ``docs``, texts without what :func:`find` finds. Null texts stay null."""
    found = find(docs, how).where(F.size("all_spans") > 0).select("doc_id", "text_key", "all_spans")
    found = Scratch(docs.sparkSession, "pii").table(found.dropDuplicates(["doc_id", "text_key"]), "redactions", counted=True)
    name = "_" * (1 + max(map(len, docs.columns)))
    said = found.select(F.struct("doc_id", "text_key", "all_spans").alias(name))
    own = [F.col("doc_id").cast("bigint"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))]
    same = own[0].eqNullSafe(F.col(f"{name}.doc_id")) & (own[1] == F.col(f"{name}.text_key"))
    # Only texts that the bitmap takes for ones with spans are joined and rewritten.
    hits, clear = parted(docs, own, found, found._graphloom_rows, "doc_id", "text_key")
    met = hits.join(side(said, most=FEW, rows=found._graphloom_rows), same, "left").withColumn(name, F.col(f"{name}.all_spans"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, columns = batch.column(batch.num_columns - 1), batch.columns[:-1]
            if spans.null_count < len(spans):
                texts = columns[at].to_pylist()
                for i in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    texts[i] = texts[i] and redacted(texts[i], spans[i].as_py())
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return clear.unionByName(met.select(*(docs[c] for c in docs.columns), name).mapInArrow(run, docs.schema))
