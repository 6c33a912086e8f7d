"""MinHash near-duplicates by b-bit signatures, with links confirmed on full shingle sets.

1. One pass over the texts: distinct word shingles, ``PERMUTATIONS`` minima. Of the minima, ``rows`` at a time make the
   band keys, and the low ``BITS`` bits of each make the packed signature. No text is shuffled.
2. Documents of one shingle set are one class, a node of its own with a number of its own. Only classes go on.
3. Classes that share a band key are candidates. In each bucket one member is the pivot and the others are compared
   with it; members already known to be of one component are not compared again. After ``PIVOT_ROUNDS`` such rounds
   the pairs still in different components are compared too, but for those that an exact prefix filter on their
   differences from the pivot rules out (see ``rest``). So no link between components is lost, and a bucket of near
   copies costs about its size, not its square.
4. A pair is estimated by bit counts: with m the share of equal low bits, similarity is (m - c) / (1 - c) for the
   chance c = 2^-BITS of equal bits. Pairs more than ``SIGMAS`` standard errors under the limit go (the chance to lose
   a link at the limit is under 3e-7); all others are confirmed by the intersection of their full sets.
5. Components of the links, by the graph engine.

A bucket or group may hold a third of all rows, so what is joined on its key is counted or picked first, written, and only
then joined: a small table is broadcast, and between two tables adaptive execution splits the hot key.

The band shape keeps the chance to miss a pair at the limit under ``MISS``. Sets hold 64-bit hashes of shingles.

Defined results: null and empty texts, and texts of blanks, have no shingles and link with nothing; a text of fewer
words than a shingle is one shingle. Rows that repeat a doc_id are placed each by its own text; the texts of one doc_id are
linked only if they are near. Rows with a null doc_id are their own, ``component_id`` null and kept. Empty tables give
empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.arrow_batches import small_batches
from graphloom.llm.bitmaps import FEW, parted
from graphloom.llm.text_arrays import BLANKS, byte_values, chunks, mix, shingles, utf8, word_hashes
from graphloom.plans.api import connected_components
from graphloom.plans.scratch import Scratch, side

PERMUTATIONS = 192
BITS = 2
MISS = 1e-6
SIGMAS = 5.0
PIVOT_ROUNDS = 2
#: Rows that one step of a Python worker signs at once.
SLICE = 1024
_PLANE = PERMUTATIONS // 64


def band_shape(similarity: float) -> tuple[int, int]:
    """``(rows, bands)``: the longest rows, and the fewest of these, that keep the chance of a miss at ``similarity`` under ``MISS``."""
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log(1 - similarity**rows))
        if rows * bands <= PERMUTATIONS:
            return rows, bands
    raise ValueError(f"no band shape for a similarity of {similarity}")


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(2 * PERMUTATIONS, dtype=np.uint64) + np.uint64(0xB5297A4D))
    seeds = (seeds >> np.uint64(32)).astype(np.uint32)
    return (seeds[:PERMUTATIONS] | np.uint32(1))[:, None], seeds[PERMUTATIONS:, None]


def minima(distinct: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each permutation over the hashes; long sets go block by block."""
    low = (distinct >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 4096):
        np.minimum(out, (a * low[None, i : i + 4096] + b).min(axis=1), out=out)
    return out


def _row_sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, sorted distinct shingles)`` of the batch's text column."""
    values, part = byte_values(BLANKS)
    data, bounds = utf8(batch.column("text"))
    for first, end in chunks(bounds):
        hashes, at = word_hashes(data, bounds[first : end + 1], values, part)
        for row in range(first, end):
            yield row, np.unique(shingles(hashes[at[row - first] : at[row - first + 1]], size))


def signer(size: int, rows: int, bands: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations()
        salt = mix(np.arange(bands, dtype=np.uint64) + np.uint64(0x2545F491))
        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            n_rows = batch.num_rows
            counts, digests = np.zeros(n_rows, np.int64), [b""] * n_rows
            least = np.zeros((n_rows, PERMUTATIONS), np.uint32)
            for row, distinct in _row_sets(batch, size):
                counts[row] = len(distinct)
                if len(distinct):
                    digests[row] = hashlib.blake2b(distinct.tobytes(), digest_size=16).digest()
                    least[row] = minima(distinct, a, b)
            keys = np.tile(salt, (n_rows, 1))
            for i in range(rows):
                keys = mix(keys * np.uint64(0xC2B2AE3D27D4EB4F) + least[:, i : rows * bands : rows])
            low = mix(least.astype(np.uint64))
            planes = [np.packbits((low >> np.uint64(bit) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64) for bit in range(BITS)]

            def lists(table: np.ndarray) -> pa.Array:
                flat = np.ascontiguousarray(table).view(np.int64).reshape(-1)
                return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, table.shape[1], dtype=np.int32)), pa.array(flat))

            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(counts), pa.array(digests, pa.binary()), lists(keys), lists(np.concatenate(planes, axis=1))],
                names=["doc_id", "text_key", "n_shingles", "digest", "bands", "bits"],
            )

    return run


_SIGNED = "doc_id long, text_key long, n_shingles long, digest binary, bands array<long>, bits array<long>"


def sets_of(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``(first, text_key, shingles)`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                sets = [s.view(np.int64) for _, s in _row_sets(part, size)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["first", "text_key", "shingles"])

    return run


def estimate(left: Column, right: Column) -> Column:
    """Collision-corrected similarity of two packed signatures."""
    differing = None
    for i in range(_PLANE):
        planes = [left[i + _PLANE * bit].bitwiseXOR(right[i + _PLANE * bit]) for bit in range(BITS)]
        any_plane = planes[0]
        for plane in planes[1:]:
            any_plane = any_plane.bitwiseOR(plane)
        differing = F.bit_count(any_plane) if differing is None else differing + F.bit_count(any_plane)
    chance = 2.0**-BITS
    return ((1 - differing / PERMUTATIONS) - chance) / (1 - chance)


def estimate_floor(similarity: float) -> float:
    """The least estimate that is still confirmed on full sets."""
    chance = 2.0**-BITS
    equal = chance + (1 - chance) * similarity
    return similarity - SIGMAS * math.sqrt(equal * (1 - equal) / PERMUTATIONS) / (1 - chance)


_EMPTY_LABELS = "node long, component long"


class _Finder:
    """The candidate rounds over classes of one corpus. ``classes``: ``id, first, text_key, n_shingles, bits, bands``."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, percent: int, scratch: Scratch, repeated: bool):
        self.docs, self.classes, self.size, self.percent, self.scratch, self.repeated = docs, classes, size, percent, scratch, repeated
        self.sizes = classes.select("id", "first", "text_key", "n_shingles", "bits")
        self.links: list[DataFrame] = []

    def full_sets(self, members: DataFrame) -> DataFrame:
        """``(first, text_key, shingles)`` of (at least) the given texts, in one pass over all; a bitmap of bounded size leaves out the rest."""
        texts, _ = parted(self.docs.where("doc_id IS NOT NULL"), ["doc_id", "text_key"], members, members.count(), "first", "text_key")
        sets = texts.select("doc_id", "text_key", "text").mapInArrow(sets_of(self.size), "first long, text_key long, shingles array<long>")
        return sets.dropDuplicates(["first", "text_key"]) if self.repeated else sets

    def may_link(self, na: str, nb: str, sa: str, sb: str) -> Column:
        """Sizes and signatures allow the pair to be a link."""
        sizes = 100 * F.least(na, nb) >= self.percent * F.greatest(na, nb)
        return sizes & (estimate(F.col(sa), F.col(sb)) >= estimate_floor(self.percent / 100))

    def confirm(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those of the distinct ``pairs(a, b)`` that may be links, with the keys of their texts."""
        left = self.sizes.toDF("a", "fa", "ka", "na", "sa")
        right = self.sizes.toDF("b", "fb", "kb", "nb", "sb")
        near = pairs.join(left, "a").join(right, "b")
        near = near.where(self.may_link("na", "nb", "sa", "sb")).select("a", "b", "fa", "ka", "fb", "kb")
        return self.scratch.table(near, f"{name}-near", counted=True)

    def linked(self, near: DataFrame, name: str, sets: DataFrame | None = None) -> DataFrame:
        """Confirm ``near`` on full sets -> links ``(u, v)``."""
        made = sets is None
        if made:
            members = near.select(F.inline(F.array(*(F.struct(F.col(f"f{x}").alias("first"), F.col(f"k{x}").alias("text_key")) for x in "ab")))).distinct()
            sets = self.scratch.table(self.full_sets(members), f"{name}-sets")
        right = near.join(sets.toDF("fb", "kb", "tb"), ["fb", "kb"])
        both = right.join(sets.toDF("fa", "ka", "ta"), ["fa", "ka"])
        shared = F.size(F.array_intersect("ta", "tb")).cast("bigint")
        union = F.size("ta") + F.size("tb") - shared
        links = self.scratch.table(both.where(100 * shared >= self.percent * union).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), f"{name}-links", counted=True)
        if made:
            self.scratch.drop(sets)
        return links

    def pivots(self, open_: DataFrame, step: int) -> DataFrame:
        """``(key, x, cx)``: one member of each bucket, the same in buckets of mostly the same members."""
        least = F.min_by(F.struct("id", "component"), F.xxhash64("id", F.lit(step)))
        picked = open_.groupBy("key").agg(least.alias("p")).select("key", F.col("p.id").alias("x"), F.col("p.component").alias("cx"))
        return side(self.scratch.table(picked, f"pivots-{step}", counted=True))

    def only(self, rows: DataFrame, key: str, picked: DataFrame, name: str) -> DataFrame:
        """``rows`` whose ``key`` is among the ``picked`` ones, which come out of ``rows`` by an aggregate of their own."""
        return rows.join(side(self.scratch.table(picked.select(key), name, counted=True)), key)

    def rest(self, open_: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``(pairs, sets)``: all pairs of one bucket and two components that can still be links, by an exact filter.

        Members are taken as differences from their bucket's pivot x: D(s) = s xor x. With
        beta = (100 - percent) / (100 + percent), s and v are linked iff |D(s) xor D(v)| <= beta * (|s| + |v|), so iff
        D(s) and D(v) share at least t = (|D(s)| + |D(v)| - beta * (|s| + |v|)) / 2 elements. Members linked to x are in
        its component already, so one of the two is not, whence t > 0: with the elements of each difference in one
        order, rarest first, the first |D| - t + 1 of both must have one in common. Near copies differ from the
        pivot in places of their own, which no other member shares; so few pairs come out, however large the bucket.

        t is at least (|D(s)| - beta * (|s| + |x|)) / (1 + beta) for a member s that is not linked to x, and more than
        (1 - beta) * |D(v)| / 2 for its partner v, since |v| <= |x| + |D(v)|; these bound what a member has to send.
        """
        scratch, p, q = self.scratch, 100 + self.percent, 100 - self.percent
        around = open_.join(self.pivots(open_, PIVOT_ROUNDS - 1), "key").where("id <> x").select("x", "cx", "id", "component").distinct()
        around = scratch.table(around, "around")
        # Pairs with the pivot itself are settled: only pivots around which several components stand go on.
        several = around.groupBy("x").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
        around = scratch.table(self.only(around, "x", several, "several"), "around-several")
        keys = self.sizes.select("id", "first", "text_key")
        members = around.select(F.explode(F.array("x", "id")).alias("id")).distinct().join(keys, "id").select("first", "text_key")
        sets = scratch.table(self.full_sets(members), "rest-sets")
        named = around.join(keys, "id").join(keys.toDF("x", "fx", "kx"), "x")
        own = named.join(sets.withColumn("n", F.size("shingles").cast("bigint")), ["first", "text_key"])
        both = own.join(sets.toDF("fx", "kx", "xs"), ["fx", "kx"])
        apart = F.concat(F.array_except("shingles", "xs"), F.array_except("xs", "shingles"))
        diffs = both.select("x", "id", "component", (F.col("cx") != F.col("component")).alias("far"), "n", F.size("xs").alias("nx"), apart.alias("apart"))
        diffs = diffs.withColumn("d", F.size("apart").cast("bigint"))
        rows = scratch.table(diffs.select("x", "id", "component", "far", "n", "nx", "d", F.explode("apart").alias("e")), "differences")
        shared = scratch.table(rows.groupBy("x", "e").agg(F.count("*").alias("df")).where("df > 1"), "shared", counted=True)
        by_member = Window.partitionBy("x", "id")
        ranked = rows.join(side(shared), ["x", "e"])
        # Elements of one member only come first and meet nothing: they count, but are not sent.
        place = F.col("d") - F.count("*").over(by_member) + F.row_number().over(by_member.orderBy("df", "e"))
        ranked = ranked.withColumn("place", place)
        least = F.when(F.col("far"), (p * F.col("d") - q * (F.col("n") + F.col("nx"))) / F.lit(p + q)).otherwise(F.lit((p - q) / (2 * p)) * F.col("d"))
        sent = ranked.where(F.col("place") <= F.col("d") - F.greatest(F.lit(1), F.ceil(least - 1e-6)) + 1).select("x", "e", "id", "component", "far", "n", "d", "place")
        sent = scratch.table(sent, "prefixes")
        one, two = sent.alias("s"), sent.alias("v")
        t = F.ceil((p * (F.col("s.d") + F.col("v.d")) - q * (F.col("s.n") + F.col("v.n"))) / F.lit(2 * p) - 1e-6)
        meet = (F.col("s.x") == F.col("v.x")) & (F.col("s.e") == F.col("v.e")) & (F.col("s.component") < F.col("v.component"))
        meet = meet & (F.col("s.place") <= F.col("s.d") - t + 1) & (F.col("v.place") <= F.col("v.d") - t + 1)
        meet = meet & (100 * F.least("s.n", "v.n") >= self.percent * F.greatest("s.n", "v.n"))
        return one.join(two, meet).select(F.col("s.id").alias("id"), F.col("v.id").alias("other")), sets

    def join_links(self) -> DataFrame:
        edges = self.links[0]
        for more in self.links[1:]:
            edges = edges.unionByName(more)
        return connected_components(edges)

    def run(self) -> DataFrame:
        """Labels ``(node, component)`` of classes that are linked to another."""
        keyed = self.classes.select("id", F.explode("bands").alias("key"))
        shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        open_ = self.scratch.table(self.only(keyed, "key", shared, "keys").select("key", "id", F.col("id").alias("component")), "buckets")
        labels = self.docs.sparkSession.createDataFrame([], _EMPTY_LABELS)
        for step in range(PIVOT_ROUNDS + 1):
            sets = None
            if step < PIVOT_ROUNDS:
                pairs = open_.join(self.pivots(open_, step), "key").where("component <> cx").select("id", F.col("x").alias("other"))
            else:
                pairs, sets = self.rest(open_)
            pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
            near = self.confirm(self.scratch.table(pairs, f"pairs-{step}"), f"{step}")
            if near._graphloom_rows:
                links = self.linked(near, f"{step}", sets)
                if links._graphloom_rows:
                    self.links.append(links)
                    labels = self.join_links()
                    known = labels.withColumnsRenamed({"node": "id", "component": "c"})
                    open_ = open_.select("key", "id").join(known, "id", "left").select("key", "id", F.coalesce("c", "id").alias("component"))
            if step < PIVOT_ROUNDS:
                open_ = self.scratch.table(open_, f"labelled-{step}") if self.links else open_
                split = open_.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
                open_ = self.scratch.table(self.only(open_, "key", split, f"split-{step}"), f"open-{step}", counted=True)
                if not open_._graphloom_rows:
                    break
        return labels


def _placed(docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    with small_batches(docs.sparkSession):
        return _place(docs, shingle_words, percent)


def _place(docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """A row a document: ``doc_id, text_key, n_shingles, component_id, rep_key``; the component's document of least id has the text ``rep_key``."""
    scratch = Scratch(docs.sparkSession, "near")
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("text_key"))
    rows, bands = band_shape(percent / 100)
    # The number of a row stands in the written table: it is the same for all later readers.
    signed = scratch.table(docs.mapInArrow(signer(shingle_words, rows, bands), _SIGNED).withColumn("row", F.monotonically_increasing_id()), "signed")
    real = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    firsts = real.groupBy("digest").agg(F.min(F.struct("doc_id", "row", "text_key")).alias("f"))
    firsts = scratch.table(firsts.select("digest", F.col("f.doc_id").alias("first"), F.col("f.row").alias("node"), F.col("f.text_key").alias("first_key")), "firsts")
    classes = real.join(firsts.select(F.col("node").alias("row")), "row", "left_semi")
    classes = scratch.table(classes.select(F.col("row").alias("id"), F.col("doc_id").alias("first"), "text_key", "n_shingles", "bits", "bands"), "classes")
    repeated = bool(real.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count())
    labels = _Finder(docs, classes, shingle_words, percent, scratch, repeated).run()
    roots = labels.select(F.col("component").alias("node"), "component").distinct()
    tops = labels.select("node", "component").unionByName(roots).join(firsts, "node").groupBy("component").agg(F.min(F.struct("first", "first_key")).alias("top"))
    tops = scratch.table(tops.select(F.col("component").alias("c"), F.col("top.first").alias("top"), F.col("top.first_key").alias("top_key")), "tops", counted=True)
    of = firsts.join(labels, "node", "left").withColumn("c", F.coalesce("component", "node")).join(side(tops), "c", "left")
    of = of.select("digest", F.coalesce("top", "first").alias("component_id"), F.coalesce("top_key", "first_key").alias("rep_key"))
    placed = signed.select("doc_id", "text_key", "n_shingles", "digest").join(of, "digest", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return placed.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"), "rep_key")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_shingles, component_id, kept``, one row a document.

    Linked: 100 * intersection >= percent * union over the distinct shingles. ``component_id``: least doc_id reachable.
    """
    placed = _placed(docs, shingle_words, percent).select("doc_id", "n_shingles", "component_id")
    return placed.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns: of each component the document of the least doc_id, once.

    Rows with a null doc_id all stay. Of rows that repeat a doc_id and its text one stays, whichever; a doc_id that stands
    on texts of several components stays with each of them that it is the least of. Texts without a shingle link with
    nothing.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    placed = _placed(docs, shingle_words, percent).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n_shingles", "component_id", "rep_key")
    stays = (F.col("n_shingles") == 0) | ((F.col("_id") == F.col("component_id")) & (F.col("_key") == F.col("rep_key")))
    decided = placed.groupBy("_id", "_key").agg(F.count("*").alias("n"), F.bool_and(stays).alias("stays"))
    decided = scratch.table(decided.where("NOT stays OR n > 1"), "decided", counted=True)
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    name = "_" * (1 + max(map(len, docs.columns)))
    said = decided.select(F.struct(*decided.columns).alias(name))
    same = (F.col("doc_id").cast("bigint") == F.col(f"{name}._id")) & (key == F.col(f"{name}._key"))
    # Only texts that the bitmap takes for decided ones are joined.
    hits, clear = parted(docs, [F.col("doc_id").cast("bigint"), key], decided, decided._graphloom_rows, "_id", "_key")
    met = hits.join(side(said, most=FEW, rows=decided._graphloom_rows, fixed=True), same, "left")
    met = met.where(F.coalesce(f"{name}.stays", F.lit(True)))
    if not decided.where("stays").limit(1).count():
        return clear.unionByName(met.drop(name))
    twice = met.where(F.col(name).isNotNull()).dropDuplicates([name])
    return clear.unionByName(met.where(F.col(name).isNull()).unionByName(twice).drop(name))
