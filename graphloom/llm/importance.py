"""Target-distribution importance resampling over hashed n-grams, in Spark SQL only.

A text's features are its runs of one to ``orders`` words, each in the bucket crc32 modulo ``buckets``. A bucket's gain is
the logarithm of its smoothed share in the target over that in the corpus, a document's weight the mean gain of its
features. Weight plus a seeded Gumbel number is its score: the highest scores are a draw without replacement, in
proportion to the exponent of the weights.

1. The texts become arrays of buckets once, which are written: all later steps read numbers.
2. Buckets are exploded and counted, before the shuffle in each task; a count or gain table has at most ``buckets`` rows.
3. Buckets are exploded again and meet the broadcast gains; a document's gains are summed in its own task first.
4. Scores are sorted by ranges. A row's rank is its place in its range and the sizes of the ranges before, of which the
   driver sees one number each. Ties of score and doc_id are told apart by row, so no range can grow hot.

Defined results: null and empty texts, and texts without a word, have no features and the weight 0; a null doc_id has the
text form '' for its draw and comes after all others of its score; rows that repeat a doc_id are documents of their own. An
empty corpus gives no rows; with an empty target every gain falls with the bucket's count. Other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.plans.ranges import ranked
from graphloom.plans.scratch import Scratch, side

#: Between words: every ASCII character but digits and small letters, as capitals have been folded.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A gain counts in thousandths.
SCALE = 1000
#: Numbers of a draw: the first eight hexadecimal digits of a digest.
DIGITS, RANGE = 8, 1 << 32


def fold(text: Column) -> Column:
    """A to Z in small letters, nothing else. ``lower`` is that for ASCII texts, and much faster."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.filter(F.split(fold(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), lambda w: w != "")


def _runs(all_words: Column, size: int) -> Column:
    starts = F.slice(all_words, 1, F.greatest(F.size(all_words) - size + 1, F.lit(0)))
    return F.transform(starts, lambda w, i: F.concat_ws(" ", w, *(F.get(all_words, i + k) for k in range(1, size))))


def features(all_words: Column, orders: int) -> Column:
    """All runs of one to ``orders`` words, repeats kept."""
    return F.concat(all_words, *(_runs(all_words, size) for size in range(2, orders + 1)))


def bucketed(texts: DataFrame, orders: int, buckets: int) -> DataFrame:
    """``texts(text, ...)`` with ``n_words`` and the bucket of each feature in place of the text."""
    split = texts.withColumn("words", words(F.col("text"))).drop("text")
    bucket = F.transform(features(F.col("words"), orders), lambda g: (F.crc32(g.cast("binary")) % buckets).cast("int"))
    return split.select(*(c for c in split.columns if c != "words"), F.size("words").cast("bigint").alias("n_words"), bucket.alias("buckets"))


def counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, corpus_total: int, target_total: int, buckets: int) -> DataFrame:
    """``(bucket, gain)`` of the buckets that the corpus has; ``corpus`` and ``target`` are counts."""
    both = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    real = lambda c: (F.coalesce(F.col(c), F.lit(0)) + 1).cast("double")
    ratio = real("t") * F.lit(float(corpus_total + buckets)) / (real("s") * F.lit(float(target_total + buckets)))
    return both.select("bucket", F.floor(SCALE * F.log(ratio)).cast("bigint").alias("gain"))


def floored_mean(total: Column, n: Column) -> Column:
    """Whole division that goes down for negative totals too; 0 of none."""
    return F.when(n > 0, ((total - F.pmod(total, n)) / n).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def noise(doc_id: Column, seed: int) -> Column:
    """The seeded Gumbel number of a document, in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / F.lit(float(RANGE))))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, orders: int = 2, buckets: int = 10_000, percent: int = 25, min_words: int = 20, seed: int = 7) -> DataFrame:
    """``docs(doc_id, text)`` and ``target(text)`` -> ``doc_id, n_features, weight, score, rank``, one row a document.

    ``percent`` of the documents of at least ``min_words`` words are drawn; the others have a null rank.
    """
    scratch = Scratch(docs.sparkSession, "importance")

    def written(texts: DataFrame, name: str) -> tuple[DataFrame, int, int]:
        seen = Observation()
        rows = bucketed(texts, orders, buckets).observe(
            seen, F.coalesce(F.sum(F.size("buckets").cast("bigint")), F.lit(0)).alias("features"), F.coalesce(F.sum((F.col("n_words") >= min_words).cast("bigint")), F.lit(0)).alias("long")
        )
        return scratch.table(rows, name), seen.get["features"], seen.get["long"]

    corpus, corpus_total, eligible = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "corpus")
    wanted, target_total, _ = written(target.select("text"), "target")
    gain = gains(counts(corpus), counts(wanted), corpus_total, target_total, buckets)
    gain = side(scratch.table(gain, "gains", counted=True), most=buckets, fixed=True)
    keys = ["row", "doc_id", "n_words", "n_features"]
    each = corpus.select("row", "doc_id", "n_words", F.size("buckets").cast("bigint").alias("n_features"), F.explode_outer("buckets").alias("bucket"))
    summed = each.join(gain, "bucket", "left").groupBy(*keys).agg(F.coalesce(F.sum("gain"), F.lit(0)).cast("bigint").alias("total"))
    weighed = summed.withColumn("weight", floored_mean(F.col("total"), F.col("n_features")))
    scored = scratch.table(weighed.select(*keys, "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score")), "scored")
    scratch.drop(corpus)
    out = ["doc_id", "n_features", "weight", "score"]
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    drawn = ranked(scored.where(F.col("n_words") >= min_words), order, scratch)
    rank = F.when(F.col("place") <= percent * eligible // 100, F.col("place"))
    rest = scored.where(F.col("n_words") < min_words).select(*out, F.lit(None).cast("bigint").alias("rank"))
    return drawn.select(*out, rank.alias("rank")).unionByName(rest)
