"""Licence scan by canonical digest. DataFrame functions only.

A text is brought to a canonical form: lower case, copyright notices dropped, punctuation and white space to single
blanks, equivalent spellings to one. Its SHA-256 is hash-joined to the digests of known licences, which go through
the same columns. Lines that speak of a licence are looked up the same way, so that a notice inside another text is
found too; the licence of the entire text is a column of its own.

Defined results: a null text is an empty one; texts that are empty in canonical form match nothing. Several known
names with one digest: the least. Repeated documents are each answered. Empty tables give empty results. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.license_texts import KNOWN, SPELLINGS, WHOLE_DIGESTS
from graphloom.plans.scratch import Scratch, side

#: Known digests are broadcast; a larger collection is joined by shuffle.
MAX_BROADCAST_LICENSES = 20_000

_MARK = "(?:copyright(?![a-z]*[ \\t]+(?:holder|owner|notice))|\\(c\\)(?![ \\t]+you )|©)"
_DATED = f"{_MARK}[ \\t,:-]*(?:\\(c\\)|©|copyright|[0-9]{{4}})"
_OPENING = "permission is hereby granted|permission to use|redistribution and use"
_REST = f"(?:(?!{_OPENING})[^\\n])"
_MARGIN = "[ \\t\\r#*/;-]*"
#: Notices: lines at a paragraph's head, lines with a year or a second sign, lines after such; on one line with a
#: licence, up to its opening words. A line that only happens to begin with the word, by wrapping, is none. The last
#: alternative takes what looks like a notice but opens no licence: it is put back whole, so each line is read once.
_COPYRIGHT = (
    f"(?:\\n{_MARGIN}\\n{_MARGIN}{_MARK}{_REST}*+|\\n{_MARGIN}{_DATED}{_REST}*+)(?:\\n{_MARGIN}{_MARK}{_REST}*+)*+"
    f"|(?<![\\p{{L}}\\p{{N}}]){_DATED}{_REST}*+(?={_OPENING})"
    f"|(?<![\\p{{L}}\\p{{N}}])({_DATED}{_REST}*+)"
)
_NOTICE = "licen[cs]e|licensing"


def canonical(text: Column) -> Column:
    """The canonical form: blank-padded words inside, trimmed at the end."""
    lowered = F.concat(F.lit("\n\n"), F.lower(F.coalesce(text, F.lit(""))))
    words = F.regexp_replace(F.regexp_replace(lowered, _COPYRIGHT, "\n$1"), "[^\\p{L}\\p{N}]+", " ")
    for spelling, usual in SPELLINGS.items():
        words = F.replace(words, F.lit(spelling), F.lit(usual))
    return F.trim(words)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark, licenses: dict[str, tuple[str, ...]] = KNOWN, digests: dict[str, str] = WHOLE_DIGESTS) -> DataFrame:
    """``(digest, license)`` of known texts, and of ``digests`` of texts that are not kept here; one row a digest."""
    rows = [(name, text) for name, texts in licenses.items() for text in texts]
    schema = T.StructType([T.StructField("license", T.StringType()), T.StructField("body", T.StringType())])
    table = spark.createDataFrame(rows, schema).where(canonical(F.col("body")) != "").select(digest(F.col("body")).alias("digest"), "license")
    table = table.union(spark.createDataFrame(list(digests.items()), "digest string, license string"))
    table = table.groupBy("digest").agg(F.min("license").alias("license"))
    return F.broadcast(table) if len(rows) + len(digests) <= MAX_BROADCAST_LICENSES else table


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, canonical_sha256, license, n_notices, notices``.

    ``license``: of the entire text, or null. ``n_notices``: lines that are a known text; ``notices``: their distinct
    names in order, comma-joined. Each row is answered by its own lines, also where ids repeat.

    One pass over the texts leaves a digest and the few lines that speak of a licence; all else reads that table.
    """
    scratch = Scratch(docs.sparkSession, "license")
    lowered = F.lower("text")
    lines = F.filter(F.split(lowered, "\\n", -1), lambda line: line.rlike(_NOTICE))
    read = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", digest(F.col("text")).alias("canonical_sha256"), F.when(lowered.rlike(_NOTICE), lines).alias("lines"))
    read = scratch.table(read, "read")
    found = read.where("lines IS NOT NULL").select("row", F.explode("lines").alias("line"))
    found = found.select("row", digest(F.col("line")).alias("digest")).join(known, "digest")
    names = F.array_join(F.sort_array(F.collect_set("license")), ",")
    hits = scratch.table(found.groupBy("row").agg(F.count("*").alias("n_notices"), names.alias("notices")), "notices", counted=True)
    out = read.drop("lines").join(known.withColumnRenamed("digest", "canonical_sha256"), "canonical_sha256", "left").join(side(hits), "row", "left")
    return out.select("doc_id", "canonical_sha256", "license", F.coalesce("n_notices", F.lit(0).cast("bigint")).alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))
