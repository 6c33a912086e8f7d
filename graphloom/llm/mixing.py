"""Mixing sources to target weights by hierarchical budgeting. DataFrame functions only.

A tree of ``levels`` (such as domain, language, source) gets a token budget at its root. Every node passes its budget
to its children in proportion to their weights; a child that cannot use its share (supply times ``max_epochs``) keeps
what it can use and the rest goes to its siblings, again by weight, before any of it counts as missing further up:
a node's capacity is the sum of its leaves', so a subtree that is short as a whole hands its rest to its parent's
other children. A leaf with a weight 0 anywhere on its path has no capacity. All shares are whole tokens and add up to
the budget, or to the capacity if that is less.

A leaf then reads seeded epochs: epoch e lists its documents in the order of md5(seed:e:doc_id); the epochs are read
one after the other and the leaf's budget is the token-prefix of that. Its last document is cut to fit.

A token is a piece of the text between single blanks, so a prefix of n tokens is ``substring_index(text, ' ', n)``.

Prefix sums need no task with a whole leaf, however its rows repeat: an epoch's documents fall into about
sqrt(documents) ranges of the hash, whose sums are added up; the range in which the budget ends is added up by runs of
equal rows; the run in which it ends is numbered by sqrt(rows) buckets of the row numbers.

Defined results: null and empty texts have no tokens and are never selected. Null level values are a node of their own,
named ``(null)``. Unknown names have weight ``default_weight``; weight 0 gets nothing. Rows with one doc_id and level
values, repeated, share one order value and are taken in the order of their token counts, then of the rows; each
row has its own prefix. A budget over the total capacity takes everything. Empty tables give empty results. Columns
keep their names and values, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.scratch import Scratch, side

_BIG = "decimal(38,0)"


@dataclass(frozen=True)
class Mix:
    """``weights``: for each level, whole-number weights by node name. ``budget``: tokens; None: ``percent`` of the supply."""

    levels: tuple[str, ...]
    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    default_weight: int = 1
    budget: int | None = None
    percent: int = 60
    max_epochs: int = 2
    seed: int = 7


def tokens(text: Column) -> Column:
    """Pieces between single blanks; none in a null or empty text."""
    return F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).otherwise(0).cast("bigint")


def _weight(mix: Mix, level: str) -> Column:
    out = F.lit(mix.default_weight)
    for name, weight in sorted(mix.weights.get(level, {}).items()):
        out = F.when(F.col(level) == name, F.lit(weight)).otherwise(out)
    return out.cast(_BIG)


def allocate(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``leaves(*levels, supply)`` -> the same with ``budget``: water-filling from the root down.

    Children of one node are sorted by capacity over weight: with S the capacity before a child and W the weight from
    it on, it is full iff its capacity is at most (B - S) * weight / W. The others share the rest by cumulative
    rounding, which keeps whole tokens and exact sums.
    """
    usable = reduce(and_, (_weight(mix, level) > 0 for level in mix.levels))
    capacity = leaves.withColumn("cap", F.when(usable, F.col("supply") * mix.max_epochs).otherwise(0).cast(_BIG))
    wanted = F.lit(mix.budget).cast(_BIG) if mix.budget is not None else F.expr(f"(all_supply * {mix.percent}) div 100").cast(_BIG)
    above = None
    for depth, level in enumerate(mix.levels):
        parents, here = ["root", *mix.levels[:depth]], ["root", *mix.levels[: depth + 1]]
        nodes = capacity.withColumn("root", F.lit("")).groupBy(*here).agg(F.sum("cap").cast(_BIG).alias("cap"), F.sum("supply").alias("all_supply"))
        if above is None:
            top = Window.partitionBy("root")
            nodes = nodes.withColumn("all_supply", F.sum("all_supply").over(top)).withColumn("pool", F.least(F.sum("cap").over(top).cast(_BIG), wanted))
        else:
            nodes = nodes.join(above, parents)
        nodes = nodes.withColumn("w", _weight(mix, level))
        ratio = F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w").cast("double"))
        by_ratio = Window.partitionBy(*parents).orderBy(ratio.asc_nulls_last(), level)
        before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
        nodes = nodes.withColumns({"s": F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(_BIG), "ww": F.sum("w").over(after).cast(_BIG)})
        nodes = nodes.withColumn("full", (F.col("w") > 0) & (F.col("cap") * F.col("ww") <= (F.col("pool") - F.col("s")) * F.col("w")))
        used = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(Window.partitionBy(*parents))
        open_w = F.when(F.col("full"), 0).otherwise(F.col("w"))
        nodes = nodes.withColumns({"rest": (F.col("pool") - used).cast(_BIG), "open": open_w.cast(_BIG)})
        upto = Window.partitionBy(*parents).orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
        nodes = nodes.withColumns({"c1": F.sum("open").over(upto).cast(_BIG), "ct": F.sum("open").over(Window.partitionBy(*parents)).cast(_BIG)})
        share = F.expr("CASE WHEN full THEN cap WHEN open = 0 THEN 0 ELSE (rest * c1) div ct - (rest * (c1 - open)) div ct END")
        above = nodes.select(*here, F.least(share.cast(_BIG), F.col("cap")).alias("pool"))
    return above.drop("root").join(leaves, list(mix.levels)).select(*mix.levels, "supply", F.col("pool").cast("bigint").alias("budget"))


def select_prefixes(docs: DataFrame, mix: Mix, row: tuple[str, ...] = ()) -> DataFrame:
    """``docs(doc_id, *levels, n_tokens, *row)`` -> ``doc_id, *levels, n_tokens, epoch, take, *row``, one row a document and epoch it is read in.

    ``row``: columns that tell rows apart for the caller; they are only handed on.
    """
    scratch, leaf = Scratch(docs.sparkSession, "mix"), list(mix.levels)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias(c) for c in leaf]
    # The number of a row stands in the written table: it is the same for all later readers.
    slim = docs.select("doc_id", *named, "n_tokens", *row, F.monotonically_increasing_id().alias("_nr")).where("n_tokens > 0")
    slim = scratch.table(slim, "slim")
    leaves = scratch.table(slim.groupBy(*leaf).agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("docs")), "leaves")
    plan = allocate(leaves.drop("docs"), mix).join(leaves.select(*leaf, "docs"), leaf)
    plan = plan.select(*leaf, F.col("supply").alias("_supply"), F.col("budget").alias("_budget"), F.ceil(F.sqrt("docs")).cast("bigint").alias("_ranges"))
    plan = scratch.table(plan.where("_budget > 0"), "plan", counted=True)
    epochs = slim.join(side(plan), leaf)
    epochs = epochs.withColumn("epoch", F.explode(F.sequence(F.lit(0), ((F.col("_budget") - 1) / F.col("_supply")).cast("int"))))
    names = ["doc_id", *leaf, "n_tokens", "epoch", "take", *row]
    rest = F.col("_budget") - F.col("epoch") * F.col("_supply")
    whole = epochs.where(rest >= F.col("_supply")).withColumn("take", F.col("n_tokens")).select(*names)
    # The last epoch of each leaf is read in part: first by ranges of the order value.
    did = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("epoch").cast("string"), did))
    part = epochs.where(rest < F.col("_supply")).withColumns({"_rest": rest, "_key": key, "_did": did})
    part = part.withColumn("_range", F.expr("(cast(conv(substr(_key, 1, 8), 16, 10) AS bigint) * _ranges) div 4294967296"))
    sums = part.groupBy(*leaf, "_range").agg(F.sum("n_tokens").alias("_sum"), F.max("_rest").alias("_rest"))
    sums = sums.withColumn("_before", _sum_before("_sum", Window.partitionBy(*leaf).orderBy("_range"))).where("_before < _rest")
    sums = sums.select(*leaf, "_range", "_before", (F.col("_before") + F.col("_sum") > F.col("_rest")).alias("_ends"))
    part = part.join(side(scratch.table(sums, "ranges", counted=True)), [*leaf, "_range"])
    sure = part.where("NOT _ends").withColumn("take", F.col("n_tokens")).select(*names)
    # Then, in the range where the budget ends, by runs of rows that are equal in all that orders them.
    last = part.where("_ends")
    run = [*leaf, "_key", "_did", "n_tokens"]
    runs = last.groupBy(*run, "_before", "_rest").agg(F.count("*").alias("_c"))
    at = F.col("_before") + _sum_before(F.col("_c") * F.col("n_tokens"), Window.partitionBy(*leaf).orderBy("_key", "_did", "n_tokens"))
    runs = runs.withColumn("_left", F.col("_rest") - at).where("_left > 0")
    runs = runs.select(*run, "_left", F.ceil(F.sqrt("_c")).cast("bigint").alias("_buckets"), (F.col("_c") * F.col("n_tokens") <= F.col("_left")).alias("_whole"))
    last = last.join(side(scratch.table(runs, "runs", counted=True)), run)
    full = last.where("_whole").withColumn("take", F.col("n_tokens")).select(*names)
    # At last the rows of the one run in which the budget ends are numbered: equal rows, of which the first ones are taken.
    cut = last.where("NOT _whole").withColumn("_bucket", F.pmod(F.xxhash64("_nr"), "_buckets"))
    counts = cut.groupBy(*leaf, "_bucket").agg(F.count("*").alias("_n"))
    counts = counts.select(*leaf, "_bucket", _sum_before("_n", Window.partitionBy(*leaf).orderBy("_bucket")).alias("_first"))
    cut = cut.join(side(scratch.table(counts, "buckets", counted=True)), [*leaf, "_bucket"])
    number = F.col("_first") + F.row_number().over(Window.partitionBy(*leaf, "_bucket").orderBy("_nr")) - 1
    cut = cut.withColumn("take", F.least(F.col("n_tokens"), F.col("_left") - number * F.col("n_tokens"))).where("take > 0").select(*names)
    return whole.unionByName(sure).unionByName(full).unionByName(cut)


def _sum_before(value: Column | str, order) -> Column:
    """The sum of what comes before in ``order``."""
    return F.coalesce(F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _numbered(docs: DataFrame, scratch: Scratch, file: str = "_mix_file", row: str = "_mix_row") -> tuple[DataFrame, tuple[str, ...]]:
    """``docs`` with columns that tell its rows apart, of the names given, the same each time it is read.

    Rows of a Parquet table have their file and place; what is made by a plan is written once with numbers.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            return docs.withColumns({file: F.xxhash64("_metadata.file_path"), row: F.col("_metadata.row_index")}), (file, row)
        except AnalysisException:  # a format without places
            pass
    return scratch.table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), (row,)


def mix_documents(docs: DataFrame, mix: Mix, levels: dict[str, Column]) -> DataFrame:
    """The selected documents with all their columns, a row for each epoch, texts cut to their prefix."""
    # Names longer than any of the table's and of the plan's own.
    long = "_" * (1 + max(map(len, [*docs.columns, *levels, "n_tokens"])))
    file, place, n, take = (f"{long}{x}" for x in "frnt")
    numbered, row = _numbered(docs, Scratch(docs.sparkSession, "mix"), file, place)
    slim = numbered.select("doc_id", *(c.alias(x) for x, c in levels.items()), tokens(F.col("text")).alias("n_tokens"), *row)
    picked = select_prefixes(slim, mix, row).select(*row, F.col("n_tokens").alias(n), F.col("take").alias(take))
    text = F.when(F.col(take) < F.col(n), F.expr(f"substring_index(text, ' ', cast({take} AS int))")).otherwise(F.col("text"))
    return numbered.join(picked, list(row)).withColumn("text", text).select(*docs.columns)
