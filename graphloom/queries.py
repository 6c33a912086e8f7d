"""Queries of the graph engine over the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import cli, steps
from graphloom.functions import table_functions
from graphloom.functions.partitioner import TABULAR_PRIME, PartitionFn, plain_node, tabular_factor
from graphloom.operators import edges as E
from graphloom.operators import local, stars
from graphloom.plans.algorithms import NotConverged
from graphloom.plans.api import component_sizes, connected_components
from graphloom.plans.metrics import RunMetrics
from graphloom.plans.scratch import Scratch
from graphloom.sources.edges import edges_from, read_edges_parquet, read_edges_text, read_labels_text, write_labels_parquet, write_labels_text, write_routed

OFFSET = 1_000_000_000

#: Graph -> its edges in SQL; Spark and the oracle read the same statement over the same tables.
GRAPHS = {
    "order_part": f"SELECT l_orderkey u, {OFFSET} + l_partkey v FROM lineitem",
    "part_supp_all": f"SELECT l_partkey u, {OFFSET} + l_suppkey v FROM lineitem",
    "cust_order_star": f"SELECT o_custkey u, {OFFSET} + o_orderkey v FROM orders",
    "order_chain": "SELECT u, v FROM (SELECT o_orderkey u, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) v FROM orders) t WHERE v IS NOT NULL",
    "part_chain": "SELECT p_partkey u, p_partkey + 1 v FROM part",
    "part_block100": "SELECT p_partkey u, greatest(p_partkey - 1, p_partkey - p_partkey % 100) v FROM part",
    "supply_web": f"SELECT l_orderkey u, {OFFSET} + l_partkey v FROM lineitem UNION ALL SELECT {OFFSET} + l_partkey, {2 * OFFSET} + l_suppkey FROM lineitem",
    "wide_ids": f"SELECT {261 << 32} + 4097 * o_orderkey u, -{261 << 32} - 3 * o_custkey v FROM orders",
}
_LOOPS = f"{GRAPHS['part_supp_all']} UNION ALL SELECT s_suppkey u, s_suppkey v FROM supplier"
P8 = PartitionFn(8, "mod")


def graph(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for table in ("lineitem", "orders", "part", "supplier"):
        if f"FROM {table}" in sql:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return edges_from(spark.sql(sql), "u", "v")


def _cc_sql(edges: str, roots: bool = False, select: str = "SELECT node, label AS component FROM cc WHERE node <> label") -> str:
    extra = "SELECT u AS u, v AS v FROM e UNION SELECT v, u FROM e" if roots else "SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v"
    final = "SELECT node, label AS component FROM cc" if roots else select
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT u::BIGINT u, v::BIGINT v FROM ({edges}) s), b AS MATERIALIZED ({extra}),
 cc(node, label) USING KEY (node) AS (SELECT u, least(u, min(v)) FROM b GROUP BY u
  UNION SELECT r.node, x.l FROM (SELECT b.u AS node, min(cc.label) AS l FROM cc JOIN b ON b.v = cc.node GROUP BY b.u) x JOIN recurring.cc r ON r.node = x.node WHERE x.l < r.label)
{final}"""


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str | None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _components(name: str, source: str, **options) -> None:
    roots = options.get("include_roots", False)
    _add(name, _cc_sql(GRAPHS[source], roots))(lambda spark, d: connected_components(graph(spark, d, GRAPHS[source]), **options))


_components("cc_pa_full", "order_part", algorithm="pa_full", num_partitions=8)
_components("cc_pa_filtered", "order_part", algorithm="pa_filtered", num_partitions=8, local_threshold=0)
_components("cc_pa_base", "order_part", algorithm="pa_base", num_partitions=8, local_threshold=0)
_components("cc_alternating", "order_part", algorithm="alternating")
_components("cc_alternating_hub", "order_part", algorithm="alternating_hub", num_partitions=8)
_components("cc_union_find", "order_part", algorithm="union_find")
_components("cc_all_nodes", "order_part", include_roots=True)
_components("cc_local_gate", "order_part", local_threshold=1_000_000)
_components("cc_no_gate", "order_part", num_partitions=8, local_threshold=0)
_components("cc_single_giant", "part_supp_all")
_components("cc_star_forest", "cust_order_star")
_components("cc_chains", "order_chain")
_components("cc_blocks", "part_chain")
# The whole plan, rounds and all, over every shape.
_components("cc_rounds_web", "supply_web", num_partitions=8, local_threshold=0)
_components("cc_rounds_stars", "cust_order_star", num_partitions=8, local_threshold=0, include_roots=True)
_components("cc_rounds_chains", "order_chain", num_partitions=4, local_threshold=0, partition_fn="tabular")
_components("cc_rounds_path", "part_chain", num_partitions=8, local_threshold=0, partition_fn="mod")
_components("cc_rounds_wide", "wide_ids", algorithm="pa_filtered", num_partitions=8, local_threshold=0, partition_fn="long_hash")


def _one_round(name: str, source: str, sql: str, step: Callable[[DataFrame], DataFrame]) -> None:
    edges = GRAPHS.get(source, source)
    _add(name, f"WITH e AS MATERIALIZED (SELECT u::BIGINT u, v::BIGINT v FROM ({edges}) s), {sql}")(lambda spark, d: step(graph(spark, d, edges)))


def _half_round(step: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A star as the plans run it: one job, sized by the edges, that writes a scratch table."""
    return lambda e: Scratch(e.sparkSession, "half").table(step(e), "half", work=e.count())


_NB = "nb AS (SELECT u g, v x FROM e UNION SELECT v, u FROM e)"
_DOWN = "nb AS (SELECT DISTINCT u g, v x FROM e2)"
_MCU = "mcu AS (SELECT g, q, min(x) m FROM (SELECT g, x, x % 8 q FROM nb UNION ALL SELECT DISTINCT g, g, g % 8 FROM nb) GROUP BY g, q)"
_A = "a AS (SELECT g, least(g, min(x)) mu FROM nb GROUP BY g)"
_LARGE = f"{_NB}, {_A}, e2 AS MATERIALIZED (SELECT x u, mu v FROM nb JOIN a USING (g) WHERE x > g)"
_T = "CASE WHEN m <> x THEN m ELSE mu END"

_one_round("op_mirror", _LOOPS, "r AS (SELECT u g, v x FROM e UNION ALL SELECT v, u FROM e) SELECT * FROM r", E.mirror)
_one_round("op_canonical_edges", _LOOPS, "r AS (SELECT DISTINCT least(u, v) u, greatest(u, v) v FROM e WHERE u <> v) SELECT * FROM r", E.canonical)
_one_round("op_drop_self_loops", _LOOPS, "r AS (SELECT * FROM e WHERE u <> v) SELECT * FROM r", E.drop_self_loops)
_one_round("op_large_star", "order_part", f"{_NB}, {_A} SELECT x u, mu v, mu <> g ch FROM nb JOIN a USING (g) WHERE x > g", _half_round(stars.large_star))
_one_round(
    "op_small_star",
    "order_part",
    f"{_LARGE}, nb2 AS (SELECT DISTINCT u g, v x FROM e2), a2 AS (SELECT g, min(x) mu FROM nb2 GROUP BY g) SELECT x u, mu v, true ch FROM nb2 JOIN a2 USING (g) WHERE x <> mu UNION ALL SELECT g, mu, false FROM a2",
    _half_round(lambda e: stars.small_star(stars.large_star(e))),
)
_one_round(
    "op_pa_large_star",
    "order_part",
    f"{_NB}, {_MCU}, {_A} SELECT x u, {_T} v, ({_T}) <> nb.g ch FROM nb JOIN a ON a.g = nb.g JOIN mcu ON mcu.g = nb.g AND mcu.q = nb.x % 8 WHERE x > nb.g",
    _half_round(lambda e: stars.pa_large_star(e, P8)),
)
_one_round(
    "op_pa_small_star",
    "order_part",
    f"e2 AS MATERIALIZED (SELECT v u, u v FROM e), {_DOWN}, {_MCU}, a AS (SELECT g, min(x) mu FROM nb GROUP BY g), y AS (SELECT g, x FROM nb UNION ALL SELECT DISTINCT g, g FROM nb) "
    f"SELECT x u, {_T} v, x <> y.g ch FROM y JOIN a ON a.g = y.g JOIN mcu ON mcu.g = y.g AND mcu.q = y.x % 8 WHERE x <> mu",
    _half_round(lambda e: stars.pa_small_star(e.select(F.col("v").alias("u"), F.col("u").alias("v")), P8)),
)


def _flagged(e: DataFrame) -> DataFrame:
    return e.select("u", "v", (F.col("v") % 3 == 0).alias("leaf"))


_LEAFY = "el AS MATERIALIZED (SELECT u, v, v % 3 = 0 leaf FROM e), nb AS (SELECT u g, v x, false leaf FROM el WHERE NOT leaf UNION SELECT v, u, leaf FROM el)"
_one_round(
    "op_filter_large_routes",
    "order_part",
    f"{_LEAFY}, {_MCU}, a AS (SELECT g, least(g, min(x)) mu, bool_and(leaf) star FROM nb GROUP BY g) "
    f"SELECT x u, CASE WHEN star THEN nb.g ELSE {_T} END v, false leaf, CASE WHEN star THEN 'cc' WHEN m <> x AND leaf THEN 'in' ELSE 'out' END route, (NOT star) AND ({_T}) <> nb.g ch "
    "FROM nb JOIN a ON a.g = nb.g JOIN mcu ON mcu.g = nb.g AND mcu.q = nb.x % 8 WHERE x > nb.g",
    _half_round(lambda e: stars.pa_large_star_routed(_flagged(e), P8)),
)
_one_round(
    "op_filter_small_routes",
    "order_part",
    f"{_NB}, {_MCU}, a AS (SELECT g, least(g, min(x)) mu, max(x) <= g leaf FROM nb GROUP BY g) "
    f"SELECT x u, {_T} v, false leaf, 'out' route, true ch FROM nb JOIN a ON a.g = nb.g JOIN mcu ON mcu.g = nb.g AND mcu.q = nb.x % 8 WHERE x < nb.g AND x <> mu UNION ALL "
    "SELECT a.g, CASE WHEN m <> a.g THEN m ELSE mu END, m = a.g AND a.leaf, CASE WHEN m <> a.g AND a.leaf THEN 'in' ELSE 'out' END, false FROM a JOIN mcu ON mcu.g = a.g AND mcu.q = a.g % 8 WHERE a.g <> mu",
    _half_round(lambda e: stars.pa_small_star_routed(e, P8)),
)
_one_round(
    "op_localization",
    "cust_order_star",
    "k AS (SELECT DISTINCT v u, u v, v % 8 q FROM e), a AS (SELECT v, q, min(u) m FROM k GROUP BY v, q) SELECT k.u, CASE WHEN k.u <> a.m THEN a.m ELSE k.v END v FROM k JOIN a ON a.v = k.v AND a.q = k.q",
    _half_round(lambda e: stars.localize(e.select(F.col("v").alias("u"), F.col("u").alias("v")), P8)),
)
_one_round(
    "op_star_group",
    "part_supp_all",
    f"{_NB}, r AS (SELECT g, x, (row_number() OVER (PARTITION BY g ORDER BY x) - 1) // 16 chunk FROM nb) SELECT g node, chunk, array_to_string(list_sort(list(x)), ',') neighbours FROM r GROUP BY g, chunk",
    lambda e: E.star_group(e, 16).withColumn("neighbours", F.array_join("neighbours", ",")),
)
_one_round("op_degree", "part_supp_all", f"{_NB} SELECT g node, count(*) AS degree FROM nb GROUP BY g", E.degrees)
_one_round("op_hub_nodes", "part_supp_all", f"{_NB} SELECT g node, count(*) AS degree FROM nb GROUP BY g HAVING count(*) > 16", lambda e: E.hubs(e, 16))
_one_round(
    "op_hub_split",
    "part_supp_all",
    f"{_NB}, h AS (SELECT g FROM nb GROUP BY g HAVING count(*) > 16) SELECT DISTINCT least(u, v) a, greatest(u, v) b, h.g IS NOT NULL sp, CASE WHEN h.g IS NOT NULL THEN greatest(u, v) % 8 ELSE -1 END ci FROM e LEFT JOIN h ON h.g = least(u, v) WHERE u <> v",
    lambda e: _hub_split(e),
)
_one_round(
    "op_hub_large_star",
    "part_supp_all",
    f"{_NB}, ag AS (SELECT g, least(g, min(x)) mu, count(*) d FROM nb GROUP BY g) SELECT x u, CASE WHEN g = mu THEN g ELSE mu END v, g = mu AND d > 8 hi, g <> mu ch FROM nb JOIN ag USING (g) WHERE x > g",
    _half_round(lambda e: stars.hub_large_star(stars.to_hub_edges(e), 8).select(F.col("u.id").alias("u"), F.col("v.id").alias("v"), "hi", "ch")),
)
_one_round(
    "op_hub_small_star",
    "part_supp_all",
    "nb AS (SELECT DISTINCT v g, u x FROM e), ag AS (SELECT g, min(x) mu FROM nb GROUP BY g), y AS (SELECT g, x FROM nb UNION ALL SELECT DISTINCT g, g FROM nb) SELECT x u, mu v, false hi, x <> y.g ch FROM y JOIN ag USING (g) WHERE x <> mu",
    _half_round(lambda e: stars.hub_small_star(stars.to_hub_edges(e.select(F.col("v").alias("u"), F.col("u").alias("v")))).select(F.col("u.id").alias("u"), F.col("v.id").alias("v"), "hi", "ch")),
)
_one_round(
    "op_hub_copies",
    "part_supp_all",
    # A plain node is id * 100, its copy k id * 100 + 10 + k: they sort as the structs do.
    f"{_NB}, h AS (SELECT g FROM nb GROUP BY g HAVING count(*) > 16), o AS (SELECT DISTINCT least(u, v) a, greatest(u, v) b FROM e WHERE u <> v), "
    "s AS (SELECT a * 100 a, b * 100 b, a * 100 + 10 + b % 8 k, h.g IS NOT NULL sp FROM o LEFT JOIN h ON h.g = o.a), "
    "nh AS (SELECT a g, b x FROM s WHERE NOT sp UNION SELECT b, a FROM s WHERE NOT sp UNION SELECT a, k FROM s WHERE sp UNION SELECT k, b FROM s WHERE sp), "
    "ag AS (SELECT g, least(g, min(x)) mu, count(*) d FROM nh GROUP BY g) "
    "SELECT x u, CASE WHEN g // 100 = mu // 100 THEN g ELSE mu END v, g // 100 = mu // 100 AND d > 8 AND g % 100 = 0 hi, g // 100 <> mu // 100 ch FROM nh JOIN ag USING (g) WHERE x > g",
    _half_round(lambda e: _hub_copies(e)),
)
_one_round("op_partition_min", "cust_order_star", f"{_NB}, {_MCU} SELECT g, q, m FROM mcu", lambda e: E.partition_minimum(E.neighbours(e), P8))
_one_round("op_group_min", "cust_order_star", f"{_NB}, {_A} SELECT g, mu FROM a", lambda e: E.group_minimum(E.neighbours(e)))
_one_round(
    "op_partition_id",
    "cust_order_star",
    "r AS (SELECT u, u % 8 p_mod, u % 8 p_long_hash FROM e) SELECT DISTINCT * FROM r",
    lambda e: e.select("u", P8(F.col("u")).alias("p_mod"), PartitionFn(8, "long_hash")(F.col("u")).alias("p_long_hash")).distinct(),
)
_TAB = " ".join(f"t{i} AS (SELECT *, ((((u >> {16 * i}) & 65535) + 1) * {tabular_factor(i)}) % {TABULAR_PRIME} y{i} FROM {f't{i - 1}' if i else 'e'})," for i in range(4))
_one_round(
    "op_tabular_partition",
    "cust_order_star",
    f"{_TAB} r AS (SELECT DISTINCT u, xor(xor((y0 * y0 + (u & 65535)) % {TABULAR_PRIME}, (y1 * y1 + ((u >> 16) & 65535)) % {TABULAR_PRIME}), "
    f"xor((y2 * y2 + ((u >> 32) & 65535)) % {TABULAR_PRIME}, (y3 * y3 + ((u >> 48) & 65535)) % {TABULAR_PRIME})) % 8 p FROM t3) SELECT * FROM r",
    lambda e: e.select("u", PartitionFn(8, "tabular")(F.col("u")).alias("p")).distinct(),
)
_one_round(
    "op_long_hash",
    "wide_ids",
    "f AS (SELECT u, xor(u, u >> 32) & 4294967295 h FROM e), "
    "r AS (SELECT DISTINCT u, ((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 8 + 8) % 8 p FROM f) SELECT * FROM r",
    lambda e: e.select("u", PartitionFn(8, "long_hash")(F.col("u")).alias("p")).distinct(),
)
_one_round("op_is_star", "order_part", f"{_LEAFY} SELECT g node, bool_and(leaf) star FROM nb GROUP BY g", lambda e: E.is_star(_flagged(e)))
_one_round("op_is_leaf", "order_part", f"{_NB} SELECT g node, max(x) <= g leaf FROM nb GROUP BY g", E.is_leaf)
_one_round("op_distinct_pairs", "part_supp_all", "r AS (SELECT DISTINCT u node, v component FROM e) SELECT * FROM r", lambda e: E.distinct_pairs(e.toDF("node", "component")))
_one_round("op_union_filtered", "part_supp_all", "r AS (SELECT * FROM e WHERE u % 2 = 0 UNION ALL SELECT * FROM e WHERE u % 2 = 1) SELECT * FROM r", lambda e: E.union_edges(e.where("u % 2 = 0"), e.where("u % 2 = 1")))


def _hub_split(e: DataFrame) -> DataFrame:
    """Edges of the graph with hubs above 16 neighbours flagged, split over 8 copies."""
    hubs = E.hubs(e, 16).select(F.col("node").alias("h"))
    least = e.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).join(hubs, F.col("a") == F.col("h"), "left")
    rows = stars.hub_split(least.select(plain_node(F.col("a")).alias("u"), plain_node(F.col("b")).alias("v"), F.col("h").isNotNull().alias("hi")), 8)
    return rows.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "sp", F.when(F.col("sp"), F.col("k.ci")).otherwise(-1).alias("ci")).distinct()


def _hub_copies(e: DataFrame) -> DataFrame:
    """One large star over edges whose hubs are flagged, so that copies stand in; ends as numbers."""
    hubs = E.hubs(e, 16).select(F.col("node").alias("h"))
    flagged = e.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).join(hubs, F.col("a") == F.col("h"), "left")
    rows = stars.hub_large_star(flagged.select(plain_node(F.col("a")).alias("u"), plain_node(F.col("b")).alias("v"), F.col("h").isNotNull().alias("hi")), 8)
    number = lambda c: F.col(f"{c}.id") * 100 + F.col(f"{c}.cp") * 10 + F.col(f"{c}.ci")
    return rows.select(number("u").alias("u"), number("v").alias("v"), "hi", "ch")


@_add("op_cc_computation", _cc_sql(GRAPHS["part_block100"]))
def _cc_computation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part, linked to the one before it in its block of 100 (the first to itself). Blocks are closed under ``id div 100``, so one local solve a partition is whole."""
    edges = graph(spark, sf_dir, GRAPHS["part_block100"])
    return local.cc_computation(edges, BlockFn(100, 8))


class BlockFn:
    """Partition by blocks of ids."""

    def __init__(self, width: int, parts: int):
        self.width, self.parts = width, parts

    def __call__(self, node):
        return F.pmod(F.floor(node / self.width), F.lit(self.parts).cast("bigint"))


@_add("op_local_components", _cc_sql(GRAPHS["part_block100"]))
def _local_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function over blocks of parts, called by SQL."""
    table_functions.register(spark)
    graph(spark, sf_dir, GRAPHS["part_block100"]).createOrReplaceTempView("part_block100")
    return spark.sql("SELECT node, component FROM local_components(TABLE(SELECT u, v, u DIV 100 AS block FROM part_block100) PARTITION BY block)")


@_add("cc_resumed", _cc_sql(GRAPHS["supply_web"]))
def _resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that gives up after its first round, if it needs more, gone on with under its name."""
    edges, name = graph(spark, sf_dir, GRAPHS["supply_web"]), f"resumed-{uuid.uuid4().hex[:12]}"
    try:
        connected_components(edges, "pa_filtered", 8, 0, max_rounds=1, resume=name)
    except NotConverged:
        pass
    return connected_components(edges, "pa_filtered", 8, 0, resume=name)


@_add("op_text_roundtrip", f"SELECT u::BIGINT node, v::BIGINT component FROM ({GRAPHS['part_supp_all']}) s")
def _text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'text').root}/labels"
    write_labels_text(graph(spark, sf_dir, GRAPHS["part_supp_all"]).toDF("node", "component"), path)
    return read_labels_text(spark, path)


@_add("op_text_malformed", f"SELECT u::BIGINT u, v::BIGINT v FROM ({GRAPHS['order_part']}) s")
def _text_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge lines in a loose layout, each followed by a line that is none; only the edges come back."""
    path = f"{Scratch(spark, 'text').root}/edges"
    e = graph(spark, sf_dir, GRAPHS["order_part"])
    e.select(F.explode(F.array(F.concat(F.lit(" \t"), "u", F.lit(" \t "), "v", F.lit(" ignored\r")), F.concat(F.lit("x"), "u"))).alias("value")).write.text(path)
    return read_edges_text(spark, path, mode="DROPMALFORMED")


@_add("agg_component_sizes", _cc_sql(GRAPHS["order_part"], select="SELECT label AS component, count(*) AS size FROM cc GROUP BY label"))
def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_sizes(connected_components(graph(spark, sf_dir, GRAPHS["order_part"])))


@_add("op_sketch", _cc_sql(GRAPHS["part_supp_all"]))
def _sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of the sketch, which must be the whole graph's; the forest itself depends on the input's splits."""
    return connected_components(local.sketch(graph(spark, sf_dir, GRAPHS["part_supp_all"])), "alternating")


def _edges_sql(source: str, names: str = "u, v") -> str:
    u, v = names.split(", ")
    return f"SELECT u::BIGINT {u}, v::BIGINT {v} FROM ({GRAPHS[source]}) s"


def _text(e: DataFrame, path: str) -> str:
    e.select(F.concat_ws(" ", "u", "v").alias("value")).write.text(path)
    return path


@_add("op_text_to_parquet", _edges_sql("order_chain"))
def _text_to_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark, "text").root
    steps.convert_text(spark, _text(graph(spark, sf_dir, GRAPHS["order_chain"]), f"{root}/edges"), f"{root}/converted")
    return read_edges_parquet(spark, f"{root}/converted", glob="part*")


@_add("op_text_many_paths", f"{_edges_sql('order_chain')} UNION ALL {_edges_sql('cust_order_star')}")
def _text_many_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark, "text").root
    return read_edges_text(spark, *(_text(graph(spark, sf_dir, GRAPHS[g]), f"{root}/{g}") for g in ("order_chain", "cust_order_star")), glob="part*")


@_add("op_part_files", _edges_sql("order_chain"))
def _part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder in which files of other names stand beside the ``part`` files."""
    root = Scratch(spark, "text").root
    edges = _text(graph(spark, sf_dir, GRAPHS["order_chain"]), f"{root}/edges")
    other = _text(graph(spark, sf_dir, GRAPHS["cust_order_star"]).coalesce(1), f"{root}/other")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for i, found in enumerate(files.globStatus(path(f"{other}/part*"))):
        files.rename(found.getPath(), path(f"{edges}/side-{i}"))
    return read_edges_text(spark, edges, glob="part*")


@_add("op_routed_folders", SQL["op_filter_large_routes"])
def _routed_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'routes').root}/routed"
    write_routed(QUERIES["op_filter_large_routes"](spark, sf_dir), path)
    return spark.read.parquet(path).select("u", "v", "leaf", "route", "ch")


@_add("op_labels_parquet", _edges_sql("part_supp_all", "node, component"))
def _labels_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'labels').root}/labels"
    write_labels_parquet(graph(spark, sf_dir, GRAPHS["part_supp_all"]).toDF("node", "component"), path)
    return spark.read.parquet(path)


@_add("op_standalone_text", _cc_sql(GRAPHS["order_chain"], roots=True))
def _standalone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text edges to text labels of every node, roots too, solved in one task where they are few."""
    root = Scratch(spark, "text").root
    steps.label_text(spark, _text(graph(spark, sf_dir, GRAPHS["order_chain"]), f"{root}/edges"), f"{root}/labels")
    return read_labels_text(spark, f"{root}/labels")


@_add("op_command_line", _cc_sql(GRAPHS["cust_order_star"]))
def _command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of the command line, text to text."""
    root = Scratch(spark, "text").root
    cli.main([_text(graph(spark, sf_dir, GRAPHS["cust_order_star"]), f"{root}/edges"), f"{root}/labels", "-a", "pa_full", "-p", "4", "-t", "0", "--partition-fn", "tabular", "-q"], spark)
    return read_labels_text(spark, f"{root}/labels")


_ROUND = f"""WITH e AS MATERIALIZED (SELECT u::BIGINT u, v::BIGINT v FROM ({GRAPHS["order_part"]}) s WHERE u <> v), {_NB}, {_MCU}, {_A},
 large AS MATERIALIZED (SELECT x u, {_T} v, ({_T}) <> nb.g ch FROM nb JOIN a ON a.g = nb.g JOIN mcu ON mcu.g = nb.g AND mcu.q = nb.x % 8 WHERE x > nb.g),
 nb2 AS MATERIALIZED (SELECT u g, v x FROM large UNION SELECT v, u FROM large), a2 AS (SELECT g, least(g, min(x)) mu, max(x) <= g low FROM nb2 GROUP BY g),
 m2 AS (SELECT g, q, min(x) m FROM (SELECT g, x, x % 8 q FROM nb2 UNION ALL SELECT DISTINCT g, g, g % 8 FROM nb2) GROUP BY g, q),
 small AS (SELECT 'out' route, true ch FROM nb2 JOIN a2 USING (g) WHERE x < g AND x <> mu
   UNION ALL SELECT CASE WHEN m <> a2.g AND low THEN 'in' ELSE 'out' END, false FROM a2 JOIN m2 ON m2.g = a2.g AND m2.q = a2.g % 8 WHERE a2.g <> mu)
SELECT 0::BIGINT round, (SELECT count(*) FROM large) lout, 0::BIGINT lcc, 0::BIGINT lin, (SELECT count(*) FROM small WHERE route = 'out') sout, (SELECT count(*) FROM small WHERE route = 'in') sin,
 (SELECT count(*) FROM large WHERE ch) lchange, (SELECT count(*) FROM small WHERE ch) schange"""


@_add("op_round_metrics", _ROUND)
def _round_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the first round of the filtered plan, over all edges; the rounds after it have no part in them and do not run."""
    metrics = RunMetrics("", 0, 0)
    try:
        connected_components(graph(spark, sf_dir, GRAPHS["order_part"]), "pa_filtered", 8, 0, partition_fn="mod", max_rounds=1, metrics=metrics, every_edge=True)
    except NotConverged:
        pass
    return metrics.rounds_df(spark).where("round = 0")


@_add("op_run_metrics", "SELECT 'alternating' app, 'customers and orders' input, 0::BIGINT threshold, 4::BIGINT partitions, 1::BIGINT rounds, count(*)::BIGINT kept, true timed FROM orders")
def _run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a run over finished stars, which ends after one round."""
    metrics = RunMetrics("", 0, 0, input="customers and orders")
    connected_components(graph(spark, sf_dir, GRAPHS["cust_order_star"]), "alternating", 4, 0, metrics=metrics)
    app, source, threshold, partitions, rounds, *seconds = metrics.row().split("\t")
    timed = abs(sum(map(float, seconds[:3])) - float(seconds[3])) < 0.01
    row = (app, source, int(threshold), int(partitions), int(rounds), metrics.rounds[-1].sout, timed)
    return spark.createDataFrame([row], "app string, input string, threshold long, partitions long, rounds long, kept long, timed boolean")
