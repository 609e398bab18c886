"""Graphs, workloads, points and paths that are derived from the star-schema test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..plans.stable import run_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_nodes(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "customer").count()


def road_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, u, v, w): a routing graph of customers, an arc for each order."""
    o, n = table(spark, sf_dir, "orders"), n_nodes(spark, sf_dir)
    return o.select(F.col("o_orderkey").alias("line"), (F.col("o_custkey") + 1).alias("u"), (1 + (F.col("o_orderkey") * 7919) % n).alias("v"), (1 + F.floor(F.col("o_totalprice") / 1000)).cast("double").alias("w"))


def road_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_undirected(road_arcs(spark, sf_dir))


def road_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: every order whose key is divisible by 20, against the whole graph."""
    o, n = table(spark, sf_dir, "orders").where("o_orderkey % 20 = 0"), n_nodes(spark, sf_dir)
    return o.select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") + 1).alias("origin"), (1 + (F.col("o_orderkey") * 31) % n).alias("destination"), (1 + F.col("o_orderkey") % 3).alias("count"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, lon, lat) for 1..C; coordinates by arithmetic on the id."""
    ids = spark.range(1, n_nodes(spark, sf_dir) + 1).withColumnRenamed("id", "node")
    return ids.select("node", ((F.col("node") * 7919 % 100_003) / F.lit(1000.0)).alias("lon"), ((F.col("node") * 104_729 % 100_003) / F.lit(1000.0)).alias("lat"))


def merge_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, u, v, w): arcs of few nodes with loops, repeats and opposites, one for each line item."""
    s = table(spark, sf_dir, "supplier").count()
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), (F.col("l_partkey") % s + 1).alias("u"), (F.col("l_suppkey") + 1).alias("v"), (F.col("l_quantity") % 5).cast("double").alias("w"))


def merge_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with gaps between their ids, so that some edges hang loose: 1, 2, 4, 5, 7, .."""
    return table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + F.floor(F.col("s_suppkey") / 2) + 1).alias("id"))


def text_files(lines: DataFrame, compression: str | None = None) -> str:
    """Write lines (column value) as text files into the shared folder; the path."""
    path = folder(lines.sparkSession)
    lines.select("value").write.text(path, compression=compression)
    return path


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{run_folder(spark)}/files-{uuid.uuid4().hex}"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") + 1).alias("node"), F.col("embedding")[0].cast("double").alias("lon"), F.col("embedding")[1].cast("double").alias("lat"))


#: Line items of a task whose paths and window pairs it holds.
ITEMS_PER_TASK = 250_000


def line_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, nodes): a path for each order, over its line items in order.

    Tasks grow in number with the items, not in size: the pairs of a query are counted where its path was made.
    """
    li = table(spark, sf_dir, "lineitem")
    li = li.repartition(max(1, -(-li.count() // ITEMS_PER_TASK)), "l_orderkey")
    step = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", (1 + F.col("l_partkey") % 300).alias("node"))
    return li.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.sort_array(F.collect_list(step)).alias("s")).select("query_id", F.col("s.node").alias("nodes"))


def kept_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered edges, which stand in a table."""
    return road_graph(spark, sf_dir)


# The same derivations as SQL.

ARCS = """arcs AS (SELECT o_orderkey AS line, o_custkey + 1 AS u, 1 + (o_orderkey * 7919) % (SELECT count(*) FROM customer) AS v,
  CAST(1 + floor(o_totalprice / 1000) AS DOUBLE) AS w FROM orders)"""
UND = f"""{ARCS}, und AS (SELECT row_number() OVER (ORDER BY first, src, dst, weight) - 1 AS edge_index, src, dst, weight
  FROM (SELECT least(u, v) AS src, greatest(u, v) AS dst, w AS weight, min(line) AS first FROM arcs GROUP BY 1, 2, 3))"""
ADJ = f"""{UND}, adj AS (SELECT src AS u, dst AS v, weight AS w, edge_index FROM und UNION ALL SELECT dst, src, weight, edge_index FROM und)"""
QUERIES = """q AS (SELECT o_orderkey AS query_id, o_custkey + 1 AS origin, 1 + (o_orderkey * 31) % (SELECT count(*) FROM customer) AS destination,
  1 + o_orderkey % 3 AS count FROM orders WHERE o_orderkey % 20 = 0)"""
UNIVERSE = """nodes AS (SELECT n AS node, (n * 7919 % 100003) / 1000.0::DOUBLE AS lon, (n * 104729 % 100003) / 1000.0::DOUBLE AS lat
  FROM (SELECT unnest(range(1, (SELECT count(*) FROM customer) + 1)) AS n))"""
SHORTEST = """sp(src, node, d) USING KEY (src, node) AS (
  SELECT DISTINCT origin, origin, CAST(0 AS DOUBLE) FROM q
  UNION
  SELECT s.src, e.v, min(s.d + e.w) FROM sp s JOIN adj e ON e.u = s.node LEFT JOIN recurring.sp r ON r.src = s.src AND r.node = e.v
  WHERE r.d IS NULL OR s.d + e.w < r.d GROUP BY 1, 2)"""
WALK = """walk AS (
  SELECT q.query_id, q.count, q.origin, q.destination AS node, sp.d, 0 AS back FROM q JOIN sp ON sp.src = q.origin AND sp.node = q.destination
  UNION ALL
  SELECT x.query_id, x.count, x.origin, x.prev, s.d, x.back + 1 FROM (
    SELECT k.*, (SELECT min(e.u) FROM adj e JOIN sp p ON p.src = k.origin AND p.node = e.u WHERE e.v = k.node AND e.u <> k.node AND p.d + e.w = k.d) AS prev
    FROM walk k WHERE k.node <> k.origin) x JOIN sp s ON s.src = x.origin AND s.node = x.prev)"""
TRACED = f"WITH RECURSIVE {ADJ}, {QUERIES}, {SHORTEST}, {WALK}"
STEPS = """steps AS (SELECT a.query_id, a.count, a.back, und.edge_index FROM walk a JOIN walk b ON a.query_id = b.query_id AND b.back = a.back + 1
  JOIN und ON und.src = least(a.node, b.node) AND und.dst = greatest(a.node, b.node) AND und.weight = a.d - b.d)"""
MERGE_ARCS = """garcs AS (SELECT l_orderkey * 100 + l_linenumber AS seq, l_partkey % (SELECT count(*) FROM supplier) + 1 AS u, l_suppkey + 1 AS v, CAST(l_quantity % 5 AS DOUBLE) AS w FROM lineitem)"""
MERGED = f"""{MERGE_ARCS}, buckets AS (SELECT least(u, v) AS a, greatest(u, v) AS b, w, bool_or(u < v) AS up, bool_or(u > v) AS down, min(seq) AS seq FROM garcs WHERE u <> v GROUP BY 1, 2, 3),
gedges AS (SELECT CASE WHEN up THEN a ELSE b END AS from_point, CASE WHEN up THEN b ELSE a END AS to_point, w AS value, NOT (up AND down) AS directed, seq FROM buckets),
gpoints AS (SELECT s_suppkey + s_suppkey // 2 + 1 AS id FROM supplier)"""
INCIDENT = f"""{MERGED}, linked AS (SELECT * FROM gedges WHERE from_point IN (SELECT id FROM gpoints) AND to_point IN (SELECT id FROM gpoints)),
inc AS (SELECT from_point AS node, to_point AS other, value, directed, true AS is_out, NOT directed AS is_in, seq FROM linked
  UNION ALL SELECT to_point, from_point, value, directed, NOT directed, true, seq FROM linked)"""
POINTS = "pts AS (SELECT vec_id + 1 AS node, CAST(embedding[1] AS DOUBLE) AS lon, CAST(embedding[2] AS DOUBLE) AS lat FROM embeddings)"
LINE_PATHS = """lp AS (SELECT l_orderkey AS query_id, 1 + l_partkey % 300 AS node,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos FROM lineitem)"""
WINDOWS = f"""{LINE_PATHS}, win AS (SELECT a.query_id, least(a.node, b.node) AS node_i, greatest(a.node, b.node) AS node_j, b.pos - a.pos AS window_distance
  FROM lp a JOIN lp b ON a.query_id = b.query_id AND b.pos > a.pos AND b.pos <= a.pos + 3 WHERE a.node <> b.node),
pc AS (SELECT node_i, node_j, count(*) AS cooccur_count, count(DISTINCT query_id) AS query_count, sum(1.0::DOUBLE / window_distance) AS decay FROM win GROUP BY 1, 2)"""
