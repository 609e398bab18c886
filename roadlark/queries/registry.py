"""A query, and SQL for it, for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draw_sql, uniform_sql
from ..operators import frequency, graph, layers, overlay, pairs, paths, workload
from ..plans.stable import kept, stable
from ..plans import frequency_samples as plans
from ..sources import declared_counts, numbered_lines, points_universe, read_arcs, read_edge_samples, read_edges, read_hotspots, read_node_samples, read_nodes, read_points, read_queries, read_roads, read_unit_edges, scale_paths, write_table
from . import derive as d

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Sources


def _file(df: DataFrame, *parts, head: tuple[str, ...], compression: str | None = None) -> str:
    """Lines of text, written to the shared folder as files."""
    lines = df.select(F.concat_ws(" ", *parts).alias("value"))
    return d.text_files(df.sparkSession.createDataFrame([(h,) for h in head], "value string").unionByName(lines), compression)


def _arc_file(spark, sf_dir, compression=None) -> str:
    n, m = d.n_nodes(spark, sf_dir), d.table(spark, sf_dir, "orders").count()
    return _file(d.road_arcs(spark, sf_dir), F.lit("a"), "u", "v", F.col("w").cast("long").cast("string"), head=("c sample", f"p sp {n} {m}"), compression=compression)


@query(f"WITH {d.POINTS} SELECT node AS id, floor(lon * 1e6) / 1e6 AS x_loc, floor(lat * 1e6) / 1e6 AS y_loc FROM pts")
def points_scan_scaled(spark, sf_dir):
    micro = lambda c: F.floor(F.col(c) * 1e6).cast("string")
    path = _file(d.points(spark, sf_dir), F.lit("v"), "node", micro("lon"), micro("lat"), head=("c sample", "p aux sp co 3"))
    return read_points(spark, path, allow_empty=False).select("id", "x_loc", "y_loc")


@query(f"WITH {d.ARCS} SELECT u, v, w FROM arcs")
def arcs_scan(spark, sf_dir):
    path = _file(d.road_arcs(spark, sf_dir), F.lit("a"), "u", "v", F.col("w").cast("long").cast("string"), head=("c sample", "p sp 3 2"))
    return read_arcs(spark, path).select("u", "v", "w")


@query(f"WITH {d.ARCS} SELECT u, v, 1.0::DOUBLE AS w FROM arcs")
def unit_edges_scan(spark, sf_dir):
    return read_unit_edges(spark, _file(d.road_arcs(spark, sf_dir), "u", "v", head=("# FromNodeId ToNodeId",))).select("u", "v", "w")


@query(f"WITH {d.UND} SELECT 'arcs' AS kind, (SELECT count(*) FROM customer) AS n, (SELECT count(*) FROM orders) AS m")
def header_counts(spark, sf_dir):
    n, m = d.n_nodes(spark, sf_dir), d.table(spark, sf_dir, "orders").count()
    path = _file(d.road_arcs(spark, sf_dir), F.lit("a"), "u", "v", F.col("w").cast("long").cast("string"), head=("c sample", f"p sp {n} {m}"))
    return declared_counts(numbered_lines(spark, path))


@query(
    f"""WITH {d.POINTS}, part_of AS (SELECT node + node // 3 AS node, lon, lat FROM pts),
    last AS (SELECT node, max(lon) AS lon, max(lat) AS lat FROM part_of GROUP BY 1)
    SELECT n AS node, coalesce(lon, 0.0) AS lon, coalesce(lat, 0.0) AS lat FROM (SELECT unnest(range(1, (SELECT max(node) FROM part_of) + 1)) AS n) LEFT JOIN last ON node = n"""
)
def points_universe_filled(spark, sf_dir):
    p = d.points(spark, sf_dir).withColumn("node", F.expr("node + node DIV 3"))
    early = p.select(F.col("node").alias("id"), F.lit(-1.0).alias("x_loc"), F.lit(-1.0).alias("y_loc"), F.lit(0).alias("line"))
    late = p.select(F.col("node").alias("id"), F.col("lon").alias("x_loc"), F.col("lat").alias("y_loc"), F.lit(1).alias("line"))
    return points_universe(early.unionByName(late))


@query(f"WITH {d.ARCS} SELECT u, v, w FROM arcs")
def arcs_scan_gzip(spark, sf_dir):
    return read_arcs(spark, _arc_file(spark, sf_dir, "gzip")).select("u", "v", "w")


@query(f"WITH {d.ARCS} SELECT u, v, w FROM arcs")
def arcs_source(spark, sf_dir):
    """By the data source, files cut into ranges of 64 KB."""
    return read_roads(spark, _arc_file(spark, sf_dir), "arcs", 1 << 16).select("u", "v", "w")


@query("SELECT 'a' AS tag, count(*) AS n FROM orders UNION ALL SELECT 'p', 1")
def line_tags_source(spark, sf_dir):
    """Lines by tag; the filter on tags is done in the scan."""
    lines = read_roads(spark, _arc_file(spark, sf_dir), "lines", 1 << 16).where(F.col("tag").isin("a", "p"))
    return lines.groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT 'arcs' AS kind, (SELECT count(*) FROM customer) AS n, (SELECT count(*) FROM orders) AS m")
def declared_counts_source(spark, sf_dir):
    return read_roads(spark, _arc_file(spark, sf_dir), "problem").select("kind", "n", "m")


@query(f"WITH {d.POINTS}, {d.ARCS} SELECT 'node' AS kind, node AS a, NULL::BIGINT AS b, lon AS x, lat AS y FROM pts UNION ALL SELECT 'edge', u, v, w, NULL::DOUBLE FROM arcs")
def normalised_tables(spark, sf_dir):
    """Node and edge tables, written as CSV and read again."""
    nodes, edges = d.folder(spark), d.folder(spark)
    write_table(d.points(spark, sf_dir), nodes, "csv")
    write_table(d.road_arcs(spark, sf_dir).select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("w").alias("weight")), edges, "csv")
    none = lambda kind: F.lit(None).cast(kind)
    a = read_nodes(spark, nodes).select(F.lit("node").alias("kind"), F.col("id").alias("a"), none("long").alias("b"), F.col("x_loc").alias("x"), F.col("y_loc").alias("y"))
    return a.unionByName(read_edges(spark, edges).select(F.lit("edge").alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), F.col("w").alias("x"), none("double").alias("y")))


@query(f"WITH {d.POINTS} SELECT node AS id, floor(lon * 1e6) / 1e6 AS x_loc, floor(lat * 1e6) / 1e6 AS y_loc, 'DIMACS medium nodes - USA-road-d.BAY (' || format('{{:,}}', (SELECT count(*) FROM pts)) || ' points)' AS title FROM pts")
def points_of_scale(spark, sf_dir):
    """A data set of its scale's folder, with the title of its plot."""
    path = scale_paths(d.folder(spark), "medium")[0]
    micro = lambda c: F.floor(F.col(c) * 1e6).cast("string")
    d.points(spark, sf_dir).select(F.concat_ws(" ", F.lit("v"), "node", micro("lon"), micro("lat")).alias("value")).write.text(path)
    found = read_points(spark, path)
    return found.select("id", "x_loc", "y_loc", F.lit(layers.title(path, found.count())).alias("title"))


# Graphs


@query(f"WITH {d.MERGED} SELECT from_point, to_point, value, directed FROM gedges")
def graph_merge_edges(spark, sf_dir):
    return graph.build_graph(d.merge_arcs(spark, sf_dir)).drop("seq")


_EVENTS = """ev AS (SELECT o_orderkey AS seq, o_custkey % 12 AS u, (o_orderkey * 31) % 12 AS v, CAST(o_orderkey % 2 AS DOUBLE) AS w, o_orderkey % 5 <> 0 AS directed FROM orders)"""


def _events(spark, sf_dir):
    o = d.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 12).alias("u"), ((F.col("o_orderkey") * 31) % 12).alias("v"), (F.col("o_orderkey") % 2).cast("double").alias("w"), (F.col("o_orderkey") % 5 != 0).alias("directed"))


_BUCKETS = f"""{_EVENTS}, f AS (SELECT *, least(u, v) AS a, greatest(u, v) AS b, first_value(directed) OVER k AS fd, first_value(u) OVER k AS fu, first_value(v) OVER k AS fv, row_number() OVER k AS n
  FROM ev WHERE u <> v WINDOW k AS (PARTITION BY least(u, v), greatest(u, v), w ORDER BY seq)),
g AS (SELECT *, fd AND directed AND u = fv AS opposite FROM f),
h AS (SELECT *, opposite AND row_number() OVER (PARTITION BY a, b, w, opposite ORDER BY seq) = 1 AS turns FROM g)"""


@query(f"WITH {_BUCKETS} SELECT seq, u, v, w, directed, n = 1 OR turns AS accepted FROM h UNION ALL SELECT seq, u, v, w, directed, false FROM ev WHERE u = v")
def graph_accepted_events(spark, sf_dir):
    return graph.accepted_events(_events(spark, sf_dir))


@query(
    f"""WITH {_BUCKETS}, m AS (SELECT a, b, w, bool_or(opposite) AS met, any_value(fd) AS fd, any_value(fu) AS fu, any_value(fv) AS fv FROM h GROUP BY 1, 2, 3)
    SELECT CASE WHEN met THEN a ELSE fu END AS from_point, CASE WHEN met THEN b ELSE fv END AS to_point, w AS value, fd AND NOT met AS directed FROM m"""
)
def graph_merge_mixed_events(spark, sf_dir):
    return graph.build_graph(_events(spark, sf_dir)).drop("seq")


@query(
    f"""WITH {_BUCKETS}, m AS (SELECT a, b, w, bool_or(opposite) AS met, any_value(fd) AS fd, any_value(fu) AS fu, any_value(fv) AS fv, min(seq) AS seq FROM h GROUP BY 1, 2, 3)
    SELECT CASE WHEN met THEN a ELSE fu END AS from_point, CASE WHEN met THEN b ELSE fv END AS to_point, w AS value, fd AND NOT met AS directed, seq FROM m"""
)
def graph_append_events(spark, sf_dir):
    """The same arrivals in four batches, each added to the graph that stands; compacted on the way."""
    events = _events(spark, sf_dir)
    grown = graph.GrowingGraph(spark, d.folder(spark), most=2)
    step = events.agg(F.max("seq")).first()[0] // 4 + 1
    for k in range(4):
        grown.add_arcs(events.where((F.col("seq") >= k * step) & (F.col("seq") < (k + 1) * step)))
    return grown.edges()


@query(f"WITH {d.MERGED} SELECT id FROM gpoints UNION ALL SELECT c_custkey + 1 AS id FROM customer")
def graph_append_points(spark, sf_dir):
    grown = graph.GrowingGraph(spark, d.folder(spark))
    grown.add_points(d.merge_points(spark, sf_dir))
    grown.add_points(graph.add_points(d.merge_points(spark, sf_dir).limit(0), d.table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("id"))))
    return grown.points()


@query(f"WITH {d.MERGED} SELECT id FROM gpoints ORDER BY id LIMIT 1 OFFSET 6")
def graph_point_at(spark, sf_dir):
    """By position: the seventh point, whatever its id."""
    return graph.point_at(d.merge_points(spark, sf_dir), 7)


@query(f"WITH {d.MERGED} SELECT 'test' AS info, (SELECT count(*) FROM gpoints) AS num_points, count(*) FILTER (directed) AS num_directed_edges, count(*) FILTER (NOT directed) AS num_undirected_edges, count(*) AS num_total_edges FROM gedges")
def graph_summary(spark, sf_dir):
    return graph.summary(d.merge_points(spark, sf_dir), graph.build_graph(d.merge_arcs(spark, sf_dir)), "test")


@query(f"WITH {d.MERGED} SELECT from_point, to_point, value, directed FROM gedges WHERE (directed AND from_point = 14 AND to_point = 78) OR (NOT directed AND least(from_point, to_point) = 14 AND greatest(from_point, to_point) = 78) ORDER BY directed DESC, seq LIMIT 1")
def graph_edge_lookup(spark, sf_dir):
    return graph.get_edge(graph.build_graph(d.merge_arcs(spark, sf_dir)), 14, 78).drop("seq")


@query(f"WITH {d.MERGED} SELECT from_point, to_point, value, directed FROM gedges WHERE (directed AND from_point = 78 AND to_point = 14) OR (NOT directed AND least(from_point, to_point) = 14 AND greatest(from_point, to_point) = 78)")
def graph_edges_between(spark, sf_dir):
    return graph.edges_between(graph.build_graph(d.merge_arcs(spark, sf_dir)), 78, 14).drop("seq")


@query(
    f"""WITH {d.MERGED}, asked AS (SELECT DISTINCT o_custkey % (SELECT count(*) FROM supplier) + 1 AS a, o_orderkey % (SELECT count(*) FROM supplier) + 1 AS b FROM orders)
    SELECT a, b, EXISTS (SELECT 1 FROM gedges WHERE (from_point = a AND to_point = b) OR (NOT directed AND from_point = b AND to_point = a)) AS found FROM asked"""
)
def graph_has_edge_bulk(spark, sf_dir):
    s = d.table(spark, sf_dir, "supplier").count()
    asked = d.table(spark, sf_dir, "orders").select((F.col("o_custkey") % s + 1).alias("a"), (F.col("o_orderkey") % s + 1).alias("b"))
    return graph.has_edges(graph.build_graph(d.merge_arcs(spark, sf_dir)), asked)


def _graph(spark, sf_dir):
    return d.merge_points(spark, sf_dir), graph.build_graph(d.merge_arcs(spark, sf_dir))


@query(f"WITH {d.MERGED} SELECT id FROM gpoints WHERE id = 4")
def graph_point_lookup(spark, sf_dir):
    return graph.point_by_id(d.merge_points(spark, sf_dir), 4)


@query(f"WITH {d.MERGED} SELECT count(*) AS n, min(id) AS smallest, max(id) AS largest, count(DISTINCT id) AS distinct_ids, false AS is_dense FROM gpoints")
def graph_dense_ids(spark, sf_dir):
    return graph.check_dense_ids(d.merge_points(spark, sf_dir))


@query(f"WITH {d.INCIDENT} SELECT node, other, value, directed, is_out, is_in FROM inc WHERE is_out")
def graph_out_edges(spark, sf_dir):
    return graph.out_edges(*_graph(spark, sf_dir)).drop("seq")


@query(f"WITH {d.INCIDENT} SELECT node, other, value, directed, is_out, is_in FROM inc WHERE is_in")
def graph_in_edges(spark, sf_dir):
    return graph.in_edges(*_graph(spark, sf_dir)).drop("seq")


@query(f"WITH {d.INCIDENT} SELECT node, other AS neighbor FROM inc WHERE is_out")
def graph_neighbors(spark, sf_dir):
    return graph.neighbors(*_graph(spark, sf_dir))


@query(f"WITH {d.INCIDENT} SELECT id AS node, count(*) FILTER (is_out) AS degree, count(*) FILTER (is_in) AS in_degree, count(*) FILTER (is_out) AS out_degree FROM gpoints LEFT JOIN inc ON inc.node = id GROUP BY 1")
def graph_degrees(spark, sf_dir):
    return graph.degrees(*_graph(spark, sf_dir))


@query(f"WITH {d.INCIDENT} SELECT node, string_agg(CAST(other AS VARCHAR), ' ' ORDER BY seq, other, value, directed) FILTER (is_out) AS out_ids, string_agg(CAST(other AS VARCHAR), ' ' ORDER BY seq, other, value, directed) FILTER (is_in) AS in_ids FROM inc GROUP BY 1")
def graph_edge_lists(spark, sf_dir):
    told = graph.edge_lists(*_graph(spark, sf_dir))
    ids = lambda c: F.when(F.size(c) > 0, F.array_join(F.col(f"{c}.other").cast("array<string>"), " "))
    return told.select("node", ids("out_edges").alias("out_ids"), ids("in_edges").alias("in_ids"))


@query(f"WITH {d.MERGED} SELECT from_point, to_point, value, directed FROM gedges WHERE directed")
def graph_directed_edges(spark, sf_dir):
    return graph.directed_edges(_graph(spark, sf_dir)[1]).drop("seq")


@query(f"WITH {d.MERGED} SELECT from_point, to_point, value, directed FROM gedges WHERE NOT directed")
def graph_undirected_edges(spark, sf_dir):
    return graph.undirected_edges(_graph(spark, sf_dir)[1]).drop("seq")


@query(f"WITH {d.MERGE_ARCS} SELECT u, count(*) AS n, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY seq, v, w) AS ids FROM garcs GROUP BY 1")
def arcs_adjacency_dict(spark, sf_dir):
    told = graph.adjacency_of_arcs(d.merge_arcs(spark, sf_dir))
    return told.select("u", F.size("neighbors").cast("long").alias("n"), F.array_join(F.col("neighbors.v").cast("array<string>"), " ").alias("ids"))


@query(f"WITH {d.UND} SELECT edge_index, src, dst, weight FROM und")
def undirected_edges_indexed(spark, sf_dir):
    return d.road_graph(spark, sf_dir)


@query(f"WITH {d.ADJ} SELECT u AS node, v AS nbr, w AS weight, edge_index FROM adj")
def adjacency(spark, sf_dir):
    return graph.adjacency(d.road_graph(spark, sf_dir))


@query(
    f"""WITH {d.ADJ}, s AS (SELECT DISTINCT u, v FROM adj WHERE u <> v)
    SELECT DISTINCT node_i, node_j FROM (SELECT a.u AS node_i, b.v AS node_j FROM s a JOIN s b ON a.v = b.u UNION ALL SELECT u, v FROM s) WHERE node_i < node_j"""
)
def two_hop_neighbors(spark, sf_dir):
    return graph.two_hop_neighbors(d.kept_graph(spark, sf_dir))


@query(f"WITH {d.POINTS} SELECT CAST(floor(lon / 0.5) AS BIGINT) AS cell_x, CAST(floor(lat / 0.5) AS BIGINT) AS cell_y, count(*) AS n FROM pts GROUP BY 1, 2")
def grid_partition(spark, sf_dir):
    p = d.points(spark, sf_dir).select(F.col("node").alias("id"), F.col("lon").alias("x_loc"), F.col("lat").alias("y_loc"))
    return graph.grid_cells(p, 0.5).groupBy("cell_x", "cell_y").agg(F.count("*").alias("n"))


# Shortest paths


def _traced(spark, sf_dir, method="auto"):
    return paths.trace_paths(d.kept_graph(spark, sf_dir), d.road_queries(spark, sf_dir), method)


@query(f"WITH RECURSIVE {d.ADJ}, {d.QUERIES}, {d.SHORTEST} SELECT src, node, d AS distance FROM sp")
def sssp_distances(spark, sf_dir):
    return paths.distances(d.kept_graph(spark, sf_dir), d.road_queries(spark, sf_dir).select(F.col("origin").alias("src")))


@query(f"{d.TRACED} SELECT query_id, max(back) OVER (PARTITION BY query_id) - back AS pos, node FROM walk")
def trace_paths_nodes(spark, sf_dir):
    return _traced(spark, sf_dir).select("query_id", F.posexplode("nodes").alias("pos", "node"))


@query(f"{d.TRACED}, {d.STEPS} SELECT query_id, max(back) OVER (PARTITION BY query_id) - back AS pos, edge_index FROM steps")
def trace_paths_edges(spark, sf_dir):
    return _traced(spark, sf_dir).select("query_id", F.posexplode("edges").alias("pos", "edge_index"))


@query(f"WITH RECURSIVE {d.ADJ}, {d.QUERIES}, {d.SHORTEST} SELECT query_id, origin, destination, d IS NOT NULL AS reachable, d AS distance FROM q LEFT JOIN sp ON src = origin AND node = destination")
def trace_paths_distances(spark, sf_dir):
    return _traced(spark, sf_dir).select("query_id", "origin", "destination", "reachable", "distance")


@query(f"{d.TRACED} SELECT w.query_id, q.origin, q.destination, max(w.d) AS distance, string_agg(CAST(w.node AS VARCHAR), ' ' ORDER BY w.back DESC) AS path FROM walk w JOIN q USING (query_id) GROUP BY 1, 2, 3")
def paths_table(spark, sf_dir):
    return paths.path_text(_traced(spark, sf_dir).where("reachable"))


@query(
    f"""{d.TRACED}, {d.STEPS}, ends AS (SELECT query_id, max(back) AS far FROM walk GROUP BY 1)
    SELECT w.query_id, CAST(far - w.back AS INTEGER) AS pos, w.node, s.edge_index FROM walk w JOIN ends USING (query_id) LEFT JOIN steps s ON s.query_id = w.query_id AND s.back = w.back - 1"""
)
def trace_paths_steps(spark, sf_dir):
    """Nodes and the edges by which paths leave them, by a table function in one pass."""
    return paths.path_steps(_traced(spark, sf_dir))


@query(f"WITH RECURSIVE {d.ADJ}, {d.QUERIES}, {d.SHORTEST} SELECT count(*) AS num_queries, count(*) FILTER (d IS NULL) AS unreachable_queries FROM q LEFT JOIN sp ON src = origin AND node = destination")
def unreachable_count(spark, sf_dir):
    return frequency.trace_summary(_traced(spark, sf_dir))


@query(f"WITH RECURSIVE {d.ADJ.replace('w AS weight, min(line)', '1.0::DOUBLE AS weight, min(line)')}, {d.QUERIES}, {d.SHORTEST} SELECT query_id, d AS distance FROM q LEFT JOIN sp ON src = origin AND node = destination")
def unit_weight_bfs(spark, sf_dir):
    und = graph.build_undirected(d.road_arcs(spark, sf_dir).withColumn("w", F.lit(1.0)))
    return paths.trace_paths(und, d.road_queries(spark, sf_dir)).select("query_id", "distance")


def _places(spark, sf_dir):
    return d.universe(spark, sf_dir).select(F.col("node").alias("id"), F.col("lon").alias("x_loc"), F.col("lat").alias("y_loc"))


_CENTERS = f"SELECT node AS origin FROM nodes ORDER BY {draw_sql('node', workload.SALTS['centers'] + 42)}, node LIMIT 3"


@query(f"WITH RECURSIVE {d.ADJ}, {d.UNIVERSE}, q AS ({_CENTERS}), {d.SHORTEST} SELECT src, node, d AS distance FROM sp")
def sssp_relaxed_from_centers(spark, sf_dir):
    """By rounds of joins, for graphs beyond what executors take, from three drawn centres to all nodes."""
    centers = workload.hotspot_centers(d.universe(spark, sf_dir), 3)
    return paths.distances(d.kept_graph(spark, sf_dir), centers.select(F.col("center_node").alias("src")), "relax")


@query(f"WITH RECURSIVE {d.ADJ}, {d.QUERIES}, {d.SHORTEST} SELECT query_id, d AS distance FROM q LEFT JOIN sp ON src = origin AND node = destination")
def trace_paths_guided(spark, sf_dir):
    und = d.kept_graph(spark, sf_dir)
    p = _places(spark, sf_dir)
    scale = paths.admissible_scale(p, und).first()[0]
    return paths.trace_paths(und, d.road_queries(spark, sf_dir), "auto", p, scale).select("query_id", "distance")


@query(f"WITH RECURSIVE {d.ADJ}, {d.QUERIES}, {d.SHORTEST} SELECT query_id, origin, destination, d IS NOT NULL AS reachable, d AS distance FROM q LEFT JOIN sp ON src = origin AND node = destination")
def trace_paths_relaxed(spark, sf_dir):
    """Two frontiers for each query, graph and searches in tables."""
    return _traced(spark, sf_dir, "relax").select("query_id", "origin", "destination", "reachable", "distance")


def _overlay(spark, sf_dir, most=40):
    """Cells of 25 by 25 on a map of 100 by 100, quartered down to 40 nodes, as the test tables are small."""
    return overlay.Overlay(d.kept_graph(spark, sf_dir), _places(spark, sf_dir), 25.0, most)


@query(f"WITH RECURSIVE {d.ADJ}, {d.QUERIES}, {d.SHORTEST} SELECT query_id, d AS distance FROM q LEFT JOIN sp ON src = origin AND node = destination")
def block_route_distances(spark, sf_dir):
    return overlay.route_distances(_overlay(spark, sf_dir), d.road_queries(spark, sf_dir))


@query(f"WITH RECURSIVE {d.ADJ}, {d.UNIVERSE}, q AS ({_CENTERS}), {d.SHORTEST} SELECT src, node, d AS distance FROM sp")
def block_distances(spark, sf_dir):
    centers = workload.hotspot_centers(d.universe(spark, sf_dir), 3)
    return overlay.distances(_overlay(spark, sf_dir), centers.select(F.col("center_node").alias("src")))


# Frequencies and samples


@query(f"WITH {d.QUERIES} SELECT origin AS node, CAST(sum(count) AS BIGINT) AS origin_count FROM q GROUP BY 1")
def origin_counts(spark, sf_dir):
    return frequency.origin_counts(d.road_queries(spark, sf_dir))


@query(f"WITH {d.QUERIES} SELECT destination AS node, CAST(sum(count) AS BIGINT) AS destination_count FROM q GROUP BY 1")
def destination_counts(spark, sf_dir):
    return frequency.destination_counts(d.road_queries(spark, sf_dir))


@query(f"{d.TRACED} SELECT node, CAST(sum(count) AS BIGINT) AS pass_count FROM walk GROUP BY 1")
def node_pass_counts(spark, sf_dir):
    return frequency.node_pass_counts(_traced(spark, sf_dir))


@query(f"{d.TRACED}, {d.STEPS} SELECT edge_index, CAST(sum(count) AS BIGINT) AS pass_count FROM steps GROUP BY 1")
def edge_pass_counts(spark, sf_dir):
    return frequency.edge_pass_counts(_traced(spark, sf_dir))


_NODES = f"""{d.TRACED}, {d.UNIVERSE}, nf AS (SELECT n.node, n.lon, n.lat,
  CAST(coalesce((SELECT sum(count) FROM q WHERE origin = n.node), 0) AS BIGINT) AS origin_count,
  CAST(coalesce((SELECT sum(count) FROM q WHERE destination = n.node), 0) AS BIGINT) AS destination_count,
  CAST(coalesce(p.pass_count, 0) AS BIGINT) AS pass_count
  FROM nodes n LEFT JOIN (SELECT node, sum(count) AS pass_count FROM walk GROUP BY 1) p USING (node))"""
_EDGES = f"""{d.TRACED}, {d.STEPS}, ef AS (SELECT und.*, CAST(coalesce(p.pass_count, 0) AS BIGINT) AS pass_count
  FROM und LEFT JOIN (SELECT edge_index, sum(count) AS pass_count FROM steps GROUP BY 1) p USING (edge_index))"""


def _top(table: str, key: str) -> str:
    return f"top AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY pass_count DESC, {key}) AS r, (count(*) OVER () + 9) // 10 AS k FROM {table}) WHERE r <= k)"


def _labelled(table: str, key: str, seed: int) -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (ORDER BY pass_count DESC, {key}) AS r, (count(*) OVER () + 9) // 10 AS k FROM {table}),
    drawn AS (SELECT *, row_number() OVER (PARTITION BY r <= k ORDER BY {draw_sql(key, seed)}, {key}) AS n FROM ranked),
    told AS (SELECT * EXCLUDE (r, k, n), CASE WHEN r <= k THEN 1 ELSE 0 END AS label, CASE WHEN r <= k THEN 'positive' WHEN n <= k THEN 'negative' ELSE 'unused' END AS sample_role FROM drawn)"""


def _node_features(spark, sf_dir):
    return frequency.node_features(d.universe(spark, sf_dir), d.road_queries(spark, sf_dir), _traced(spark, sf_dir))


def _edge_features(spark, sf_dir):
    und = d.kept_graph(spark, sf_dir)
    return frequency.edge_features(und, paths.trace_paths(und, d.road_queries(spark, sf_dir)))


@query(f"{_NODES} SELECT * FROM nf")
def node_features(spark, sf_dir):
    return _node_features(spark, sf_dir)


@query(f"{_EDGES} SELECT edge_index, src, dst, weight, pass_count FROM ef")
def edge_features(spark, sf_dir):
    return _edge_features(spark, sf_dir)


@query(f"{_NODES}, {_top('nf', 'node')} SELECT node, pass_count FROM top")
def top_decile_nodes(spark, sf_dir):
    return frequency.top_decile(_node_features(spark, sf_dir), "node").select("node", "pass_count")


@query(f"{_EDGES}, {_top('ef', 'edge_index')} SELECT edge_index, pass_count FROM top")
def top_decile_edges(spark, sf_dir):
    return frequency.top_decile(_edge_features(spark, sf_dir), "edge_index").select("edge_index", "pass_count")


@query(f"{_NODES}, {_labelled('nf', 'node', 42)} SELECT * FROM told")
def node_samples(spark, sf_dir):
    return frequency.label(_node_features(spark, sf_dir), "node", seed=42)


@query(f"{_EDGES}, {_labelled('ef', 'edge_index', 43)} SELECT edge_index, src, dst, weight, pass_count, label, sample_role FROM told")
def edge_samples_labelled(spark, sf_dir):
    return frequency.label(_edge_features(spark, sf_dir), "edge_index", seed=43)


@query(f"{_NODES} SELECT *, CASE WHEN pass_count >= 2 THEN 1 ELSE 0 END AS label, CASE WHEN pass_count >= 2 THEN 'positive' WHEN pass_count <= 0 THEN 'negative' ELSE 'unused' END AS sample_role FROM nf")
def node_samples_threshold(spark, sf_dir):
    return frequency.label_by_threshold(_node_features(spark, sf_dir), positive_from=2)


@query(f"WITH {d.UNIVERSE} SELECT node FROM nodes ORDER BY {draw_sql('node', 42)}, node LIMIT 25")
def negatives_sampled(spark, sf_dir):
    return frequency.sample_negatives(d.universe(spark, sf_dir).select("node"), "node", 25)


@query(f"WITH {d.QUERIES} SELECT query_id, origin, destination, count FROM q ORDER BY destination, query_id DESC LIMIT 10")
def first_queries(spark, sf_dir):
    """The first rows in the order of the files, which are not in the order of ids."""
    path = d.folder(spark)
    write_table(d.road_queries(spark, sf_dir).orderBy("destination", F.desc("query_id")), path, "csv")
    return frequency.first_queries(read_queries(spark, path), 10, "line").drop("line")


# Workloads


def _centers_sql(n: int, seed: int = 42) -> str:
    drawn = draw_sql("node", workload.SALTS["centers"] + seed)
    return f"{d.POINTS}, c AS (SELECT CAST(row_number() OVER (ORDER BY {drawn}, node) AS INTEGER) AS hotspot_id, node AS center_node, lon AS center_lon, lat AS center_lat FROM pts ORDER BY hotspot_id LIMIT {n})"


_REGIONS = f"""{_centers_sql(5)}, near AS (SELECT hotspot_id, node, pts.lon, pts.lat, row_number() OVER (PARTITION BY hotspot_id
  ORDER BY (pts.lon - center_lon) * (pts.lon - center_lon) + (pts.lat - center_lat) * (pts.lat - center_lat), node) AS rank FROM c, pts),
m AS (SELECT * FROM near WHERE rank <= 40)"""


def _members(spark, sf_dir):
    p = d.points(spark, sf_dir)
    c = stable(workload.hotspot_centers(p, 5))
    return p, c, workload.nearest_nodes(p, c, 40)


@query(f"WITH {_REGIONS} SELECT hotspot_id, CAST(rank AS INTEGER) AS rank, node, lon, lat FROM m")
def hotspot_regions_knn(spark, sf_dir):
    return _members(spark, sf_dir)[2]


@query(f"WITH {_REGIONS} SELECT hotspot_id, center_node, center_lon, center_lat, CAST(count(*) AS INTEGER) AS num_nodes FROM c JOIN m USING (hotspot_id) GROUP BY ALL")
def hotspots_summary(spark, sf_dir):
    _, c, m = _members(spark, sf_dir)
    return workload.hotspot_table(c, m)


def _salt(name: str) -> int:
    return workload.SALTS[name] + 42 * 31


_TYPED = f"""ids AS (SELECT unnest(range(1, 1001)) AS query_id), t AS (SELECT query_id, {draw_sql('query_id', _salt('type'))} % 100 AS x FROM ids),
typed AS (SELECT query_id, CASE WHEN x < 70 THEN 'hotspot_to_hotspot' WHEN x < 90 THEN 'hotspot_to_random' ELSE 'random' END AS query_type FROM t)"""
_OD = f"""{_REGIONS}, {_TYPED}, n AS (SELECT row_number() OVER (ORDER BY node) - 1 AS rank, node FROM pts),
a AS (SELECT *, {uniform_sql('query_id', _salt('source'), '5')} + 1 AS f, {uniform_sql('query_id', _salt('target'), '4')} + 1 AS o FROM typed),
b AS (SELECT query_id, query_type, CAST(CASE WHEN query_type <> 'random' THEN f ELSE -1 END AS INTEGER) AS source_hotspot,
  CAST(CASE WHEN query_type = 'hotspot_to_hotspot' THEN CASE WHEN o >= f THEN o + 1 ELSE o END ELSE -1 END AS INTEGER) AS target_hotspot FROM a),
all_places AS (SELECT hotspot_id, rank - 1 AS place, node FROM m UNION ALL SELECT -1, rank, node FROM n),
size AS (SELECT hotspot_id, count(*) AS size FROM all_places GROUP BY 1),
e AS (SELECT b.*, p.node AS origin FROM b JOIN size s ON s.hotspot_id = source_hotspot JOIN all_places p ON p.hotspot_id = source_hotspot AND p.place = {draw_sql('query_id', _salt('origin'))} % s.size),
g AS (SELECT e.*, k.place AS skip, s.size - (CASE WHEN k.place IS NULL THEN 0 ELSE 1 END) AS free FROM e JOIN size s ON s.hotspot_id = target_hotspot LEFT JOIN all_places k ON k.hotspot_id = target_hotspot AND k.node = origin),
h AS (SELECT g.*, {draw_sql('query_id', _salt('destination'))} % free AS x FROM g)"""


@query(f"WITH {_TYPED.replace('SELECT unnest(range(1, 1001)) AS query_id', 'SELECT o_orderkey AS query_id FROM orders')} SELECT query_type, count(*) AS n FROM typed GROUP BY 1")
def workload_type_mix(spark, sf_dir):
    """The types that are drawn for all orders as queries."""
    return workload.query_types(d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"))).groupBy("query_type").agg(F.count("*").alias("n"))


@query(f"WITH {_OD} SELECT query_id, origin, p.node AS destination, query_type, source_hotspot, target_hotspot, 1 AS count FROM h JOIN all_places p ON p.hotspot_id = target_hotspot AND p.place = x + (CASE WHEN skip IS NOT NULL AND x >= skip THEN 1 ELSE 0 END)")
def workload_od(spark, sf_dir):
    p, _, m = _members(spark, sf_dir)
    return workload.generate_queries(p, stable(m), 1000)


# Files of results, written and read again


@query(f"WITH {_REGIONS} SELECT hotspot_id, center_node, center_lon, center_lat, CAST(count(*) AS INTEGER) AS num_nodes FROM c JOIN m USING (hotspot_id) GROUP BY ALL")
def hotspots_file(spark, sf_dir):
    _, c, m = _members(spark, sf_dir)
    path = d.folder(spark)
    write_table(workload.hotspot_table(c, m), path, "csv", order="hotspot_id")
    return read_hotspots(spark, path)


@query(f"WITH {_OD} SELECT query_id, origin, p.node AS destination, 1 AS count FROM h JOIN all_places p ON p.hotspot_id = target_hotspot AND p.place = x + (CASE WHEN skip IS NOT NULL AND x >= skip THEN 1 ELSE 0 END)")
def workload_file(spark, sf_dir):
    p, _, m = _members(spark, sf_dir)
    path = d.folder(spark)
    write_table(workload.generate_queries(p, stable(m), 1000), path, "csv", order="query_id")
    return read_queries(spark, path).drop("line")


def _sample_files(spark, sf_dir):
    """Node and edge counts with labels of the routed orders, as CSV; the folder and the run's counters."""
    path = d.folder(spark)
    tables = plans.sample_tables(d.universe(spark, sf_dir), d.kept_graph(spark, sf_dir), d.road_queries(spark, sf_dir))
    return path, tables, plans.write_samples(tables, path)


@query(f"{_NODES}, {_labelled('nf', 'node', 42)} SELECT node FROM told WHERE sample_role = 'positive'")
def node_samples_file(spark, sf_dir):
    return read_node_samples(spark, f"{_sample_files(spark, sf_dir)[0]}/node_counts")


@query(f"{_EDGES}, {_labelled('ef', 'edge_index', 43)} SELECT src, dst FROM told WHERE sample_role = 'negative'")
def edge_samples_file(spark, sf_dir):
    return read_edge_samples(spark, f"{_sample_files(spark, sf_dir)[0]}/edge_counts", "negative")


@query(
    f"""{d.TRACED}, tops AS (SELECT (SELECT count(*) FROM customer) AS nodes, (SELECT count(*) FROM und) AS edges)
    SELECT (SELECT count(*) FROM q) AS num_queries, (SELECT count(*) FROM q LEFT JOIN sp ON src = origin AND node = destination WHERE d IS NULL) AS unreachable_queries,
      nodes, edges, (nodes + 9) // 10 AS positive_nodes, (nodes + 9) // 10 AS negative_nodes, (edges + 9) // 10 AS positive_edges, (edges + 9) // 10 AS negative_edges FROM tops"""
)
def samples_summary(spark, sf_dir):
    """What a run of samples reports, counted while its files are written."""
    return plans.one_row(spark, _sample_files(spark, sf_dir)[2])


@query(f"{d.TRACED}, {d.STEPS} SELECT w.query_id, q.origin, q.destination, max(w.d) AS distance, string_agg(CAST(w.node AS VARCHAR), ' ' ORDER BY w.back DESC) AS path FROM walk w JOIN q USING (query_id) GROUP BY 1, 2, 3")
def paths_file(spark, sf_dir):
    path = d.folder(spark)
    plans.write_paths(kept(_traced(spark, sf_dir)), path)
    return spark.read.csv(path, header=True, schema="query_id long, origin long, destination long, distance double, path string")


@query(f"{_NODES} SELECT * FROM nf")
def node_features_file(spark, sf_dir):
    path = d.folder(spark)
    plans.write_node_features(_node_features(spark, sf_dir), path)
    return spark.read.csv(path, header=True, schema="node long, lon double, lat double, origin_count long, destination_count long, pass_count long")


@query(f"{_EDGES} SELECT src, dst, weight, pass_count FROM ef")
def edge_features_file(spark, sf_dir):
    path = d.folder(spark)
    plans.write_edge_features(_edge_features(spark, sf_dir), path)
    return spark.read.csv(path, header=True, schema="src long, dst long, weight double, pass_count long")


# Plot layers


@query(f"WITH {d.UND}, {d.UNIVERSE} SELECT e.src, e.dst, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2 FROM und e JOIN nodes a ON a.node = e.src JOIN nodes b ON b.node = e.dst")
def plot_layer_segments(spark, sf_dir):
    return layers.segment_layer(d.road_graph(spark, sf_dir).select("src", "dst"), d.universe(spark, sf_dir))


@query(f"WITH {_REGIONS} SELECT hotspot_id, hotspot_id - 1 AS color, node, lon, lat FROM m")
def plot_layer_regions(spark, sf_dir):
    p, c, m = _members(spark, sf_dir)
    return layers.region_layer(p, workload.hotspot_table(c, stable(m)))


@query(f"WITH {_REGIONS} SELECT center_lon AS lon, center_lat AS lat, CAST(hotspot_id AS VARCHAR) AS text FROM c")
def plot_layer_centers(spark, sf_dir):
    return layers.center_layer(_members(spark, sf_dir)[1])


@query(f"{_NODES}, {_top('nf', 'node')} SELECT node, lon, lat FROM top")
def plot_layer_positive_nodes(spark, sf_dir):
    return layers.node_layer(frequency.top_decile(_node_features(spark, sf_dir), "node").select("node"), d.universe(spark, sf_dir))


# Pair samples


def _counts(spark, sf_dir):
    return pairs.pair_counts(pairs.window_pairs(d.line_paths(spark, sf_dir), 3))


@query(f"WITH {d.WINDOWS} SELECT query_id, node_i, node_j, CAST(window_distance AS INTEGER) AS window_distance FROM win")
def window_pairs(spark, sf_dir):
    return pairs.window_pairs(d.line_paths(spark, sf_dir), 3)


@query(f"WITH {d.WINDOWS} SELECT node_i, node_j, cooccur_count, query_count, CASE WHEN query_count >= 3 AND cooccur_count >= 5 THEN 'strong' ELSE 'weak' END AS strength FROM pc")
def pair_strength(spark, sf_dir):
    return _counts(spark, sf_dir).select("node_i", "node_j", "cooccur_count", "query_count", pairs.strength().alias("strength"))


@query(f"WITH {d.WINDOWS} SELECT node_i, node_j, CAST(cooccur_count AS DOUBLE) AS w_count, round(ln(1 + cooccur_count), 6) AS w_log, round(ln(1 + cooccur_count) * ln(1 + query_count), 6) AS w_product FROM pc")
def pair_weights(spark, sf_dir):
    return _counts(spark, sf_dir).select("node_i", "node_j", pairs.weight("count").alias("w_count"), F.round(pairs.weight("log_count"), 6).alias("w_log"), F.round(pairs.weight("log_product"), 6).alias("w_product"))


@query(f"WITH {d.WINDOWS} SELECT node_i, node_j, round(decay, 6) AS decay FROM pc")
def pair_decay(spark, sf_dir):
    return _counts(spark, sf_dir).select("node_i", "node_j", F.round("decay", 6).alias("decay"))


@query(
    f"""WITH {d.WINDOWS}, ends AS (SELECT node, sum(c) AS m FROM (SELECT node_i AS node, cooccur_count AS c FROM pc UNION ALL SELECT node_j, cooccur_count FROM pc) GROUP BY 1),
    t AS (SELECT sum(cooccur_count) AS n FROM pc)
    SELECT node_i, node_j, cooccur_count, round(greatest(0.0, ln(4.0 * n * cooccur_count / (CAST(a.m AS DOUBLE) * b.m))), 6) AS ppmi FROM pc, t JOIN ends a ON a.node = node_i JOIN ends b ON b.node = node_j"""
)
def pairs_ppmi(spark, sf_dir):
    return pairs.ppmi(stable(_counts(spark, sf_dir))).withColumn("ppmi", F.round("ppmi", 6))


@query(
    f"""WITH {d.WINDOWS}, s AS (SELECT DISTINCT query_id, node FROM lp), z AS (SELECT node, count(*) AS n FROM s GROUP BY 1),
    b AS (SELECT node_i, node_j, count(*) AS shared FROM pc JOIN s x ON x.node = node_i JOIN s y ON y.node = node_j AND y.query_id = x.query_id GROUP BY 1, 2)
    SELECT node_i, node_j, shared, round(shared / CAST(zi.n + zj.n - shared AS DOUBLE), 6) AS jaccard FROM b JOIN z zi ON zi.node = node_i JOIN z zj ON zj.node = node_j"""
)
def pairs_jaccard(spark, sf_dir):
    p = kept(d.line_paths(spark, sf_dir))
    return pairs.service_jaccard(pairs.services(p), pairs.window_pairs(p, 3)).withColumn("jaccard", F.round("jaccard", 6))


_PATH_WINDOWS = f"""{d.TRACED}, wk AS (SELECT query_id, node, back AS pos FROM walk),
pw AS (SELECT DISTINCT least(a.node, b.node) AS node_i, greatest(a.node, b.node) AS node_j FROM wk a JOIN wk b ON a.query_id = b.query_id AND b.pos > a.pos AND b.pos <= a.pos + 3 WHERE a.node <> b.node)"""
_NEGATIVE = "0 AS label, 'negative' AS strength, 1.0::DOUBLE AS weight, CAST(0 AS BIGINT) AS cooccur_count, CAST(0 AS BIGINT) AS query_count"


@query(
    f"""{_PATH_WINDOWS}, s AS (SELECT DISTINCT u, v FROM adj WHERE u <> v),
    hop AS (SELECT DISTINCT node_i, node_j FROM (SELECT a.u AS node_i, b.v AS node_j FROM s a JOIN s b ON a.v = b.u UNION ALL SELECT u, v FROM s) WHERE node_i < node_j)
    SELECT node_i, node_j, {_NEGATIVE}, 'hard_negative' AS source FROM hop ANTI JOIN pw USING (node_i, node_j)"""
)
def pairs_hard_negative(spark, sf_dir):
    und = d.kept_graph(spark, sf_dir)
    return pairs.hard_negatives(und, pairs.pair_counts(pairs.window_pairs(paths.trace_paths(und, d.road_queries(spark, sf_dir)), 3)))


@query(
    f"""{_PATH_WINDOWS}, g AS (SELECT row_number() OVER (ORDER BY node) - 1 AS rank, node FROM (SELECT DISTINCT u AS node FROM adj)),
    i AS (SELECT unnest(range(1, 8001)) AS id), r AS (SELECT id, {uniform_sql('id', 7, '(SELECT count(*) FROM g)')} AS a, {uniform_sql('id', 8, '(SELECT count(*) FROM g)')} AS b FROM i),
    k AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(id) AS id FROM r WHERE a <> b GROUP BY 1, 2)
    SELECT x.node AS node_i, y.node AS node_j, {_NEGATIVE}, 'random_negative' AS source FROM k JOIN g x ON x.rank = a JOIN g y ON y.rank = b ANTI JOIN pw ON pw.node_i = x.node AND pw.node_j = y.node ORDER BY id LIMIT 500"""
)
def pairs_random_negative(spark, sf_dir):
    und = d.kept_graph(spark, sf_dir)
    counts = pairs.pair_counts(pairs.window_pairs(paths.trace_paths(und, d.road_queries(spark, sf_dir)), 3))
    return pairs.random_negatives(graph.adjacency(und).select("node"), counts, 500, 7)


@query(
    f"""WITH {d.WINDOWS} SELECT node_i, node_j, 1 AS label, CASE WHEN query_count >= 3 AND cooccur_count >= 5 THEN 'strong' ELSE 'weak' END AS strength,
    round(ln(1 + cooccur_count) * ln(1 + query_count), 6) AS weight, cooccur_count, query_count, 'path_window' AS source FROM pc"""
)
def pair_samples_positive(spark, sf_dir):
    return pairs.pair_samples(_counts(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


_HOP = """s AS (SELECT DISTINCT u, v FROM adj WHERE u <> v),
    hop AS (SELECT DISTINCT node_i, node_j FROM (SELECT a.u AS node_i, b.v AS node_j FROM s a JOIN s b ON a.v = b.u UNION ALL SELECT u, v FROM s) WHERE node_i < node_j)"""
_PAIR = draw_sql("node_i * 1000003 + node_j", 42)
_CELLS = "cells AS (SELECT node, CAST(floor(lon / 20.0) AS BIGINT) AS cell_x, CAST(floor(lat / 20.0) AS BIGINT) AS cell_y FROM nodes)"


_DRAWN = f"""g AS (SELECT row_number() OVER (ORDER BY node) - 1 AS rank, node FROM (SELECT DISTINCT u AS node FROM adj)),
    i AS (SELECT unnest(range(1, 8001)) AS id), r AS (SELECT id, {uniform_sql('id', 7, '(SELECT count(*) FROM g)')} AS a, {uniform_sql('id', 8, '(SELECT count(*) FROM g)')} AS b FROM i),
    k AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(id) AS id FROM r WHERE a <> b GROUP BY 1, 2),
    rnd AS (SELECT x.node AS node_i, y.node AS node_j FROM k JOIN g x ON x.rank = a JOIN g y ON y.rank = b ANTI JOIN pw ON pw.node_i = x.node AND pw.node_j = y.node ORDER BY id LIMIT 250)"""


@query(
    f"""{_PATH_WINDOWS}, {_HOP}, {d.UNIVERSE}, {_CELLS}, wc AS (SELECT least(a.node, b.node) AS node_i, greatest(a.node, b.node) AS node_j, a.query_id FROM wk a JOIN wk b ON a.query_id = b.query_id AND b.pos > a.pos AND b.pos <= a.pos + 3 WHERE a.node <> b.node),
    pc AS (SELECT node_i, node_j, count(*) AS cooccur_count, count(DISTINCT query_id) AS query_count FROM wc GROUP BY 1, 2),
    hard AS (SELECT node_i, node_j FROM hop ANTI JOIN pw USING (node_i, node_j) ORDER BY {_PAIR}, node_i, node_j LIMIT 300),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY cell_x, cell_y ORDER BY node) - 1 AS r, count(*) OVER (PARTITION BY cell_x, cell_y) AS n FROM cells),
    area AS (SELECT DISTINCT least(a.node, b.node) AS node_i, greatest(a.node, b.node) AS node_j FROM ranked a JOIN ranked b ON a.cell_x = b.cell_x AND a.cell_y = b.cell_y AND b.r = (a.r + 1 + {draw_sql('a.node', 42)} % (a.n - 1)) % a.n WHERE a.n > 1),
    near AS (SELECT node_i, node_j FROM area ANTI JOIN pw USING (node_i, node_j) ORDER BY {_PAIR}, node_i, node_j LIMIT 200), {_DRAWN},
    difficult AS (SELECT * FROM hard UNION SELECT * FROM near)
    SELECT node_i, node_j, 1 AS label, CASE WHEN query_count >= 3 AND cooccur_count >= 5 THEN 'strong' ELSE 'weak' END AS strength,
      round(ln(1 + cooccur_count) * ln(1 + query_count), 6) AS weight, cooccur_count, query_count, 'path_window' AS source FROM pc
    UNION ALL SELECT node_i, node_j, {_NEGATIVE}, 'hard_negative' FROM difficult UNION ALL SELECT node_i, node_j, {_NEGATIVE}, 'random_negative' FROM rnd ANTI JOIN difficult USING (node_i, node_j)"""
)
def pair_samples_all(spark, sf_dir):
    """Positives, drawn negatives of both hard kinds (a hop or two apart, and of one area), and random ones; each pair once."""
    return _pair_samples(spark, sf_dir).withColumn("weight", F.round("weight", 6))


def _pair_samples(spark, sf_dir):
    und = d.kept_graph(spark, sf_dir)
    counts = kept(pairs.pair_counts(pairs.window_pairs(paths.trace_paths(und, d.road_queries(spark, sf_dir)), 3)))
    difficult = pairs.hard_negatives(und, counts, 300), pairs.area_negatives(_places(spark, sf_dir), counts, 20.0, 200)
    return pairs.pair_samples(counts, *difficult, pairs.random_negatives(graph.adjacency(und).select("node"), counts, 250, 7))


def pair_samples_file(spark, sf_dir):
    """The same as a file, read again."""
    path = d.folder(spark)
    plans.write_pair_samples(_pair_samples(spark, sf_dir), path)
    told = spark.read.csv(path, header=True, schema="node_i long, node_j long, label int, strength string, weight double, cooccur_count long, query_count long, source string")
    return told.withColumn("weight", F.round("weight", 6))


query(ORACLES["pair_samples_all"])(pair_samples_file)


@query(
    f"""{_EDGES}, {_top('ef', 'edge_index')}, {d.UNIVERSE}, {_CELLS},
    warm AS (SELECT DISTINCT cell_x, cell_y FROM cells WHERE node IN (SELECT src FROM top WHERE pass_count > 0 UNION SELECT dst FROM top WHERE pass_count > 0))
    SELECT edge_index, src, dst, weight, pass_count, 0 AS label FROM ef JOIN cells ON node = src JOIN warm USING (cell_x, cell_y) WHERE pass_count <= 0"""
)
def edge_area_negatives(spark, sf_dir):
    return pairs.edge_area_negatives(kept(_edge_features(spark, sf_dir)), _places(spark, sf_dir), 20.0)


@query(f"{_EDGES} SELECT edge_index, src, dst, weight, pass_count, CASE WHEN pass_count > 0 THEN 1 ELSE 0 END AS label FROM ef")
def edge_path_samples(spark, sf_dir):
    return pairs.edge_samples(_edge_features(spark, sf_dir))


@query(
    f"""{_EDGES}, {_top('ef', 'edge_index')}, hot AS (SELECT * FROM top),
    ends AS (SELECT src AS node FROM hot WHERE pass_count > 0 UNION SELECT dst FROM hot WHERE pass_count > 0)
    SELECT edge_index, src, dst, weight, pass_count, 0 AS label FROM ef WHERE pass_count <= 0 AND (src IN (SELECT node FROM ends) OR dst IN (SELECT node FROM ends))"""
)
def edge_hard_negatives(spark, sf_dir):
    return pairs.edge_hard_negatives(kept(_edge_features(spark, sf_dir)))
