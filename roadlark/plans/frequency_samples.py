"""Whole plans: from files to graph summaries, workloads and labelled samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frequency, graph, pairs, paths, workload
from ..sources import points_universe, read_arcs, read_points, read_queries, write_table
from .stable import stable, stable_counted


def _rows() -> Column:
    return F.count(F.lit(1))


def one_row(spark: SparkSession, counted: dict[str, int]) -> DataFrame:
    """A run's counters as a table of one row."""
    return spark.createDataFrame([tuple(counted.values())], ", ".join(f"{n} long" for n in counted))


def graph_summary(spark: SparkSession, coords: str, arcs: str, info: str = "") -> DataFrame:
    return graph.summary(read_points(spark, coords), graph.build_graph(read_arcs(spark, arcs)), info)


def generate_workload(spark: SparkSession, coords: str, train_size: int = 10_000, test_size: int = 2_000, num_hotspots: int = 20, nodes_per_hotspot: int = 800, seed: int = 42) -> dict[str, DataFrame | int]:
    """Tables hotspots, members, train, test; and num_nodes, counted while the points were kept."""
    points, told = stable_counted(read_points(spark, coords).select(F.col("id").alias("node"), F.col("x_loc").alias("lon"), F.col("y_loc").alias("lat")), num_nodes=_rows())
    centers = stable(workload.hotspot_centers(points, num_hotspots, seed))
    members = stable(workload.nearest_nodes(points, centers, nodes_per_hotspot))
    queries = {name: workload.generate_queries(points, members, n, seed, split) for split, (name, n) in enumerate((("train", train_size), ("test", test_size)))}
    return {"hotspots": workload.hotspot_table(centers, members), "members": members, **queries, **told}


def write_workload(tables: dict, folder: str) -> dict[str, int]:
    """Hotspots and queries as CSV; nodes, hotspots, train and test queries."""
    out = {"nodes": tables["num_nodes"]}
    for name, path, order, counter in (("hotspots", "hotspots", "hotspot_id", "hotspots"), ("train", "queries_train", "query_id", "train_queries"), ("test", "queries_test", "query_id", "test_queries")):
        out |= write_table(tables[name], f"{folder}/{path}", "csv", order, **{counter: _rows()})
    return out


def sample_tables(universe: DataFrame, undirected: DataFrame, queries: DataFrame, seed: int = 42, method: str = "auto", tasks: int | None = None) -> dict[str, DataFrame]:
    """Tables paths, nodes, edges, summary of a workload on a graph; the traced paths are kept, as all else reads them, and counted on the way."""
    traced, told = stable_counted(paths.trace_paths(undirected, queries, method, tasks=tasks), num_queries=_rows(), unreachable_queries=F.count_if(~F.col("reachable")))
    nodes = frequency.label(frequency.node_features(universe, queries, traced), "node", seed=seed)
    edges = frequency.label(frequency.edge_features(undirected, traced), "edge_index", seed=seed + 1)
    return {"universe": universe, "undirected": undirected, "paths": traced, "nodes": nodes, "edges": edges, "summary": one_row(universe.sparkSession, told)}


def frequency_samples(spark: SparkSession, coords: str, arcs: str, queries: str, seed: int = 42, max_queries: int | None = None, workers: int | None = None, chunk_size: int = 100) -> dict[str, DataFrame]:
    """`workers` sets how many tasks trace; there are no more of them than chunks of `chunk_size` queries."""
    asked = read_queries(spark, queries)
    if max_queries is not None:
        asked = frequency.first_queries(asked, max_queries, "line")
    tasks = workers and max(1, min(workers, -(-asked.count() // chunk_size)))
    universe = points_universe(read_points(spark, coords))
    undirected = graph.build_undirected(read_arcs(spark, arcs))
    return sample_tables(universe, undirected, asked, seed, tasks=tasks)


def write_samples(tables: dict[str, DataFrame], folder: str, kind: str = "csv") -> dict[str, int]:
    """Counts and labels of nodes and edges; what the run reports, counted while files are written."""
    role = lambda name: F.count_if(F.col("sample_role") == name)
    out = tables["summary"].first().asDict()
    nodes = write_table(tables["nodes"], f"{folder}/node_counts", kind, order="node", nodes=_rows(), positive_nodes=role("positive"), negative_nodes=role("negative"))
    return out | nodes | write_table(tables["edges"], f"{folder}/edge_counts", kind, order="edge_index", edges=_rows(), positive_edges=role("positive"), negative_edges=role("negative"))


def write_layers(layer: dict[str, DataFrame], folder: str, prefix: str = "") -> dict[str, int]:
    """Layers of a plot, each with its number of rows."""
    out = {}
    for name, table in layer.items():
        out |= write_table(table, f"{folder}/{prefix}{name}", **{name: _rows()})
    return out


def write_paths(traced: DataFrame, path: str, kind: str = "csv") -> dict[str, int]:
    return write_table(paths.path_text(traced.where("reachable")), path, kind, order="query_id", paths=_rows())


def write_node_features(features: DataFrame, path: str, kind: str = "csv") -> dict[str, int]:
    return write_table(features.select("node", "lon", "lat", "origin_count", "destination_count", "pass_count"), path, kind, order="node", nodes=_rows())


def write_edge_features(features: DataFrame, path: str, kind: str = "csv") -> dict[str, int]:
    return write_table(features.select("edge_index", "src", "dst", "weight", "pass_count").orderBy("edge_index").drop("edge_index"), path, kind, edges=_rows())


def write_pair_samples(samples: DataFrame, path: str, kind: str = "csv") -> dict[str, int]:
    return write_table(samples.orderBy("node_i", "node_j", "source"), path, kind, pairs=_rows(), positive_pairs=F.count_if(F.col("label") == 1))


def write_pairs(tables: dict[str, DataFrame], pair: dict[str, DataFrame], folder: str, kind: str = "csv") -> dict[str, int]:
    """Traced paths, features of nodes and edges, and pair samples."""
    out = write_paths(tables["paths"], f"{folder}/paths_train", kind) | write_node_features(tables["nodes"], f"{folder}/node_features", kind)
    return out | write_edge_features(tables["edges"], f"{folder}/edge_features", kind) | write_pair_samples(pair["samples"], f"{folder}/node_pair_samples", kind)


def pair_tables(undirected: DataFrame, traced: DataFrame, k: int = 3, random_pairs: int | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """Tables counts, samples, ppmi, jaccard from traced paths, in the recommended order."""
    counts, told = stable_counted(pairs.pair_counts(pairs.window_pairs(traced, k)), n=_rows())
    n = told["n"] if random_pairs is None else random_pairs
    nodes = graph.adjacency(undirected).select("node").distinct()
    samples = pairs.pair_samples(counts, pairs.hard_negatives(undirected, counts, n), pairs.random_negatives(nodes, counts, n, seed))
    return {"counts": counts, "samples": samples, "ppmi": pairs.ppmi(counts), "jaccard": pairs.service_jaccard(pairs.services(traced), counts)}
