"""Command line: `python -m roadlark.cli <summary|workload|samples|pairs|points|hotspots|combined> ...`. Plots are written as tables of their layers."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import sources
from .operators import layers
from .plans import frequency_samples as plans


def _points(spark: SparkSession, path: str):
    return sources.read_points(spark, path, allow_empty=False).select(F.col("id").alias("node"), F.col("x_loc").alias("lon"), F.col("y_loc").alias("lat"))


def _report(spark: SparkSession, counted: dict[str, int], where: str) -> None:
    plans.one_row(spark, counted).show(truncate=False)
    print(f"Output: {where}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: tuple) -> None:
        c = sub.add_parser(name)
        for flag, default in flags:
            c.add_argument(f"--{flag}", default=default, type=type(default) if default is not None and not isinstance(default, str) else str, required=default == "")

    command("summary", ("coords", ""), ("graph", ""), ("info", "graph"))
    command("workload", ("coords", ""), ("output-dir", ""), ("train-size", 10_000), ("test-size", 2_000), ("num-hotspots", 20), ("nodes-per-hotspot", 800), ("seed", 42))
    command("samples", ("coords", ""), ("graph", ""), ("queries", ""), ("output-dir", ""), ("seed", 42), ("max-queries", -1), ("workers", 0), ("chunk-size", 100))
    command("pairs", ("coords", ""), ("graph", ""), ("queries", ""), ("output-dir", ""), ("seed", 42), ("window", 3))
    command("points", ("input", ""), ("output", ""))
    command("hotspots", ("coords", ""), ("hotspots", ""), ("output", ""))
    command("combined", ("coords", ""), ("hotspots", ""), ("node-counts", ""), ("edge-counts", ""), ("output", ""))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("roadlark").getOrCreate()
    if a.command == "summary":
        plans.graph_summary(spark, a.coords, a.graph, a.info).show(truncate=False)
    elif a.command == "workload":
        tables = plans.generate_workload(spark, a.coords, a.train_size, a.test_size, a.num_hotspots, a.nodes_per_hotspot, a.seed)
        _report(spark, plans.write_workload(tables, a.output_dir), a.output_dir)
    elif a.command == "samples":
        tables = plans.frequency_samples(spark, a.coords, a.graph, a.queries, a.seed, None if a.max_queries < 0 else a.max_queries, a.workers or None, a.chunk_size)
        counted = plans.write_samples(tables, a.output_dir)
        plans.write_layers(layers.sample_layers(tables["universe"], tables["nodes"], tables["edges"]), a.output_dir, "layers_")
        _report(spark, counted, a.output_dir)
    elif a.command == "pairs":
        tables = plans.frequency_samples(spark, a.coords, a.graph, a.queries, a.seed)
        _report(spark, plans.write_pairs(tables, plans.pair_tables(tables["undirected"], tables["paths"], a.window, seed=a.seed), a.output_dir), a.output_dir)
    elif a.command == "points":
        counted = plans.write_layers({"points": layers.point_layer(_points(spark, a.input))}, a.output, "")
        print(layers.title(a.input, counted["points"]))
        _report(spark, counted, a.output)
    elif a.command == "hotspots":
        counted = plans.write_layers(layers.hotspot_layers(_points(spark, a.coords), sources.read_hotspots(spark, a.hotspots)), a.output)
        _report(spark, {"points": counted["base"], "hotspots": counted["centers"]}, a.output)
    else:
        nodes, edges = sources.read_node_samples(spark, a.node_counts, None), sources.read_edge_samples(spark, a.edge_counts, None)
        counted = plans.write_layers(layers.combined_layers(_points(spark, a.coords), sources.read_hotspots(spark, a.hotspots), nodes, edges), a.output)
        _report(spark, {"hotspots": counted["centers"], "positive_nodes": counted["positive_nodes"], "positive_edges": counted["positive_edges"]}, a.output)


if __name__ == "__main__":
    main()
