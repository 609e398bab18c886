"""Layers of plots as tables; drawing them is left to whoever has a screen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workload import nearest_nodes


def point_layer(points: DataFrame) -> DataFrame:
    return points.select("lon", "lat")


def thinned(layer: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """A sample of about `most` rows for a layer that has too many to draw."""
    n = layer.count()
    return layer if n <= most else layer.sample(most / n, seed)


def title(path: str, count: int) -> str:
    """`DIMACS <scale> nodes - <data set> (<count> points)`, the scale from a folder of that name."""
    parts = [p for p in path.split("/") if p]
    lower = [p.lower() for p in parts]
    scale = next((s for s in ("small", "medium", "large") if s in lower), "DIMACS")
    stem = parts[-1].rpartition(".")[0] or parts[-1]
    return f"DIMACS {scale} nodes - {stem.removesuffix('.co')} ({count:,} points)"


def region_layer(points: DataFrame, hotspots: DataFrame) -> DataFrame:
    """(hotspot_id, color, node, lon, lat): each hotspot's nearest points, found anew from its centre and size."""
    return nearest_nodes(points, hotspots).join(F.broadcast(colors(hotspots)), "hotspot_id").select("hotspot_id", "color", "node", "lon", "lat")


def colors(hotspots: DataFrame) -> DataFrame:
    """(hotspot_id, color): 0, 1, .. in order of id; a bounded table."""
    return hotspots.select("hotspot_id", (F.row_number().over(Window.orderBy("hotspot_id")) - 1).alias("color"))


def center_layer(hotspots: DataFrame) -> DataFrame:
    return hotspots.select(F.col("center_lon").alias("lon"), F.col("center_lat").alias("lat"), F.col("hotspot_id").cast("string").alias("text"))


def segment_layer(edges: DataFrame, points: DataFrame) -> DataFrame:
    """(src, dst, x1, y1, x2, y2) of edges whose ends are both points."""
    at = lambda name, x, y: points.select(F.col("node").alias(name), F.col("lon").alias(x), F.col("lat").alias(y))
    return edges.join(at("src", "x1", "y1"), "src").join(at("dst", "x2", "y2"), "dst").select("src", "dst", "x1", "y1", "x2", "y2")


def node_layer(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """(node, lon, lat) of nodes that are points."""
    return points.join(nodes.select("node").distinct(), "node", "left_semi").select("node", "lon", "lat")


def sample_layers(points: DataFrame, node_samples: DataFrame, edge_samples: DataFrame) -> dict[str, DataFrame]:
    positive = F.col("sample_role") == "positive"
    return {"base": point_layer(points), "positive_edges": segment_layer(edge_samples.where(positive).select("src", "dst"), points), "positive_nodes": node_layer(node_samples.where(positive), points)}


def hotspot_layers(points: DataFrame, hotspots: DataFrame) -> dict[str, DataFrame]:
    return {"base": point_layer(points), "regions": region_layer(points, hotspots), "centers": center_layer(hotspots)}


def combined_layers(points: DataFrame, hotspots: DataFrame, node_samples: DataFrame, edge_samples: DataFrame) -> dict[str, DataFrame]:
    return hotspot_layers(points, hotspots) | sample_layers(points, node_samples, edge_samples)
