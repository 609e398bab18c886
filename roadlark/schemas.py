"""Schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LONG, INT, DOUBLE, STRING, BOOL = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()

POINTS = _struct(id=LONG, x_loc=DOUBLE, y_loc=DOUBLE)
EDGES = _struct(from_point=LONG, to_point=LONG, value=DOUBLE, directed=BOOL)
UNDIRECTED = _struct(edge_index=LONG, src=LONG, dst=LONG, weight=DOUBLE)
QUERIES = _struct(query_id=LONG, origin=LONG, destination=LONG, query_type=STRING, source_hotspot=INT, target_hotspot=INT, count=INT)
NODES = _struct(node=LONG, lon=DOUBLE, lat=DOUBLE)
EDGE_TABLE = _struct(src=LONG, dst=LONG, weight=DOUBLE)
HOTSPOTS = _struct(hotspot_id=INT, center_node=LONG, center_lon=DOUBLE, center_lat=DOUBLE, num_nodes=INT)
NODE_COUNTS = _struct(node=LONG, lon=DOUBLE, lat=DOUBLE, origin_count=LONG, destination_count=LONG, pass_count=LONG, label=INT, sample_role=STRING)
EDGE_COUNTS = _struct(edge_index=LONG, src=LONG, dst=LONG, weight=DOUBLE, pass_count=LONG, label=INT, sample_role=STRING)
PATHS = "query_id long, origin long, destination long, count long, reachable boolean, distance double, nodes array<long>, edges array<long>"
PATH_STEPS = _struct(query_id=LONG, pos=INT, node=LONG, edge_index=LONG)
