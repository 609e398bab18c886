from .datasource import read_roads, register
from .files import read_edge_samples, read_edges, read_hotspots, read_node_samples, read_nodes, read_queries, write_table
from .roads import SCALES, declared_counts, numbered_lines, parse_arcs, parse_points, parse_unit_edges, points_universe, read_arcs, read_points, read_unit_edges, scale_paths

__all__ = ["SCALES", "declared_counts", "numbered_lines", "parse_arcs", "parse_points", "parse_unit_edges", "points_universe", "read_arcs", "read_edge_samples", "read_edges", "read_hotspots", "read_node_samples", "read_nodes", "read_points", "read_roads", "read_queries", "read_unit_edges", "register", "scale_paths", "write_table"]
