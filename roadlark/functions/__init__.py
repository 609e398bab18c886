from .draws import draw, draw_sql, drawn, uniform_sql

__all__ = ["draw", "draw_sql", "drawn", "uniform_sql"]
