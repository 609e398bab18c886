"""Tables as CSV with a header, or as Parquet: workloads, hotspots, counted samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..plans.stable import tidy_shuffles
from .roads import line_order


def _read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Columns by name: those of the schema that the header has, with its types; a bad value is an error."""
    header = spark.read.csv(path, header=True).columns
    kinds = {f.name: f.dataType for f in schema}
    own = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header])
    table = spark.read.csv(path, header=True, schema=own, mode="FAILFAST")
    return table.select(*[c for c in kinds if c in header], line_order().alias("line"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, origin, destination, count, line); a missing count column counts as 1. `line` orders rows as they are in the files."""
    table = _read_csv(spark, path, schemas.QUERIES)
    if "count" not in table.columns:
        table = table.withColumn("count", F.lit(1))
    return table.select("query_id", "origin", "destination", "count", "line")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, x_loc, y_loc) of a normalised node table: CSV with node, lon, lat in degrees."""
    return _read_csv(spark, path, schemas.NODES).select(F.col("node").alias("id"), F.col("lon").alias("x_loc"), F.col("lat").alias("y_loc"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(line, u, v, w) of a normalised edge table: CSV with src, dst, weight."""
    return _read_csv(spark, path, schemas.EDGE_TABLE).select("line", F.col("src").alias("u"), F.col("dst").alias("v"), F.col("weight").alias("w"))


def read_hotspots(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, schemas.HOTSPOTS).drop("line")


def read_node_samples(spark: SparkSession, path: str, role: str | None = "positive") -> DataFrame:
    table = _read_csv(spark, path, schemas.NODE_COUNTS).drop("line")
    return table if role is None else table.where(F.col("sample_role") == role).select("node")


def read_edge_samples(spark: SparkSession, path: str, role: str | None = "positive") -> DataFrame:
    table = _read_csv(spark, path, schemas.EDGE_COUNTS).drop("line")
    return table if role is None else table.where(F.col("sample_role") == role).select("src", "dst")


def write_table(table: DataFrame, path: str, kind: str = "parquet", order: str | None = None, files: int | None = None, **counters: Column) -> dict[str, int]:
    """Overwrite a folder. With `order` rows are sorted over all files; `files=1` is for small results.

    `counters` are aggregates over the rows; they are counted while these are written, in no pass of their own, and returned.
    """
    if order:
        table = table.orderBy(order)
    seen = Observation()
    if counters:
        table = table.observe(seen, *[c.alias(n) for n, c in counters.items()])
    if files:
        table = table.coalesce(files)
    writer = table.write.mode("overwrite")
    with tidy_shuffles(table.sparkSession):
        writer.csv(path, header=True) if kind == "csv" else writer.format(kind).save(path)
    return dict(seen.get) if counters else {}
