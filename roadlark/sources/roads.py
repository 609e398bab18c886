"""Road-graph text files: coordinates (`v id lon lat`, millionths of a degree), arcs (`a from to weight`) and plain edge lists.

Files may be compressed; Spark reads `.gz` as it is. Lines get their number in the file, as edge numbers
and prefix limits depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Published data sets by size, as file name parts.
SCALES = {"small": "NY", "medium": "BAY", "large": "COL"}
MILLIONTHS = 1e6


def scale_paths(folder: str, scale: str) -> tuple[str, str]:
    """Paths of the coordinate and the arc file of a data set."""
    if scale not in SCALES:
        raise ValueError(f"scale is one of {', '.join(SCALES)}")
    name = SCALES[scale]
    return f"{folder}/{scale}/USA-road-d.{name}.co", f"{folder}/{scale}/USA-road-d.{name}.gr"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): `line` orders the lines as they are in the files: by path, split of the file, and place in the split.

    It takes no sort and no single task.
    """
    return spark.read.text(path).select(line_order().alias("line"), "value")


def line_order() -> Column:
    """Where a row of a file source stands: path, split of the file, and place in the split."""
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.struct(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("file_block_start"), at.alias("at"))


def _fields(lines: DataFrame, tag: str) -> DataFrame:
    """Lines that begin with a tag, cut at white space; lines of another number of fields are an error."""
    cut = lines.where(F.col("value").startswith(tag + " ")).withColumn("f", F.split(F.trim("value"), r"\s+"))
    four = F.when(F.size("f") == 4, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("not four fields: "), F.col("value"))).cast("array<string>"))
    return cut.withColumn("f", four)


def parse_points(lines: DataFrame) -> DataFrame:
    """(line, id, x_loc, y_loc) in degrees, of lines (line, value)."""
    f = F.col("f")
    return _fields(lines, "v").select("line", f[1].cast("long").alias("id"), (f[2].cast("long") / F.lit(MILLIONTHS)).alias("x_loc"), (f[3].cast("long") / F.lit(MILLIONTHS)).alias("y_loc"))


def parse_arcs(lines: DataFrame) -> DataFrame:
    """(line, u, v, w) of lines (line, value)."""
    f = F.col("f")
    return _fields(lines, "a").select("line", f[1].cast("long").alias("u"), f[2].cast("long").alias("v"), f[3].cast("double").alias("w"))


def parse_unit_edges(lines: DataFrame) -> DataFrame:
    """(line, u, v, w = 1) of `from to` lines; `#` begins a comment. Ids are as they are, from 0."""
    cut = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("f", F.split(F.trim("value"), r"\s+"))
    cut = cut.withColumn("f", F.when(F.size("f") == 2, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("not two fields: "), F.col("value"))).cast("array<string>")))
    return cut.select("line", F.col("f")[0].cast("long").alias("u"), F.col("f")[1].cast("long").alias("v"), F.lit(1.0).alias("w"))


def declared_counts(lines: DataFrame) -> DataFrame:
    """(kind, n, m) of problem lines: `p sp nodes arcs` or `p aux sp co nodes` (m is null)."""
    f = F.col("f")
    cut = lines.where(F.col("value").startswith("p ")).withColumn("f", F.split(F.trim("value"), r"\s+"))
    is_points = f[1] == "aux"
    return cut.select(F.when(is_points, F.lit("points")).otherwise(F.lit("arcs")).alias("kind"), F.when(is_points, F.get(f, F.lit(4))).otherwise(F.get(f, F.lit(2))).cast("long").alias("n"), F.when(~is_points, F.get(f, F.lit(3))).cast("long").alias("m"))


def read_points(spark: SparkSession, path: str, allow_empty: bool = True) -> DataFrame:
    points = parse_points(numbered_lines(spark, path))
    if not allow_empty and points.isEmpty():
        raise ValueError(f"no point in {path}")
    return points


def read_arcs(spark: SparkSession, path: str) -> DataFrame:
    return parse_arcs(numbered_lines(spark, path))


def read_unit_edges(spark: SparkSession, path: str) -> DataFrame:
    return parse_unit_edges(numbered_lines(spark, path))


def points_universe(points: DataFrame, fill_gaps: bool = True) -> DataFrame:
    """(node, lon, lat) for each id once, the last line of an id counting; with fill_gaps also the ids from 1 up that are missing, at (0, 0)."""
    last = points.groupBy(F.col("id").alias("node")).agg(F.max_by(F.struct("x_loc", "y_loc"), "line").alias("p")).select("node", F.col("p.x_loc").alias("lon"), F.col("p.y_loc").alias("lat"))
    if not fill_gaps:
        return last
    largest = points.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    every = points.sparkSession.range(1, largest + 1).withColumnRenamed("id", "node")
    return every.join(last, "node", "left").select("node", F.coalesce("lon", F.lit(0.0)).alias("lon"), F.coalesce("lat", F.lit(0.0)).alias("lat"))
