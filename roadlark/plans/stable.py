"""Points at which a plan is cut: reliable checkpoints, and row numbers over a distributed sort."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a local session gets one of its own (tests, one machine); a
    cluster without it is refused, as executors don't share local folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='roadlark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """The folder of this application under the shared one."""
    return f"{shared_folder(spark)}/roadlark-tables/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete all tables and files that this application has left in the shared folder; for when its results have been written.

    Checkpoints go with spark.cleaner.referenceTracking.cleanCheckpoints, when nothing refers to them any more.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Folders for tables of one run in the shared folder; `drop` deletes them all."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self._n = spark, f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n:04d}-{name}"

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def listed(self, path: str) -> list[str]:
        """Names in a folder."""
        at, files = self._at(path)
        return sorted(x.getPath().getName() for x in files.listStatus(at))

    def drop(self) -> None:
        at, files = self._at(self.base)
        files.delete(at, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def stable(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions from now on, also when executors are lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession):
    """What is run within leaves no shuffle files behind; for results that stand in the shared folder when it is done."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


#: Bytes up to which a side of a join goes through the driver where joins are many or tables grow with the input.
SMALL_SIDE = 256 << 10


@contextlib.contextmanager
def small_broadcasts(spark: SparkSession, hashed: int = 0):
    """Joins that are run within send a side to all executors, by way of the driver, only up to SMALL_SIDE; others are merged, or hashed
    where no partition of a side has more than `hashed` bytes, so that the other side need not be sorted."""
    limits = {"spark.sql.autoBroadcastJoinThreshold": SMALL_SIDE, "spark.sql.adaptive.autoBroadcastJoinThreshold": SMALL_SIDE}
    if hashed:
        limits["spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"] = hashed
    before = {k: spark.conf.get(k, None) for k in limits}
    for k, n in limits.items():
        spark.conf.set(k, str(n))
    try:
        yield
    finally:
        for k, value in before.items():
            spark.conf.set(k, value) if value is not None else spark.conf.unset(k)


def kept(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder, compressed; what they were shuffled through goes. Partitions are others."""
    path = Tables(df.sparkSession, "kept").path("rows")
    with tidy_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").option("parquet.writer.version", "v2").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stable_counted(df: DataFrame, **counters: Column) -> tuple[DataFrame, dict[str, int]]:
    """The same rows from a table in the shared folder, and aggregates over them that were counted while it was written."""
    path, seen = Tables(df.sparkSession, "kept").path("rows"), Observation()
    with tidy_shuffles(df.sparkSession):
        df.observe(seen, *[c.alias(n) for n, c in counters.items()]).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), dict(seen.get)


#: Cells of a histogram when values are searched for by rank.
CELLS = 4096


def nth_smallest(rows: DataFrame, value: str, n: int) -> int:
    """The n-th smallest of an integer column, from 1, equal values counted each; rows are read a few times and never sorted.

    A histogram of at most CELLS cells tells the cell that holds it, and the next one cuts that cell, until it is one value.
    """
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        width = (high - low) // CELLS + 1
        cell = F.floor((F.col(value) - F.lit(low)) / F.lit(width)) if high - low < 1 << 52 else F.expr(f"(CAST({value} AS DECIMAL(20, 0)) - {low}) div {width}")
        counts = sorted(tuple(r) for r in rows.where(F.col(value).between(low, high)).groupBy(cell.cast("long").alias("cell")).count().collect())
        for k, size in counts:
            if n <= size:
                low, high = low + k * width, min(high, low + (k + 1) * width - 1)
                break
            n -= size
    return low


def smallest(rows: DataFrame, n: int, value: str, key: str) -> Column:
    """The condition that holds for the n rows (n of at least 1, at most all) with the least values, ties by key; both are integers, keys tell rows apart."""
    edge = nth_smallest(rows, value, n)
    ties = n - rows.where(F.col(value) < edge).count()
    last = nth_smallest(rows.where(F.col(value) == edge), key, ties)
    return (F.col(value) < edge) | ((F.col(value) == edge) & (F.col(key) <= last))


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 0, columns: list[str] | None = None) -> DataFrame:
    """Rows numbered from `start` in the given order, without gaps and without one task that sees them all.

    A range sort, then the place in the partition plus the rows of earlier partitions; the driver holds one number a partition.
    Both are columns of a kept table, beside `columns` (all, if not told). The order must tell all rows apart for the numbers to be the same each time.
    """
    part, at = f"_part_{name}", f"_at_{name}"
    columns = columns or df.columns
    rows = kept(df.orderBy(*order).select(*columns).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    with tidy_shuffles(df.sparkSession):
        sizes = sorted((r[0], r[1]) for r in rows.groupBy(part).count().collect())
    before, table = start, []
    for p, n in sizes:
        table.append((p, before))
        before += n
    # one row a partition
    offsets = F.broadcast(df.sparkSession.createDataFrame(table, f"{part} int, _offset_{name} long"))
    return rows.join(offsets, part).withColumn(name, F.col(f"_offset_{name}") + F.col(at)).select(*columns, name)
