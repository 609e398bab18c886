"""What the operators of this subpackage share: sources, scratch tables, Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one Arrow call gathers before numpy works on it; bounds a Python worker's memory.
CHUNK_BYTES = 12 << 20
SCRATCH = "roadlark-scratch"
#: While a table is written: what the plan has shuffled is of no use once the table stands, and batches for workers are small.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir. Where it is unset a local session gets one of its own
    (tests, one machine); a cluster without it is refused, as executors don't share local folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='roadlark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def run_root(spark: SparkSession) -> str:
    """The folder of this application under the shared one."""
    return f"{scratch_root(spark)}/{SCRATCH}/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete all tables that operators of this application have left in the shared folder; for when their results have been written."""
    _delete(spark, run_root(spark))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Parquet tables in the shared folder that cut lineage; lost executors don't lose them.

    Results are lazy and may read them, so they stay until clean() or drop().
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{run_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n:03d}-{name}"

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = self.path(name)
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in WRITING}
        for k, v in WRITING.items():
            conf.set(k, v)
        try:
            df.write.options(**options).parquet(path)
        finally:
            for k, v in before.items():
                conf.set(k, v) if v is not None else conf.unset(k)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # so that drop() finds it
        return out

    def drop(self, *tables: DataFrame | str) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            _delete(self.spark, t if isinstance(t, str) else t._scratch_path)


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished stages now instead of at the next driver collection."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: give memory back at the end of a task, as Python workers live on and would hold what they once took."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most `limit` bytes of text, or one row; rows keep their order."""
    for batch in batches:
        col = batch.column(batch.schema.names.index(column))
        if batch.num_rows == 0:
            continue
        if batch.get_total_buffer_size() <= limit:
            yield batch
            continue
        sizes = np.frompyfunc(lambda x: 0 if x is None else len(x), 1, 1)(np.array(col.to_pylist(), dtype=object)).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def gathered(batches: Iterable[pa.RecordBatch], limit: int, weigh: Callable[[pa.RecordBatch], int] | None = None) -> Iterator[pa.Table]:
    """Join small batches up to about `limit` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        size += weigh(batch) if weigh else batch.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8, case kept; bytes.split() cuts at just these characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """The same with A-Z lower-cased; bytes.lower() leaves every other letter alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _byte_table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Bytes whose words are hashed at once, about.
HASHED = 1 << 18
WHITE = _byte_table(b" \t\n\x0b\x0c\r")
#: An odd base, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 5
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling; kept for the next call."""
    if len(_powers.get(base, ())) < max(1, n):
        size = 1 << max(16, (n - 1).bit_length())
        out, filled, step = np.ones(size, np.uint64), 1, base
        with np.errstate(over="ignore"):
            while filled < size:
                out[filled : 2 * filled] = out[:filled] * np.uint64(step)
                filled, step = 2 * filled, step * step % (1 << 64)
        _powers[base] = out
    return _powers[base][:n]


class Words:
    """Words of many texts at once, by array operations on their bytes: hashes, bytes, and the line (or text) of each.

    Words lie between ASCII white space and lose `edge` bytes at either end; words of nothing else go. A hash is a polynomial
    over random numbers of the bytes modulo 2^64, mixed with the length. Null texts have no words.
    """

    def __init__(self, texts: pa.Array, edge: bytes = b"", by_line: bool = False):
        texts = texts if texts.type == pa.string() else texts.cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        base, n = int(offsets[0]), int(offsets[-1] - offsets[0])
        data = np.frombuffer(texts.buffers()[2], np.uint8, n, base) if n else np.zeros(0, np.uint8)
        begins = offsets - base
        lengths = np.diff(begins)
        firsts = begins[:-1][lengths > 0]
        inside = ~WHITE[data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[firsts] = False
        start = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[firsts[firsts > 0] - 1] = False
        end = np.flatnonzero(inside & ~after) + 1
        if edge:
            table = _byte_table(edge)
            rough = np.flatnonzero(table[data[start]] | table[data[end - 1]])
            if len(rough):
                core = np.flatnonzero(inside & ~table[data])
                left, right = np.searchsorted(core, start[rough]), np.searchsorted(core, end[rough]) - 1
                some = left <= right
                start[rough[some]], end[rough[some]] = core[left[some]], core[right[some]] + 1
                keep = np.ones(len(start), bool)
                keep[rough[~some]] = False
                start, end = start[keep], end[keep]
        self.sizes = end - start
        self.hashes = np.zeros(len(start), np.uint64)
        at = 0
        while at < len(start):  # some words at a time, so that memory does not grow with a text
            to = max(at + 1, int(np.searchsorted(start, start[at] + HASHED)))
            low, high = int(start[at]), int(end[to - 1])
            with np.errstate(over="ignore"):
                sums = np.zeros(high - low + 1, np.uint64)
                np.cumsum(_BYTES[data[low:high]] * powers(BASE, high - low), out=sums[1:])
                first = start[at:to] - low
                own = (sums[end[at:to] - low] - sums[first]) * powers(pow(BASE, -1, 1 << 64), high - low + 1)[first]
                self.hashes[at:to] = mix64(own + self.sizes[at:to].astype(np.uint64))
            at = to
        self.hashes[self.hashes == 0] = 1
        self.text = np.searchsorted(begins, start, side="right") - 1
        self.lengths = np.bincount(self.text, minlength=len(texts))
        if by_line:
            # lines of a text: one more than it has line feeds; an empty text has one, a null text none
            feeds = np.flatnonzero(data == 10)
            upto = np.searchsorted(feeds, begins)
            told = np.asarray(texts.is_valid()).astype(np.int64)
            self.lines = (np.diff(upto) + 1) * told
            first = np.cumsum(self.lines) - self.lines
            self.line = first[self.text] + np.searchsorted(feeds, start) - upto[self.text]
            self.line_lengths = np.bincount(self.line, minlength=int(self.lines.sum()))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers (constants: splitmix64, fixed values)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: A random number for each byte.
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def doc_columns(docs: DataFrame, *extra: str) -> DataFrame:
    """Just the columns that an operator reads, so that others neither travel nor clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


#: Stands for a null id, behind all others in order.
NO_ID = (1 << 63) - 1


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text): rows known by id and a hash of their text, so that texts which share an id stay apart.

    It holds whatever order rows come in, unlike a row number. A null id is NO_ID here. Rows that repeat id and text are one.
    """
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def whole_groups(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...], limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Join batches that are sorted by `keys` and cut them only between keys; a table holds about `limit` bytes or one group."""
    held: list[pa.RecordBatch] = []
    size, due = 0, limit
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < due:
            continue
        table = pa.Table.from_batches(held)
        last = table.num_rows - 1
        differs = np.zeros(last, bool)
        for k in keys:
            column = table.column(k).to_numpy()
            differs |= column[:-1] != column[last]
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)
        due = size + limit
    if held:
        yield pa.Table.from_batches(held)


def starts_of_runs(*columns: np.ndarray) -> np.ndarray:
    """Positions at which any of the sorted columns has a new value; and the length as the last."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)
