"""Road-graph text files as a data source: spark.read.format("roadlark").option("kind", ..).load(path).

`kind` is points (`v` lines), arcs (`a` lines), problem (`p` lines) or lines (tag, rest). Files are planned as ranges of
bytes: a range has the lines that begin in it, so one large file is many tasks. A filter on `tag` is pushed into the
scan, where lines of other tags are never decoded. Paths are read through pyarrow's file systems (file, hdfs, s3, gs);
compressed files (.gz) can't be cut and are one range each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

FORMAT = "roadlark"
RANGE_BYTES = 64 << 20
BATCH_ROWS = 50_000

#: Tag, number of fields, and schema of each kind; order: file, place of the line in it.
KINDS = {
    "points": ("v", 4, "file string, at long, id long, x_loc double, y_loc double"),
    "arcs": ("a", 4, "file string, at long, u long, v long, w double"),
    "problem": ("p", 0, "file string, at long, kind string, n long, m long"),
    "lines": ("", 0, "file string, at long, tag string, rest string"),
}
MILLIONTHS = 1e6


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def _files(path: str):
    """(file system, paths with sizes) below a path that may be a file, a folder or a URI."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    told = system.get_file_info(base)
    if told.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [told] if told.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True))
    return system, [(f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]


def ranges(sizes: list[tuple[str, int]], most: int) -> list[Range]:
    """Ranges of at most `most` bytes; one for a compressed file."""
    out = []
    for path, size in sorted(sizes):
        step = max(1, size) if path.endswith(".gz") else most
        out += [Range(path, a, min(size, a + step)) for a in range(0, size, step)]
    return out


def lines_of(stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in [start, end): a line that begins before belongs to the range before."""
    at = start
    if start:
        stream.seek(start - 1)
        at = start - 1 + len(stream.readline())
    while at < end:
        line = stream.readline()
        if not line:
            return
        yield at, line
        at += len(line)


class RoadReader(DataSourceReader):
    def __init__(self, path: str, kind: str, most: int):
        self.path, self.kind, self.most = path, kind, most
        self.tags: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on `tag` are done here, others by Spark."""
        for f in filters:
            told = {f.value} if isinstance(f, EqualTo) and f.attribute == ("tag",) else set(f.value) if isinstance(f, In) and f.attribute == ("tag",) else None
            if told is None:
                yield f
            else:
                self.tags = told if self.tags is None else self.tags & told

    def partitions(self) -> list[Range]:
        return ranges(_files(self.path)[1], self.most) or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator:
        """Batches of columns, so that rows don't go to Spark one by one."""
        from itertools import islice

        import pyarrow as pa

        types = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
        names, kinds = zip(*(c.split(" ") for c in KINDS[self.kind][2].split(", ")))
        rows = self._rows(part)
        while held := list(islice(rows, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*held), kinds)], names=list(names))

    def _rows(self, part: Range) -> Iterator[tuple]:
        if not part.path:
            return
        tag, fields, _ = KINDS[self.kind]
        wanted = [tag] if tag else None if self.tags is None else sorted(self.tags)
        starts = None if wanted is None else tuple(t.encode() + b" " for t in wanted)
        system, _ = _files(self.path)
        with _opened(system, part) as stream:
            for at, line in lines_of(stream, part.start, part.end if not part.path.endswith(".gz") else 1 << 62):
                if starts is not None and not line.startswith(starts):
                    continue
                words = line.decode("utf-8").split()
                if words:
                    yield (part.path, at, *self._row(words, line, fields))

    def _row(self, words: list[str], line: bytes, fields: int) -> tuple:
        if fields and len(words) != fields:
            raise ValueError(f"not {fields} fields: {line!r}")
        if self.kind == "points":
            return int(words[1]), int(words[2]) / MILLIONTHS, int(words[3]) / MILLIONTHS
        if self.kind == "arcs":
            return int(words[1]), int(words[2]), float(words[3])
        if self.kind == "problem":
            is_points = words[1] == "aux"
            number = lambda k: int(words[k]) if k < len(words) else None
            return ("points", number(4), None) if is_points else ("arcs", number(2), number(3))
        return words[0], " ".join(words[1:])


def _opened(system, part: Range):
    import gzip
    import io

    if part.path.endswith(".gz"):
        return gzip.open(system.open_input_stream(part.path, compression=None))
    return io.BufferedReader(system.open_input_file(part.path), 1 << 20)


class RoadSource(DataSource):
    """Options: path, kind (points, arcs, problem, lines) and rangeBytes, the size of a task's range."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _kind(self) -> str:
        kind = self.options.get("kind", "lines")
        if kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        return kind

    def schema(self) -> str:
        return KINDS[self._kind()][2]

    def reader(self, schema) -> RoadReader:
        return RoadReader(self.options["path"], self._kind(), int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE_BYTES))))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and filters travel to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RoadSource)


def read_roads(spark: SparkSession, path: str, kind: str, range_bytes: int = RANGE_BYTES):
    register(spark)
    return spark.read.format(FORMAT).option("kind", kind).option("rangeBytes", str(range_bytes)).load(path)
