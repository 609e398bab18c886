"""Shortest paths for tables of queries.

`arrow` sends the graph's compressed rows to every executor, if they are within a checked size, and searches there,
all queries of one origin together. `files` does the same with rows that Spark has written to the shared folder, so the
driver holds none of them; its bound is what a machine maps. `relax` keeps the graph and all searches in tables (see `stepping`), with no bound
on the graph but with many rounds on long paths. Both give the same rows.

Searches in executors go many at a time (see `meeting`); where weights are zero or points lead, one by one.

Of equally short paths the one is taken that, walked back from the destination, always goes to the smallest node id;
where weights of zero occur, fewer edges come first.
"""

from __future__ import annotations

import heapq
import math
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..plans.stable import Tables, stable, tidy_shuffles
from ..schemas import PATH_STEPS, PATHS
from . import stepping
from .graph import adjacency
from .meeting import Searches

#: Undirected edges up to which the graph is sent to executors: 24 bytes each way, 96 MB at most.
MOST_BROADCAST_EDGES = 2_000_000
#: Undirected edges up to which executors have it as files: 20 bytes each way, mapped once a machine, 2.6 GB at most, 1.5 GB where 32 bits hold weights and edge numbers.
MOST_FILE_EDGES = 64_000_000
#: Rows (an edge has two) of one file, about.
ROWS_PER_FILE = 1_000_000
#: Where weights are zero or points lead: destinations of one origin up to which each is searched for from both ends; more share one search.
MOST_PAIRWISE = 4
MOST_ROUNDS = 100_000


class Rows:
    """Compressed adjacency rows over sorted node ids, the lightest edge of a node first."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, edge: np.ndarray):
        if len(weight) and weight.min() < 0:
            raise ValueError("weights must not be negative")
        a, b, w = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([weight, weight])
        self.ids = np.unique(a)
        order = np.lexsort((b, w, a))
        self.starts = np.append(np.searchsorted(a[order], self.ids), len(a))
        self.to, self.weight = np.searchsorted(self.ids, b[order]), w[order]
        self.edge = np.concatenate([edge, edge])[order]
        self.has_zero = bool(len(weight)) and float(weight.min()) == 0
        self.led, self.scale, self.width = None, 0.0, None

    def place(self, node: int) -> int:
        k = int(np.searchsorted(self.ids, node))
        return k if k < len(self.ids) and self.ids[k] == node else -1

    def places(self, nodes: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.full(len(nodes), -1)
        k = np.minimum(np.searchsorted(self.ids, nodes), len(self.ids) - 1)
        return np.where(self.ids[k] == nodes, k, -1)

    @property
    def searches(self) -> Searches:
        """For searches of many queries at once; kept, as its tables are large."""
        if getattr(self, "_searches", None) is None:
            self._searches = self._joined()
        return self._searches

    def _joined(self) -> Searches:
        return Searches([(self.starts, self.to.astype(np.int32), self.weight, self.edge)], len(self.ids))

    def nodes(self, places: list[int]) -> np.ndarray:
        return self.ids[places]

    def row(self, u: int) -> tuple[list[int], list[float]]:
        """Neighbours and weights; as lists, which are several times as fast as arrays for one element at a time."""
        a, b = int(self.starts[u]), int(self.starts[u + 1])
        return self.to[a:b].tolist(), self.weight[a:b].tolist()

    def edges(self, u: int) -> list[int]:
        """Numbers of the edges in `row`."""
        return self.edge[int(self.starts[u]) : int(self.starts[u + 1])].tolist()

    def lead(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray, scale: float) -> None:
        """From now on searches are led by coordinates; ids ascend."""
        self.led, self.scale = (ids, x, y), scale

    def _at(self, u: int) -> tuple[float, float]:
        ids, x, y = self.led
        node = int(self.nodes([u])[0])
        k = int(np.searchsorted(ids, node))
        return (float(x[k]), float(y[k])) if k < len(ids) and ids[k] == node else (math.nan, math.nan)

    def reach(self, origin: int, goals: set[int] | None) -> dict[int, tuple[float, int]]:
        """Place -> (distance, edges) from the origin, final for all goals and all nodes that are nearer; for all nodes without goals.

        With one goal and coordinates nearer-looking nodes come first: distance so far plus `scale` times the straight line.
        """
        done: dict[int, tuple[float, int]] = {}
        best = {origin: (0.0, 0)}
        left = None if goals is None else set(goals)
        ahead = self._ahead(next(iter(goals)) if goals is not None and len(goals) == 1 else None)
        heap = [(ahead(origin), 0.0, 0, origin)]
        limit = math.inf
        while heap and heap[0][0] <= limit:
            _, d, hops, u = heapq.heappop(heap)
            if u in done:
                continue
            done[u] = (d, hops)
            if left is not None:
                left.discard(u)
                if not left and limit == math.inf:
                    limit = d  # others as near may still be on a tied path
            for v, w in zip(*self.row(u)):
                if v in done:
                    continue
                got = (d + w, hops + 1)
                if v not in best or got < best[v]:
                    best[v] = got
                    heapq.heappush(heap, (got[0] + ahead(v), *got, v))
        return done

    def spread(self, origin: int) -> tuple[np.ndarray, np.ndarray]:
        """Places that the origin reaches and their distances, as `reach` finds them without goals, by whole frontiers.

        All waiting nodes within a bucket's width of the nearest go on together; a node that is improved later waits again.
        """
        best = np.full(len(self.ids), np.inf)
        best[origin] = 0.0
        if self.width is None:
            degree = len(self.to) / max(1, len(self.ids))
            self.width = 4 * float(self.weight.mean()) / max(1.0, degree) if len(self.weight) else 0.0
        waiting = np.array([origin])
        while len(waiting):
            near = best[waiting] <= best[waiting].min() + self.width
            active, waiting = waiting[near], waiting[~near]
            first = self.starts[active]
            count = self.starts[active + 1] - first
            at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
            to, far = self.to[at], np.repeat(best[active], count) + self.weight[at]
            less = far < best[to]
            to, far = to[less], far[less]
            np.minimum.at(best, to, far)
            waiting = np.unique(np.concatenate([waiting, to]))
        found = np.flatnonzero(best < np.inf)
        return found, best[found]

    def reach_from(self, starts: dict[int, float]) -> dict[int, float]:
        """Place -> distance of all nodes, from places that begin with a distance of their own."""
        best, done, heap = dict(starts), {}, [(d, u) for u, d in starts.items()]
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done[u] = d
            for v, w in zip(*self.row(u)):
                if d + w < best.get(v, math.inf):
                    best[v] = d + w
                    heapq.heappush(heap, (d + w, v))
        return done

    def between(self, origin: int, goal: int) -> dict[int, tuple[float, int]]:
        """Place -> (distance, 0) from the origin, final for the goal and every node on a shortest path to it; no goal if there is none.

        What the goal's search has settled is settled from the origin too, where it leaves room for the length. Weights are above zero.
        """
        length, done, crossing = self._meet({origin: 0.0}, {goal: 0.0}, *((self._ahead(goal), self._ahead(origin)) if self.led else ()))
        if length == math.inf:
            return {}
        cap, (mine, theirs) = length * (1 + 1e-12), done
        heap = [(d, v) for d, v in crossing if d + theirs[v] <= cap]
        heapq.heapify(heap)
        while heap:
            d, v = heapq.heappop(heap)
            if v in mine:
                continue
            mine[v] = d
            for x, w in zip(*self.row(v)):
                if x in theirs and x not in mine and d + w + theirs[x] <= cap:
                    heapq.heappush(heap, (d + w, x))
        return {u: (d, 0) for u, d in mine.items()}

    def length(self, starts: dict[int, float], goals: dict[int, float]) -> float:
        """The least distance from any start to any goal, both of which have a distance of their own; infinite if there is no way."""
        return self._meet(starts, goals)[0]

    def _meet(self, starts: dict[int, float], goals: dict[int, float], ahead=None, behind=None):
        """Length of the shortest way, what both ends have settled, and (distance, place) of steps from one to the other.

        A settled node waits with its lightest edge that was not followed yet, so a search follows about as many edges as it
        settles nodes. When the radii add up to more than a way that was met, each shortest way lies within both: it leaves the one
        by an edge into the other, maybe one that none has followed, and these are looked at in the end. `ahead` and `behind`
        tell how far it is at least from a node to the other end; what can't be on a way as short is not followed.
        """
        done: tuple[dict[int, float], dict[int, float]] = ({}, {})
        rows: tuple[dict, dict] = ({}, {})
        heaps = [[(d, u, -1, 0) for u, d in ends.items()] for ends in (starts, goals)]
        for heap in heaps:
            heapq.heapify(heap)
        met, least = math.inf, (ahead, behind)
        push, pop = heapq.heappush, heapq.heappop
        while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= met:
            side = 0 if len(done[0]) <= len(done[1]) else 1
            mine, theirs, heap = done[side], done[1 - side], heaps[side]
            d, v, u, i = pop(heap)
            if u >= 0:
                to, weight = rows[side][u]
                i += 1
                if i < len(to):
                    far, x = mine[u] + weight[i], to[i]
                    push(heap, (far, x, u, i))
                    if x in theirs and far + theirs[x] < met:
                        met = (far + theirs[x]) * (1 + 1e-12)
            if v in mine:
                continue
            mine[v] = d
            if v in theirs and d + theirs[v] < met:
                met = (d + theirs[v]) * (1 + 1e-12)
            if least[side] is not None and met < math.inf and d + least[side](v) > met:
                rows[side][v] = ([], [])
                continue
            to, weight = rows[side][v] = self.row(v)
            if to:
                far, x = d + weight[0], to[0]
                push(heap, (far, x, v, 0))
                if x in theirs and far + theirs[x] < met:
                    met = (far + theirs[x]) * (1 + 1e-12)
        mine, theirs = done
        # where one end has nothing left, it may be that the other has not yet come to all it starts from
        ends = [d + told[u] for some, told in ((goals, mine), (starts, theirs)) for u, d in some.items() if u in told]
        best, crossing = min([*ends, *(d + theirs[u] for u, d in mine.items() if u in theirs)], default=math.inf), []
        met = min(met, best * (1 + 1e-12))
        if met == math.inf:
            return met, done, []
        for u, d in mine.items():
            room = met - d
            for v, w in zip(*rows[0][u]):
                if w > room:
                    break
                if v in theirs and v not in mine and w + theirs[v] <= room:
                    crossing.append((d + w, v))
                    best = min(best, d + w + theirs[v])
        return best, done, crossing

    def _ahead(self, goal: int | None):
        """Least distance from a place to the goal; 0 without coordinates."""
        if self.led is None or not self.scale or goal is None:
            return lambda v: 0.0
        x, y = self._at(goal)

        def ahead(v: int) -> float:
            a, b = self._at(v)
            line = self.scale * math.hypot(a - x, b - y) * (1 - 1e-9)
            return 0.0 if math.isnan(line) else line

        return ahead

    def back(self, done: dict[int, tuple[float, int]], origin: int, goal: int) -> tuple[list[int], list[int]]:
        """Nodes and edges of the path, from the destination back by smallest id."""
        nodes, edges, v = [goal], [], goal
        while v != origin:
            d, hops = done[v]
            fits = [(u, k) for k, (u, w) in enumerate(zip(*self.row(v))) if u != v and u in done and done[u][0] + w == d and (not self.has_zero or done[u][1] + 1 == hops)]
            if not fits:
                raise AssertionError("a settled node without a predecessor")
            u, k = min(fits)
            edges.append(self.edges(v)[k])
            nodes.append(u)
            v = u
        return self.nodes(nodes[::-1]).tolist(), edges[::-1]


class FileRows(Rows):
    """Rows in files of the shared folder, `block` nodes each. Local files are mapped, so all workers of a machine share one copy."""

    def __init__(self, base: str, parts: int, block: int, has_zero: bool):
        self.block, self.has_zero, self.led, self.scale = block, has_zero, None, 0.0
        self.parts = [self._opened(f"{base}/{_part_name(k)}") for k in range(parts)]
        self.firsts = np.array([p[0][0] for p in self.parts], np.int64)

    @staticmethod
    def _opened(uri: str) -> tuple[np.ndarray, ...]:
        """ids, starts, weight, edge, to."""
        data = _mapped(uri)
        n, m, *kinds = (int(x) for x in data[:32].view(np.int64))
        out, at = [], 32
        for kind, size in ((np.int64, n), (np.int64, n + 1), (WEIGHT_KINDS[kinds[0]], m), (EDGE_KINDS[kinds[1]], m), (np.int32, m)):
            stop = at + size * np.dtype(kind).itemsize
            out.append(np.asarray(data[at:stop]).view(kind))
            at = stop + -stop % 8
        return tuple(out)

    def place(self, node: int) -> int:
        k = int(np.searchsorted(self.firsts, node, side="right")) - 1
        if k < 0:
            return -1
        ids = self.parts[k][0]
        at = int(np.searchsorted(ids, node))
        return k * self.block + at if at < len(ids) and ids[at] == node else -1

    def places(self, nodes: np.ndarray) -> np.ndarray:
        out, part = np.full(len(nodes), -1), np.searchsorted(self.firsts, nodes, side="right") - 1
        for k in np.unique(part[part >= 0]).tolist():
            own, ids = np.flatnonzero(part == k), self.parts[k][0]
            at = np.minimum(np.searchsorted(ids, nodes[own]), len(ids) - 1)
            out[own] = np.where(ids[at] == nodes[own], k * self.block + at, -1)
        return out

    def _joined(self) -> Searches:
        return Searches([(starts, to, weight, edge) for _, starts, weight, edge, to in self.parts], self.block)

    def nodes(self, places: list[int]) -> np.ndarray:
        at = np.asarray(places, np.int64)
        out, part = np.zeros(len(at), np.int64), at // self.block
        for k in np.unique(part).tolist():
            own = part == k
            out[own] = self.parts[k][0][at[own] - k * self.block]
        return out

    def row(self, u: int) -> tuple[list[int], list[float]]:
        k, j = divmod(u, self.block)
        _, starts, weight, _, to = self.parts[k]
        a, b = starts[j : j + 2].tolist()
        return to[a:b].tolist(), weight[a:b].tolist()

    def edges(self, u: int) -> list[int]:
        k, j = divmod(u, self.block)
        _, starts, _, edge, _ = self.parts[k]
        a, b = starts[j : j + 2].tolist()
        return edge[a:b].tolist()


def _part_name(k: int) -> str:
    return f"rows-{k:06d}.bin"


def _mapped(uri: str) -> np.ndarray:
    """Bytes of a file; a local one is mapped."""
    files, path = fs.FileSystem.from_uri(uri)
    return np.memmap(path, np.uint8, "r") if files.type_name == "local" else np.frombuffer(files.open_input_file(path).readall(), np.uint8)


def _put(base: str, name: str, arrays: list[np.ndarray]) -> None:
    """One file of arrays, each from a multiple of eight bytes on. It has its name when it is whole, so a task may run twice."""
    files, folder = fs.FileSystem.from_uri(base)
    files.create_dir(folder)
    own = f"{folder}/{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        for x in arrays:
            data = np.ascontiguousarray(x).tobytes()
            out.write(data + bytes(-len(data) % 8))
    files.move(own, f"{folder}/{name}")


#: What weights and edge numbers are kept as: the first kind that has all of them exactly.
WEIGHT_KINDS, EDGE_KINDS = (np.float32, np.float64), (np.int32, np.int64)


def _kind(values: np.ndarray, kinds: tuple) -> int:
    return 0 if np.array_equal(values.astype(kinds[0]), values) else 1


def _packed(values: np.ndarray) -> bytes:
    """Some integers in as few bytes as their range takes; numbers that are not whole as they are."""
    if values.dtype.kind == "f" and not (np.all(np.abs(values) < 1 << 52) and np.array_equal(np.floor(values), values)):
        return b"f" + values.astype(np.float64).tobytes()
    values = values.astype(np.int64)
    low = int(values.min())
    kind = np.min_scalar_type(int(values.max()) - low)
    return kind.char.encode() + np.int64(low).tobytes() + (values - low).astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if data[:1] == b"f":
        return np.frombuffer(data, np.float64, offset=1)
    return np.frombuffer(data, np.dtype(data[:1].decode()), offset=9).astype(np.int64) + int(np.frombuffer(data[1:9], np.int64)[0])


@lru_cache(maxsize=64)
def mapped_longs(uri: str) -> np.ndarray:
    """64-bit numbers in a file."""
    return _mapped(uri).view(np.int64)


def put_longs(base: str, name: str, values: np.ndarray) -> None:
    _put(base, name, [values.astype(np.int64)])


class Places:
    """Sorted node ids in files of the shared folder; the place of an id is its rank."""

    def __init__(self, base: str, names: list[str], firsts: list[int], sizes: list[int]):
        self.base, self.names = base, names
        self.firsts, self.starts = np.array(firsts, np.int64), np.cumsum([0, *sizes])

    def part(self, k: int) -> np.ndarray:
        return mapped_longs(f"{self.base}/{self.names[k]}")

    def of(self, nodes: np.ndarray) -> np.ndarray:
        """Places of ids, all of which are known."""
        part = np.searchsorted(self.firsts, nodes, side="right") - 1
        out = np.zeros(len(nodes), np.int64)
        for k in np.unique(part).tolist():
            own = part == k
            out[own] = np.searchsorted(self.part(k), nodes[own]) + self.starts[k]
        return out

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids of places from start to stop."""
        first, last = np.searchsorted(self.starts, [start, stop - 1], side="right") - 1
        parts = [self.part(k)[max(0, start - self.starts[k]) : stop - self.starts[k]] for k in range(first, last + 1)]
        return np.concatenate(parts)


class GraphFiles:
    """A graph that Spark has written as FileRows; `value` opens it, once a worker.

    Node ids are sorted into files first, which workers map to tell places, so edges meet no table of nodes. Both ways of an
    edge then go to their file in one shuffle, packed by file and batch.
    """

    def __init__(self, undirected: DataFrame):
        spark = undirected.sparkSession
        edges = undirected.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("double"), F.col("edge_index").cast("long")).where("src IS NOT NULL AND dst IS NOT NULL")
        m, least = edges.agg(2 * F.count("*"), F.min("weight")).first()
        if least is not None and least < 0:
            raise ValueError("weights must not be negative")
        self.base, self.has_zero = Tables(spark, "graph").base, least == 0
        places = self._places(edges)
        n = int(places.starts[-1])
        self.block = max(1, math.ceil(n / max(1, math.ceil(m / ROWS_PER_FILE))))
        self.parts = math.ceil(n / self.block)
        self._write(edges, places)

    def _places(self, edges: DataFrame) -> Places:
        base = self.base

        def run(batches):
            ids = [x for batch in batches if len(x := batch["node"].to_numpy())]
            if ids:
                name = f"ids-{uuid.uuid4().hex}.bin"
                _put(base, name, [(told := np.sort(np.concatenate(ids)))])
                yield pd.DataFrame({"name": [name], "first": told[0], "size": len(told)})

        nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().orderBy("node")
        with tidy_shuffles(edges.sparkSession):
            told = sorted((r["first"], r["name"], r["size"]) for r in nodes.mapInPandas(run, "name string, first long, size long").collect())  # one row a partition
        return Places(base, [x[1] for x in told], [x[0] for x in told], [x[2] for x in told])

    def _write(self, edges: DataFrame, places: Places) -> None:
        base, block, n = self.base, self.block, int(places.starts[-1])

        def pack(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                src, dst, weight, edge = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("src", "dst", "weight", "edge_index"))
                p, q = places.of(src), places.of(dst)
                u, v, w, e = np.concatenate([p, q]), np.concatenate([q, p]), np.concatenate([weight, weight]), np.concatenate([edge, edge])
                order = np.lexsort((v, u))
                u, v, w, e = u[order], v[order], w[order], e[order]
                part = u // block
                cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(u))
                rows = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                packed = [pa.array([_packed(x[a:b]) for a, b in rows], pa.binary()) for x in (u, v, w, e)]
                yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]], pa.int64()), *packed], names=["part", "u", "v", "w", "e"])

        def put(rows: pa.Table) -> pa.Table:
            part = rows.column("part")[0].as_py()
            u, v, weight, edge = (np.concatenate([_unpacked(x) for x in rows.column(c).to_pylist()]) for c in ("u", "v", "w", "e"))
            weight = weight.astype(np.float64)
            order = np.lexsort((v, weight, u))
            first = np.flatnonzero(np.diff(u[order], prepend=-1))
            node = places.ids(part * block, min(n, (part + 1) * block))
            kinds = [_kind(weight, WEIGHT_KINDS), _kind(edge, EDGE_KINDS)]
            rest = [weight[order].astype(WEIGHT_KINDS[kinds[0]]), edge[order].astype(EDGE_KINDS[kinds[1]]), v[order].astype(np.int32)]
            _put(base, _part_name(part), [np.array([len(first), len(u), *kinds]), node, np.append(first, len(u)), *rest])
            return pa.table({"part": [part]})

        packed = edges.mapInArrow(pack, "part long, u binary, v binary, w binary, e binary")
        with tidy_shuffles(edges.sparkSession):
            written = packed.groupBy("part").applyInArrow(put, "part long").count()
        if written != self.parts:
            raise RuntimeError("not all files of the graph were written")

    @property
    def value(self) -> FileRows:
        if self.base not in _OPENED:
            _OPENED.clear()
            _OPENED[self.base] = FileRows(self.base, self.parts, self.block, self.has_zero)
        return _OPENED[self.base]


#: The graph that a worker has open.
_OPENED: dict[str, FileRows] = {}


def _collected_rows(undirected: DataFrame) -> Rows:
    table = undirected.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("double"), F.col("edge_index").cast("long")).toPandas()
    return Rows(*(table[c].to_numpy() for c in ("src", "dst", "weight", "edge_index")))


def shared_rows(undirected: DataFrame, method: str):
    """What has the graph's rows as `value` in tasks: a broadcast (`arrow`), or files (`files`)."""
    return undirected.sparkSession.sparkContext.broadcast(_collected_rows(undirected)) if method == "arrow" else GraphFiles(undirected)


def method_for(undirected: DataFrame) -> str:
    """`arrow` up to MOST_BROADCAST_EDGES, `files` up to MOST_FILE_EDGES, else `relax`."""
    edges = undirected.limit(MOST_FILE_EDGES + 1).count() if not _fits(undirected) else 0
    return "arrow" if not edges else "files" if edges <= MOST_FILE_EDGES else "relax"


def admissible_scale(points: DataFrame, undirected: DataFrame) -> DataFrame:
    """One row `scale`: the least weight for a unit of straight distance over all edges; a straight line times it is never too far."""
    at = points.select("id", "x_loc", "y_loc")
    both = undirected.join(at.toDF("src", "x1", "y1"), "src").join(at.toDF("dst", "x2", "y2"), "dst")
    line = F.sqrt((F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2")) + (F.col("y1") - F.col("y2")) * (F.col("y1") - F.col("y2")))
    return both.withColumn("line", line).where("line > 0").agg(F.coalesce(F.min(F.col("weight") / F.col("line")), F.lit(0.0)).alias("scale"))


def _fits(table: DataFrame) -> bool:
    return table.limit(MOST_BROADCAST_EDGES + 1).count() <= MOST_BROADCAST_EDGES


def trace_paths(undirected: DataFrame, queries: DataFrame, method: str = "auto", points: DataFrame | None = None, scale: float = 0.0, tasks: int | None = None) -> DataFrame:
    """(query_id, origin, destination, count, reachable, distance, nodes, edges) for each query.

    Unreachable queries have a null distance and empty lists. An origin that is its destination has distance 0,
    one node and no edge, even if no edge names it. With `points` and `scale` the search is led towards the destination;
    more points than the checked size are not sent, which changes no row. `tasks` sets how many tasks search.
    """
    if method == "auto":
        method = method_for(undirected)
    if points is not None and (method == "relax" or not _fits(points)):
        points = None
    asked = queries.select(*(F.col(c).cast("long") for c in ("query_id", "origin", "destination", "count")))
    return _trace_relax(undirected, asked) if method == "relax" else _trace_arrow(undirected, asked, method, points, scale, tasks)


#: Searches of a task and queries of an origin that one task answers, about.
SEARCHES_PER_TASK, QUERIES_PER_TASK = 200, 20_000
TASKS_PER_CORE = 4


def _dealt(rows: DataFrame, by: str, tasks: int | None = None) -> DataFrame:
    """Rows dealt to tasks by the column: enough tasks for all cores, and more where there are more searches than they should take.

    The number is given, so adaptive execution doesn't merge tasks that are small in bytes but long in searches. An origin
    with more queries than a task should answer is searched from in several.
    """
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"))
    told = sizes.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = tasks or max(1, min(told[0], max(TASKS_PER_CORE * cores, told[0] // SEARCHES_PER_TASK)))
    if told[1] <= QUERIES_PER_TASK:
        return rows.repartition(tasks, by)
    hot = sizes.where(F.col("n") > QUERIES_PER_TASK).withColumn("_parts", F.ceil(F.col("n") / QUERIES_PER_TASK)).drop("n")
    extra = hot.agg(F.sum("_parts")).first()[0]
    part = F.pmod(F.xxhash64(*rows.columns), F.coalesce("_parts", F.lit(1)))
    return rows.join(hot, by, "left").withColumn("_part", part).repartition(tasks + extra, by, "_part").select(*rows.columns)


def _trace_arrow(undirected: DataFrame, asked: DataFrame, method: str, points: DataFrame | None, scale: float, tasks: int | None) -> DataFrame:
    shared, most, led = shared_rows(undirected, method), MOST_PAIRWISE, None
    has_zero = shared.has_zero if isinstance(shared, GraphFiles) else shared.value.has_zero
    if not has_zero and (points is None or not scale):
        return _trace_met(shared, asked, tasks)
    if points is not None and scale:
        p = points.groupBy(F.col("id").cast("long").alias("id")).agg(F.min(F.struct("x_loc", "y_loc")).alias("p")).select("id", "p.*").toPandas().sort_values("id")
        led = undirected.sparkSession.sparkContext.broadcast(tuple(p[c].to_numpy() for c in ("id", "x_loc", "y_loc")))

    def run(batches):
        rows = shared.value
        rows.led = None
        if led is not None:
            rows.lead(*led.value, scale)
        for batch in batches:
            out = []
            for origin, group in batch.groupby("origin"):
                start = rows.place(origin)
                goals = {p for x in group["destination"] if x != origin and (p := rows.place(x)) >= 0}
                pairwise = not rows.has_zero and len(goals) <= most
                shared_search = rows.reach(start, goals) if start >= 0 and goals and not pairwise else {}
                for q in group.itertuples(index=False):
                    goal = rows.place(q.destination)
                    done = rows.between(start, goal) if pairwise and start >= 0 and goal >= 0 and goal != start else shared_search
                    if q.origin == q.destination:
                        out.append((q.query_id, q.origin, q.destination, q.count_, True, 0.0, [q.origin], []))
                    elif goal in done:
                        out.append((q.query_id, q.origin, q.destination, q.count_, True, done[goal][0], *rows.back(done, start, goal)))
                    else:
                        out.append((q.query_id, q.origin, q.destination, q.count_, False, None, [], []))
            yield pd.DataFrame(out, columns=["query_id", "origin", "destination", "count", "reachable", "distance", "nodes", "edges"])

    return _dealt(asked.withColumnRenamed("count", "count_"), "origin", tasks).sortWithinPartitions("origin", "query_id").mapInPandas(run, PATHS)


def _trace_met(shared, asked: DataFrame, tasks: int | None) -> DataFrame:
    """Many queries at a time from both ends. Those with a common end go to one task, by origins or by destinations, whichever are fewer."""

    def run(batches):
        rows = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            origin, goal = (batch.column(c).to_numpy() for c in ("origin", "destination"))
            start, end = rows.places(origin), rows.places(goal)
            same, told = origin == goal, np.full(len(origin), np.inf)
            sought = np.flatnonzero(~same & (start >= 0) & (end >= 0))
            nodes, edges = [[x] if own else [] for x, own in zip(origin.tolist(), same.tolist())], [[]] * len(origin)
            if len(sought):
                told[sought], places, used = rows.searches.paths(start[sought], end[sought])
                cuts = np.cumsum([len(x) for x in places])[:-1]
                for k, x, e in zip(sought.tolist(), np.split(rows.nodes(np.concatenate(places)), cuts), used):
                    nodes[k], edges[k] = x, e.astype(np.int64)
            told[same] = 0.0
            found = told < np.inf
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (nodes, edges)]
            columns = [*(batch.column(c) for c in ("query_id", "origin", "destination", "count")), pa.array(found), pa.array(told, mask=~found), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "origin", "destination", "count", "reachable", "distance", "nodes", "edges"])

    one, two = asked.agg(F.count_distinct("origin"), F.count_distinct("destination")).first()
    by, other = ("origin", "destination") if one <= two else ("destination", "origin")
    return _dealt(asked, by, tasks).sortWithinPartitions(by, other, "query_id").mapInArrow(run, PATHS)


def distances(undirected: DataFrame, sources: DataFrame, method: str = "auto") -> DataFrame:
    """(src, node, distance) for all nodes that each source (column `src`) reaches, itself with 0."""
    sources = sources.select(F.col("src").cast("long")).distinct()
    if method == "auto":
        method = method_for(undirected)
    if method == "relax":
        return _distances_relax(adjacency(undirected), sources).select("src", "node", "distance")
    shared = shared_rows(undirected, method)

    def run(batches):
        rows = shared.value
        rows.led = None
        for batch in batches:
            for src in batch["src"].tolist():
                start = rows.place(src)
                if start < 0:
                    nodes, told = np.array([src]), np.zeros(1)
                elif isinstance(rows, FileRows):
                    done = rows.reach(start, None)
                    nodes, told = rows.nodes(list(done)), np.array([d for d, _ in done.values()])
                else:
                    found, told = rows.spread(start)
                    nodes = rows.nodes(found)
                yield pd.DataFrame({"src": src, "node": nodes, "distance": told})

    return _dealt(sources, "src").mapInPandas(run, "src long, node long, distance double")


def _distances_relax(adj: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, node, distance, hops) by delta-stepping over files."""
    return stepping.distances(adj, sources.select("src", F.col("src").alias("node"), F.lit(0.0).alias("distance"), F.lit(0).cast("long").alias("hops")))


def _trace_relax(undirected: DataFrame, asked: DataFrame) -> DataFrame:
    """Searches from both ends in tables, each pair of ends once, then back from the destinations step by step."""
    adj, pair = adjacency(undirected), list(stepping.PAIR)
    has_zero = not undirected.where("weight = 0").isEmpty()
    search = stepping.BothEnds(adj, asked)
    known = search.forward()
    ends = known.where("node = destination").select(*pair, "distance", "hops")
    told = asked.join(ends, pair, "left")
    told = told.withColumn("distance", F.when(F.col("origin") == F.col("destination"), F.lit(0.0)).otherwise(F.col("distance")))
    told = stable(told.withColumn("reachable", F.col("distance").isNotNull()))
    here = stable(ends.select(*pair, F.col("destination").alias("at"), "distance", "hops", F.lit(0).alias("back"), F.lit(None).cast("long").alias("edge")))
    walked = here
    pick = F.struct("nbr", "edge_index", "d0", "h0")
    for k in range(1, MOST_ROUNDS):
        moving = here.where("at <> origin")
        if moving.isEmpty():
            break
        near = moving.join(adj.select(F.col("node").alias("at"), "nbr", "weight", "edge_index"), "at").where("nbr <> at")
        prior = known.select(*pair, F.col("node").alias("nbr"), F.col("distance").alias("d0"), F.col("hops").alias("h0"))
        fits = near.join(prior, [*pair, "nbr"]).where("d0 + weight = distance" + (" AND h0 + 1 = hops" if has_zero else ""))
        chosen = fits.groupBy(*pair).agg(F.min(pick).alias("c"))
        here = stable(chosen.select(*pair, F.col("c.nbr").alias("at"), F.col("c.d0").alias("distance"), F.col("c.h0").alias("hops"), F.lit(k).alias("back"), F.col("c.edge_index").alias("edge")))
        walked = walked.unionByName(here)
    lists = walked.groupBy(*pair).agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("o"), "at", "edge"))).alias("s"))
    own = F.when(F.col("origin") == F.col("destination"), F.array("origin")).otherwise(F.array().cast("array<long>"))
    out = told.join(lists, pair, "left")
    return out.select("query_id", "origin", "destination", "count", "reachable", "distance", F.coalesce(F.col("s.at"), own).alias("nodes"), F.coalesce(F.filter("s.edge", lambda e: e.isNotNull()), F.array().cast("array<long>")).alias("edges"))


def path_text(paths: DataFrame) -> DataFrame:
    """(query_id, origin, destination, distance, path): node ids joined by spaces."""
    return paths.select("query_id", "origin", "destination", "distance", F.array_join("nodes", " ").alias("path"))


class PathSteps:
    """Table function: a row for each node of a path, and the edge by which the path leaves it; the last has none."""

    @staticmethod
    def analyze(paths) -> "AnalyzeResult":
        from pyspark.sql.udtf import AnalyzeResult

        have = {f.name for f in paths.dataType.fields} if paths.isTable else set()
        if not {"query_id", "nodes", "edges"} <= have:
            raise ValueError("path_steps takes a table with query_id, nodes and edges")
        return AnalyzeResult(PATH_STEPS)

    def eval(self, row):
        edges = row["edges"]
        for pos, node in enumerate(row["nodes"]):
            yield row["query_id"], pos, node, edges[pos] if pos < len(edges) else None


def path_steps(paths: DataFrame) -> DataFrame:
    """(query_id, pos, node, edge_index) of traced paths (query_id, nodes, edges): nodes and edges in one pass."""
    return udtf(PathSteps)(paths.select("query_id", "nodes", "edges").asTable())


def register_path_steps(spark: SparkSession) -> None:
    """For SQL: SELECT * FROM path_steps(TABLE(paths))."""
    spark.udtf.register("path_steps", udtf(PathSteps))
