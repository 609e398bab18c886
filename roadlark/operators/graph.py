"""Graphs as a table of points and a table of edges.

Two readings of the same arcs live side by side. `build_graph` keeps one-way arcs directed and merges an arc and
its opposite of the same value into one undirected edge. `build_undirected` makes every arc passable both ways.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.stable import numbered
from ..schemas import POINTS


def _low(a: str = "u", b: str = "v") -> Column:
    return F.least(a, b)


def _high(a: str = "u", b: str = "v") -> Column:
    return F.greatest(a, b)


BUCKET = ("a", "b", "value")


def graph_state(arcs: DataFrame) -> DataFrame:
    """(a, b, value, first, up, down) of arcs (u, v, w) that may have `directed` (true) and `seq`, their order of arrival.

    A row for each bucket of equal ends and value, loops left out: its first arrival, and whether directed ones came
    either way. States merge in any order and grouping (`merge_states`).
    """
    rows = arcs.where("u <> v")
    directed = F.col("directed") if "directed" in arcs.columns else F.lit(True)
    seq = F.col("seq") if "seq" in arcs.columns else F.lit(0)
    rows = rows.select("u", "v", F.col("w").alias("value"), directed.alias("directed"), seq.alias("seq"))
    way = lambda c: F.coalesce(F.bool_or(F.when(F.col("directed"), c)), F.lit(False))
    return rows.groupBy(_low().alias("a"), _high().alias("b"), "value").agg(F.min(F.struct("seq", "directed", "u", "v")).alias("first"), way(F.col("u") < F.col("v")).alias("up"), way(F.col("u") > F.col("v")).alias("down"))


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all arrivals that the given states have seen."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy(*BUCKET).agg(F.min("first").alias("first"), F.bool_or("up").alias("up"), F.bool_or("down").alias("down"))


def edges_of(state: DataFrame) -> DataFrame:
    """(from_point, to_point, value, directed, seq): the edges that a state stands for, seq their first arrival.

    If a bucket's first arrival is undirected it stands as it is. If it is directed and its opposite arrived as well,
    one undirected edge with ascending ends; else the arc.
    """
    met = F.col("up") & F.col("down")
    merged = F.col("first.directed") & met
    return state.select(F.when(merged, F.col("a")).otherwise(F.col("first.u")).alias("from_point"), F.when(merged, F.col("b")).otherwise(F.col("first.v")).alias("to_point"), "value", (F.col("first.directed") & ~met).alias("directed"), F.col("first.seq").alias("seq"))


def build_graph(arcs: DataFrame) -> DataFrame:
    """(from_point, to_point, value, directed) of arcs (u, v, w) that may have `directed` (true) and `seq`, their order of
    arrival; with it also `seq`, the first arrival of each edge. One aggregation; arcs that are all directed need no order.
    """
    edges = edges_of(graph_state(arcs))
    return edges if "seq" in arcs.columns else edges.drop("seq")


class GrowingGraph:
    """A graph in a folder that points and arcs are added to: a batch writes its own state next to what is there.

    Reading merges the states. When there are more than `most` of them they are compacted into one; the new set of files
    is named in a small table that is written last, so a run that fails on the way changes nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, most: int = 16):
        self.spark, self.folder, self.most = spark, folder.rstrip("/"), most

    def _parts(self, kind: str) -> list[str]:
        """Folders of the current version of `edges` or `points`."""
        at, files = self._at(f"{self.folder}/{kind}")
        if not files.exists(at):
            return []
        versions = sorted((x.getPath().getName() for x in files.listStatus(at) if x.getPath().getName().startswith("v") and files.exists(self._at(f"{self.folder}/{kind}/{x.getPath().getName()}/_SUCCESS")[0])), key=lambda n: int(n[1:]))
        return [r[0] for r in self.spark.read.schema("part string").json(f"{self.folder}/{kind}/{versions[-1]}").collect()] if versions else []

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commit(self, kind: str, parts: list[str]) -> None:
        at, files = self._at(f"{self.folder}/{kind}")
        numbers = [int(x.getPath().getName()[1:]) for x in files.listStatus(at) if x.getPath().getName().startswith("v")] if files.exists(at) else []
        self.spark.createDataFrame([(p,) for p in parts], "part string").coalesce(1).write.json(f"{self.folder}/{kind}/v{max(numbers, default=0) + 1}")

    def _add(self, kind: str, rows: DataFrame, merged) -> None:
        part = f"{self.folder}/{kind}/part-{uuid.uuid4().hex}"
        rows.write.parquet(part)
        parts = [*self._parts(kind), part]
        if len(parts) > self.most:
            whole = f"{self.folder}/{kind}/part-{uuid.uuid4().hex}"
            merged(*[self.spark.read.parquet(p) for p in parts]).write.parquet(whole)
            parts = [whole]
        self._commit(kind, parts)

    def add_arcs(self, arcs: DataFrame) -> None:
        """Arcs as for build_graph, with `seq`; it orders arrivals over all batches."""
        self._add("edges", graph_state(arcs.withColumn("seq", F.col("seq").cast("long"))), merge_states)

    def add_points(self, points: DataFrame) -> None:
        """Points behind those that are there; ids are not compared."""
        self._add("points", points, lambda first, *rest: _all_rows(first, *rest))

    def edges(self) -> DataFrame:
        parts = self._parts("edges")
        if not parts:
            return self.spark.createDataFrame([], "from_point long, to_point long, value double, directed boolean, seq long")
        return edges_of(merge_states(*[self.spark.read.parquet(p) for p in parts]))

    def points(self) -> DataFrame:
        parts = self._parts("points")
        return _all_rows(*[self.spark.read.parquet(p) for p in parts]) if parts else self.spark.createDataFrame([], POINTS)

    def follow(self, arcs: DataFrame, checkpoint: str, **trigger):
        """Add the arcs of a stream, a batch at a time; a batch that comes again after a failure changes nothing, as states merge."""
        return arcs.writeStream.foreachBatch(lambda batch, _: self.add_arcs(batch)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _all_rows(first: DataFrame, *rest: DataFrame) -> DataFrame:
    for x in rest:
        first = first.unionByName(x)
    return first


def accepted_events(arcs: DataFrame) -> DataFrame:
    """Arrivals (u, v, w, directed, seq) with `accepted`: whether adding each in turn changes the graph."""
    bucket = [_low().alias("a"), _high().alias("b"), F.col("w").alias("bw")]
    rows = arcs.where("u <> v")
    first = rows.groupBy(*bucket).agg(F.min(F.struct("seq", "directed", "u", "v")).alias("first"))
    keyed = rows.select("*", *bucket)
    opposite = keyed.join(first, ["a", "b", "bw"]).where(F.col("first.directed") & F.col("directed") & (F.col("u") == F.col("first.v")))
    second = opposite.groupBy("a", "b", "bw").agg(F.min("seq").alias("second"))
    told = keyed.join(first, ["a", "b", "bw"]).join(second, ["a", "b", "bw"], "left")
    yes = (F.col("seq") == F.col("first.seq")) | F.coalesce(F.col("seq") == F.col("second"), F.lit(False))
    loops = arcs.where("u = v").select("u", "v", "w", "directed", "seq", F.lit(False).alias("accepted"))
    return told.select("u", "v", "w", "directed", "seq", yes.alias("accepted")).unionByName(loops)


def add_points(points: DataFrame, more: DataFrame) -> DataFrame:
    """Points and then more points; ids are not compared."""
    return points.unionByName(more)


def point_by_id(points: DataFrame, point_id: int) -> DataFrame:
    """The point, or no row."""
    return points.where(F.col("id") == point_id)


def point_at(points: DataFrame, position: int, order: list[str] | None = None) -> DataFrame:
    """The point at a position, from 1, in the order in which points were added (column `seq` or `line`, or as given); or no row.

    Ids are not looked at: where ids are 1, 2, .. in that order it is the point of that id, else it may be another.
    """
    by = order or [c for c in ("seq", "line") if c in points.columns] or ["id"]
    if position > MOST_TAKEN:
        return numbered(points, [F.col(c) for c in by], "_place", 1).where(F.col("_place") == position).drop("_place")
    first = points.orderBy(*by).limit(max(position, 0))
    return first.withColumn("_place", F.row_number().over(Window.orderBy(*by))).where(F.col("_place") == position).drop("_place")


#: Rows that a look-up by position may sort out in one task; beyond that rows are numbered by a distributed sort.
MOST_TAKEN = 10_000


def check_dense_ids(points: DataFrame) -> DataFrame:
    """One row: n, smallest, largest, distinct ids, and whether ids are 1..n once each, as positional look-ups presume."""
    told = points.agg(F.count("*").alias("n"), F.min("id").alias("smallest"), F.max("id").alias("largest"), F.countDistinct("id").alias("distinct_ids"))
    return told.withColumn("is_dense", (F.col("n") == F.col("distinct_ids")) & (F.coalesce("smallest", F.lit(1)) == 1) & (F.coalesce("largest", F.lit(0)) == F.col("n")))


def summary(points: DataFrame, edges: DataFrame, info: str = "") -> DataFrame:
    """One row of counters; edges without their points count as well."""
    told = edges.agg(F.count_if("directed").alias("num_directed_edges"), F.count_if(~F.col("directed")).alias("num_undirected_edges"), F.count("*").alias("num_total_edges"))
    return points.agg(F.count("*").alias("num_points")).withColumn("info", F.lit(info)).join(told, how="cross").select("info", "num_points", "num_directed_edges", "num_undirected_edges", "num_total_edges")


def _between(a: Column, b: Column, directed: bool | None) -> Column:
    way = F.col("directed") & (F.col("from_point") == a) & (F.col("to_point") == b)
    either = ~F.col("directed") & (_low("from_point", "to_point") == F.least(a, b)) & (_high("from_point", "to_point") == F.greatest(a, b))
    return way if directed is True else either if directed is False else way | either


def edges_between(edges: DataFrame, a: int, b: int, directed: bool | None = None) -> DataFrame:
    """Directed edges from a to b and undirected ones between them; `directed` narrows to one kind."""
    return edges.where(_between(F.lit(a), F.lit(b), directed))


def get_edge(edges: DataFrame, a: int, b: int, value: float | None = None, directed: bool | None = None) -> DataFrame:
    """One edge at most: directed ones before undirected ones, then the least value (and the first arrival where `seq` is there)."""
    found = edges_between(edges, a, b, directed)
    if value is not None:
        found = found.where(F.col("value") == value)
    return found.orderBy(F.desc("directed"), "seq" if "seq" in edges.columns else "value").limit(1)


def has_edges(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """Pairs (a, b), each once, with `found`: whether any edge leads from a to b. Two equi-joins, none over pairs of rows."""
    pairs = asked.select("a", "b").distinct()
    one_way = edges.where("directed").select(F.col("from_point").alias("a"), F.col("to_point").alias("b"))
    two_way = edges.where("NOT directed").select(F.explode(F.array(F.struct(F.col("from_point").alias("a"), F.col("to_point").alias("b")), F.struct(F.col("to_point").alias("a"), F.col("from_point").alias("b")))).alias("e")).select("e.*")
    there = one_way.unionByName(two_way).distinct().withColumn("found", F.lit(True))
    return pairs.join(there, ["a", "b"], "left").select("a", "b", F.coalesce("found", F.lit(False)).alias("found"))


def incidence(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, other, value, directed, is_out, is_in, and seq if edges have it): each edge at each of its ends, for edges whose ends are both points."""
    ids = points.select("id").distinct()
    linked = edges.join(ids.withColumnRenamed("id", "from_point"), "from_point", "left_semi").join(ids.withColumnRenamed("id", "to_point"), "to_point", "left_semi")
    at = lambda node, other, out, into: F.struct(F.col(node).alias("node"), F.col(other).alias("other"), "value", "directed", (F.lit(out) | ~F.col("directed")).alias("is_out"), (F.lit(into) | ~F.col("directed")).alias("is_in"), *(["seq"] if "seq" in edges.columns else []))
    return linked.select(F.explode(F.array(at("from_point", "to_point", True, False), at("to_point", "from_point", False, True))).alias("e")).select("e.*")


def out_edges(points: DataFrame, edges: DataFrame, node: int | None = None) -> DataFrame:
    found = incidence(points, edges).where("is_out")
    return found if node is None else found.where(F.col("node") == node)


def in_edges(points: DataFrame, edges: DataFrame, node: int | None = None) -> DataFrame:
    found = incidence(points, edges).where("is_in")
    return found if node is None else found.where(F.col("node") == node)


def neighbors(points: DataFrame, edges: DataFrame, node: int | None = None) -> DataFrame:
    """(node, neighbor), once for each outgoing edge: parallel edges repeat."""
    return out_edges(points, edges, node).select("node", F.col("other").alias("neighbor"))


def degrees(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, degree, in_degree, out_degree) of all points; degree is the out-degree, undirected edges count once in each."""
    told = incidence(points, edges).groupBy("node").agg(F.count_if("is_out").alias("o"), F.count_if("is_in").alias("i"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return points.select(F.col("id").alias("node")).distinct().join(told, "node", "left").select("node", zero("o").alias("degree"), zero("i").alias("in_degree"), zero("o").alias("out_degree"))


def edge_lists(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, out_edges, in_edges) with edges as lists, in order of arrival where edges have `seq`; for display, as a hub's list is one value."""
    edge = F.struct(*(["seq"] if "seq" in edges.columns else []), "other", "value", "directed")
    return incidence(points, edges).groupBy("node").agg(F.sort_array(F.collect_list(F.when(F.col("is_out"), edge))).alias("out_edges"), F.sort_array(F.collect_list(F.when(F.col("is_in"), edge))).alias("in_edges"))


def directed_edges(edges: DataFrame) -> DataFrame:
    return edges.where("directed")


def undirected_edges(edges: DataFrame) -> DataFrame:
    return edges.where("NOT directed")


def adjacency_of_arcs(arcs: DataFrame) -> DataFrame:
    """(u, neighbors): arcs as given, without any merging, in order of arrival where arcs have `seq`."""
    return arcs.groupBy("u").agg(F.sort_array(F.collect_list(F.struct(*(["seq"] if "seq" in arcs.columns else []), "v", "w"))).alias("neighbors"))


def build_undirected(arcs: DataFrame, order: str = "line") -> DataFrame:
    """(edge_index, src, dst, weight): each pair of ends and weight once, numbered from 0 by its first line. Loops stay."""
    distinct = arcs.groupBy(_low().alias("src"), _high().alias("dst"), F.col("w").alias("weight")).agg(F.min(order).alias("_first"))
    return numbered(distinct, [F.col("_first"), F.col("src"), F.col("dst"), F.col("weight")], "edge_index", columns=["src", "dst", "weight"]).select("edge_index", "src", "dst", "weight")


def adjacency(undirected: DataFrame) -> DataFrame:
    """(node, nbr, weight, edge_index): each edge both ways; a loop twice."""
    way = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("nbr"), "weight", "edge_index")
    return undirected.select(F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("e")).select("e.*")


#: Neighbours of a block, about; a node with more is met by pairs of blocks, each in a place of its own.
HUB_BLOCK = 2048


def wedge_blocks(steps: DataFrame, block: int = HUB_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Two tables (node, i, j, nbr) that meet on (node, i, j): all pairs of neighbours of each node, each pair in one such place.

    Neighbours are dealt into blocks by a hash, and a node of n blocks has n (n + 1) / 2 places with about two blocks
    of neighbours each, so a hub is as many places as its pairs call for and none is larger than a block by a block.
    """
    sizes = steps.groupBy("node").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = steps.join(sizes, "node").withColumn("own", F.pmod(F.xxhash64("nbr"), F.col("blocks")).cast("int"))
    left = dealt.select("node", F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("j"), "nbr")
    right = dealt.select("node", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"), "nbr")
    return left, right


def two_hop_neighbors(undirected: DataFrame, include_one_hop: bool = True, block: int = HUB_BLOCK) -> DataFrame:
    """(node_i, node_j), node_i < node_j, at most two edges apart. A hub's pairs are made in blocks, not in one task."""
    steps = adjacency(undirected).select("node", "nbr").where("node <> nbr").distinct()
    left, right = wedge_blocks(steps, block)
    met = left.withColumnRenamed("nbr", "a").join(right.withColumnRenamed("nbr", "b"), ["node", "i", "j"]).where("i < j OR a < b")
    two = met.select(F.least("a", "b").alias("node_i"), F.greatest("a", "b").alias("node_j")).distinct()
    one = steps.select(F.col("node").alias("node_i"), F.col("nbr").alias("node_j")).where("node_i < node_j")
    return two.unionByName(one).distinct() if include_one_hop else two.join(one, ["node_i", "node_j"], "left_anti")


#: Pairs that are made before they are looked through.
PAIRS_AT_ONCE = 1_000_000


def chosen_two_hop(undirected: DataFrame, chosen: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int = HUB_BLOCK) -> DataFrame:
    """Those of `two_hop_neighbors` for which chosen(node_i, node_j) holds, asked where the pairs are made, so that others never travel.

    A node's neighbours are one list; a hub's list is met by pairs of its blocks, dealt to tasks.
    """
    lists = adjacency(undirected).where("node <> nbr").groupBy("node").agg(F.collect_set("nbr").alias("nbrs"))
    last = F.floor((F.size("nbrs") - 1) / block).cast("int")
    cut = lambda k: F.slice("nbrs", k * block + 1, F.lit(block))
    whole = lists.where(last == 0).select(F.col("nbrs").alias("a"), F.lit(None).cast("array<long>").alias("b"), "node")
    hubs = lists.where(last > 0).select("node", "nbrs", F.explode(F.sequence(F.lit(0), last)).alias("i")).select("node", "nbrs", "i", F.explode(F.sequence(F.col("i"), last)).alias("j"))
    parts = hubs.select(cut(F.col("i")).alias("a"), F.when(F.col("i") < F.col("j"), cut(F.col("j"))).alias("b"), "node", "i", "j").repartition(F.col("node"), F.col("i"), F.col("j")).select("a", "b", "node")

    def run(batches):
        held, size = [], 0
        for batch in batches:
            nodes = batch.column(2).to_numpy()
            for k, (own, other) in enumerate(zip(batch.column(0), batch.column(1))):
                a = np.sort(own.values.to_numpy())
                b = other.values.to_numpy() if other.is_valid else None
                rows = max(1, PAIRS_AT_ONCE // max(1, len(a)))
                if b is None:
                    held.append((np.full(len(a), nodes[k]), a))
                    size += len(a)
                for at in range(0, len(a) if b is None else len(b), rows):
                    x, y = (np.repeat(a[at : at + rows], len(a)), np.tile(a, len(a[at : at + rows]))) if b is None else (np.repeat(b[at : at + rows], len(a)), np.tile(a, len(b[at : at + rows])))
                    held.append((x, y))
                    size += len(x)
                    if size >= PAIRS_AT_ONCE:
                        yield _asked(held, chosen)
                        held, size = [], 0
        if held:
            yield _asked(held, chosen)

    told = whole.unionByName(parts).mapInArrow(run, "node_i long, node_j long")
    return told.distinct()


def _asked(pairs: list[tuple[np.ndarray, np.ndarray]], chosen) -> pa.RecordBatch:
    a, b = (np.concatenate(x) for x in zip(*pairs))
    i, j = np.minimum(a, b), np.maximum(a, b)
    some = np.flatnonzero(i < j)
    some = some[chosen(i[some], j[some])]
    return pa.RecordBatch.from_arrays([pa.array(i[some]), pa.array(j[some])], names=["node_i", "node_j"])


def grid_cells(points: DataFrame, delta: float) -> DataFrame:
    """Points with the grid cell that they lie in: (cell_x, cell_y) = floor(position / delta)."""
    return points.withColumn("cell_x", F.floor(F.col("x_loc") / F.lit(delta)).cast("long")).withColumn("cell_y", F.floor(F.col("y_loc") / F.lit(delta)).cast("long"))
