"""Searches over tables: delta-stepping, two frontiers, blocks of a map."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlark.operators import overlay, paths, stepping
from roadlark.operators.graph import adjacency

from .test_paths_and_samples import ASK, UND, floyd, random_graph


def seeds(spark, *nodes):
    return spark.createDataFrame([(n, n, 0.0, 0) for n in nodes], "src long, node long, distance double, hops long")


def written(search) -> int:
    """Rows in all files of a search, settled ones and offers."""
    paths_ = search.tables.listed(search.tables.base)
    return sum(search.spark.read.schema("node long").option("recursiveFileLookup", "true").parquet(f"{search.tables.base}/{p}").count() for p in paths_)


def run(search) -> dict:
    while search.round() is not None:
        pass
    rows = search.all().collect()
    assert len({(r.src, r.node) for r in rows}) == len(rows)
    return {(r.src, r.node): r.distance for r in rows}


@pytest.mark.parametrize(("seed", "delta"), [(5, 2.0), (6, 3.5), (7, 100.0)])
def test_stepping_against_all_pairs(spark, seed, delta):
    edges = random_graph(seed, zero=seed == 6)
    got = run(stepping.Stepping(adjacency(spark.createDataFrame(edges, UND)), seeds(spark, 1, 5, 99), delta))
    best = floyd(edges, 14)
    assert got == {(s, n): best[s, n] for s in (1, 5) for n in range(1, 15) if best[s, n] < math.inf} | {(99, 99): 0.0}


def test_bytes_written_grow_with_what_is_settled(spark):
    """A long path: nothing that is settled is written again, so twice the path makes twice the rows."""
    sizes = []
    for n in (16, 32):
        line = spark.createDataFrame([(k, k, k + 1, 1.0) for k in range(n)], UND)
        search = stepping.Stepping(adjacency(line), seeds(spark, 0), 8.0)
        assert run(search) == {(0, k): float(k) for k in range(n + 1)}
        sizes.append(written(search))
    assert sizes[0] <= 3 * 17 and sizes[1] <= 2.2 * sizes[0]


def test_two_frontiers_settle_little(spark):
    """On a grid of streets two frontiers meet halfway, and pairs that are near retire early."""
    n = 24
    edges = [(r * n + c, r * n + c + 1) for r in range(n) for c in range(n - 1)] + [(r * n + c, r * n + c + n) for r in range(n - 1) for c in range(n)]
    und = spark.createDataFrame([(k, a, b, 1.0) for k, (a, b) in enumerate(edges)], UND)
    asked = [(0, 3), (100, 104), (300, 303), (500, 452), (0, 575), (7, 9999)]
    search = stepping.BothEnds(adjacency(und), spark.createDataFrame(asked, "origin long, destination long"), 2.0)
    assert {(r.origin, r.destination): r.length for r in search.lengths.collect()} == {(a, b): float(abs(a // n - b // n) + abs(a % n - b % n)) for a, b in asked[:-1]}
    sides = {(r.origin, r.destination): r.n for r in search.search.all().groupBy("src.origin", "src.destination").agg(F.count("*").alias("n")).collect()}
    near = [sides[p] for p in asked[:4]]
    assert max(near) < n * n / 5 and sides[0, 575] < 2 * n * n
    assert sides[7, 9999] < n * n / 4  # nothing is left of one side, so the other does not go through the whole graph


def test_tasks_of_tracing(spark, monkeypatch):
    """Few bytes of queries still make as many tasks as there are cores for, and a hot origin is cut."""
    rows = spark.range(5000).select(F.col("id").alias("query_id"), F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 400).alias("origin"), (F.col("id") % 77).alias("destination"), F.lit(1).alias("count"))
    assert paths._dealt(rows, "origin").rdd.getNumPartitions() == paths.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert paths._dealt(rows.where("origin < 3"), "origin").rdd.getNumPartitions() == 3
    monkeypatch.setattr(paths, "QUERIES_PER_TASK", 100)
    cut = paths._dealt(rows, "origin")
    assert cut.count() == 5000 and max(r["count"] for r in cut.where("origin = 1").groupBy(F.spark_partition_id()).count().collect()) < 400
    edges = random_graph(9)
    und = spark.createDataFrame(edges, UND)
    many = spark.createDataFrame([(k, 1 + k % 2, 1 + k % 14, 1) for k in range(600)], ASK)
    best = floyd(edges, 14)
    got = paths.trace_paths(und, many, "arrow").collect()
    assert len(got) == 600 and all((r.distance if r.reachable else math.inf) == best[r.origin, r.destination] for r in got)


@pytest.mark.parametrize("zero", [False, True])
def test_graph_in_files(spark, monkeypatch, zero):
    """Beyond what is broadcast executors read rows from files of few nodes; with the same paths, and no edge through the driver."""
    edges = random_graph(3, zero=zero) + [(90, 40, 41, 2.0)]
    und = spark.createDataFrame(edges, UND)
    asked = spark.createDataFrame([(a * 100 + b, a, b, 1) for a in [*range(1, 15, 2), 40, 77] for b in [*range(1, 15, 3), 41]], ASK)
    told = lambda method: sorted((r.query_id, r.reachable, r.distance, r.nodes, r.edges) for r in paths.trace_paths(und, asked, method).collect())
    want = told("arrow")
    monkeypatch.setattr(paths, "ROWS_PER_FILE", 12)
    monkeypatch.setattr(paths, "MOST_BROADCAST_EDGES", 5)
    monkeypatch.setattr(paths, "_collected_rows", None)
    assert paths.GraphFiles(und).parts > 3 and paths.method_for(und) == "files"
    assert told("auto") == want
    best = floyd(edges[:-1], 14)
    got = paths.distances(und, spark.createDataFrame([(1,), (5,), (99,)], "src long")).collect()
    assert {(r.src, r.node): r.distance for r in got} == {(s, n): best[s, n] for s in (1, 5) for n in range(1, 15) if best[s, n] < math.inf} | {(99, 99): 0.0}


def test_searches_follow_few_edges(monkeypatch):
    """On a graph of many edges a node both ends settle few nodes, and take few edges of each."""
    rng = np.random.default_rng(4)
    n, m = 4000, 80_000
    graph = paths.Rows(rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(1, 1000, m).astype(float), np.arange(m))
    pushed = []
    monkeypatch.setattr(paths.heapq, "heappush", lambda heap, x, push=paths.heapq.heappush: (pushed.append(1), push(heap, x)))
    for goal in range(1, 20):
        done, whole = graph.between(0, goal), None
        few = len(pushed)
        whole = graph.reach(0, {goal})
        assert done[goal][0] == whole[goal][0] and graph.back(done, 0, goal) == graph.back(whole, 0, goal)
        assert len(done) < n / 8 and few < n / 2
        pushed.clear()


# Blocks


def city(seed: int):
    """Edges between near points, a few long ones, a part that hangs loose; points of all but two nodes."""
    rng = random.Random(seed)
    at = {k: (rng.uniform(0, 10), rng.uniform(0, 10)) for k in range(1, 61)}
    at.update({k: (5.0, 5.0) for k in range(50, 56)})
    edges = []
    for a in at:
        near = sorted(at, key=lambda b: math.dist(at[a], at[b]))[1:4] if a < 57 else [57 + (a - 56) % 4]
        edges += [(min(a, b), max(a, b), float(rng.randint(1, 9))) for b in near if a != b and (a < 57) == (b < 57)]
    edges += [(3, 40, 2.0), (3, 40, 7.0), (8, 8, 1.0)]
    return [(k, *e) for k, e in enumerate(edges)], [(k, *p) for k, p in at.items() if k not in (20, 21)]


@pytest.mark.parametrize(("seed", "most", "method"), [(1, 8, "arrow"), (2, 1000, "arrow"), (3, 4, "relax")])
def test_blocks_against_all_pairs(spark, seed, most, method):
    edges, points = city(seed)
    und, places = spark.createDataFrame(edges, UND), spark.createDataFrame(points, "id long, x_loc double, y_loc double")
    blocks = overlay.Overlay(und, places, 6.0, most)
    sizes = [r["count"] for r in blocks.cells.groupBy("cell").count().collect()]
    assert max(sizes) <= most and sum(sizes) == len({n for _, a, b, _ in edges for n in (a, b)})
    best = floyd(edges, 60)
    asked = [(k, a, b) for k, (a, b) in enumerate((a, b) for a in (1, 8, 20, 52, 58) for b in range(1, 61, 3))] + [(900, 8, 8), (901, 5, 777)]
    got = {r.query_id: r.distance for r in overlay.route_distances(blocks, spark.createDataFrame(asked, "query_id long, origin long, destination long"), method).collect()}
    assert got == {k: None if b == 777 or best[a, b] == math.inf else best[a, b] for k, a, b in asked}
    if method == "arrow":
        rows = overlay.distances(blocks, spark.createDataFrame([(1,), (52,), (58,), (777,)], "src long"), method).collect()
        assert {(r.src, r.node): r.distance for r in rows} == {(s, n): best[s, n] for s in (1, 52, 58) for n in range(1, 61) if best[s, n] < math.inf} | {(777, 777): 0.0}
        assert len({(r.src, r.node) for r in rows}) == len(rows)


def test_routes_settle_little(spark, monkeypatch):
    """Routes over blocks are searched for from both ends, not from each origin through the whole overlay."""
    edges, points = city(1)
    und, places = spark.createDataFrame(edges, UND), spark.createDataFrame(points, "id long, x_loc double, y_loc double")
    blocks, best = overlay.Overlay(und, places, 6.0, 8), floyd(edges, 60)
    monkeypatch.setattr(overlay.Overlay, "reached", None)
    monkeypatch.setattr(paths, "MOST_BROADCAST_EDGES", 5)
    asked = spark.createDataFrame([(k, 1 + k % 7, 1 + k % 60) for k in range(120)], "query_id long, origin long, destination long")
    got = {r.query_id: r.distance for r in overlay.route_distances(blocks, asked).collect()}
    assert got == {k: None if best[1 + k % 7, 1 + k % 60] == math.inf else best[1 + k % 7, 1 + k % 60] for k in range(120)}


def test_shortcuts_pass_no_border(spark):
    """Two cells: 1 - 2 - 3 | 4, 1 and 3 on the border; one shortcut 1-3, none through a border node."""
    und = spark.createDataFrame([(0, 1, 2, 1.0), (1, 2, 3, 1.0), (2, 1, 4, 5.0), (3, 3, 4, 5.0), (4, 3, 5, 1.0), (5, 5, 4, 1.0)], UND)
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.1, 0.0), (3, 0.2, 0.0), (5, 0.3, 0.0), (4, 9.0, 0.0)], "id long, x_loc double, y_loc double")
    got = sorted((r.src, r.dst, r.weight) for r in overlay.Overlay(und, places, 1.0).edges.collect())
    assert got == [(1, 3, 2.0), (1, 4, 5.0), (3, 4, 5.0), (3, 5, 1.0), (4, 5, 1.0)]
