"""Cells for nearest points, bitmaps of queries, blocks of a hub's neighbours, a graph that grows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from roadlark.operators import graph, pairs, workload

POINT = "node long, lon double, lat double"
CENTER = "hotspot_id int, center_node long, center_lon double, center_lat double, num_nodes int"


def nearest(points, centers, k):
    out = []
    for h, _, x, y, n in centers:
        ranked = sorted(((lon - x) * (lon - x) + (lat - y) * (lat - y), node, lon, lat) for node, lon, lat in points if lon is not None)
        out += [(h, r, node, lon, lat) for r, (_, node, lon, lat) in enumerate(ranked[: k if k is not None else n], 1)]
    return sorted(out)


def maps():
    rng = random.Random(6)
    even = [(k, rng.uniform(-5, 5), rng.uniform(40, 45)) for k in range(600)]
    towns = [(k, rng.gauss(100 * (k % 3), 0.01 + k % 3), rng.gauss(0, 0.01)) for k in range(600)]
    spot = [(k, 1.5, 2.5) for k in range(200)] + [(k + 200, rng.uniform(0, 1000), 0.0) for k in range(200)]
    grid = [(k, float(k % 20), float(k // 20)) for k in range(400)] + [(900, None, 1.0), (901, 2.0, float("nan"))]
    return {"even": even, "towns": towns, "spot": spot, "grid": grid, "one": [(1, 3.0, 3.0)], "line": [(k, 0.0, float(k)) for k in range(50)]}


@pytest.mark.parametrize("name", sorted(maps()))
def test_nearest_nodes_by_cells(spark, name):
    points = maps()[name]
    sound = [p for p in points if p[1] is not None and p[2] == p[2]]
    rng = random.Random(1)
    own = [(h, p[0], p[1], p[2], n) for h, (p, n) in enumerate(zip(rng.choices(sound, k=5), (1, 3, 17, 40, 5)))]
    centers = [*own, (7, -1, 5000.0, -5000.0, 4), (8, -1, 2.0001, 2.9999, 100_000)]
    table, middle = spark.createDataFrame(points, POINT), spark.createDataFrame(centers, CENTER)
    told = lambda k: sorted(tuple(r) for r in workload.nearest_nodes(table, middle, k).select("hotspot_id", "rank", "node", "lon", "lat").collect())
    assert told(None) == nearest(sound, centers, None)
    if name in ("even", "spot"):
        assert told(25) == nearest(sound, centers, 25)


def test_candidates_are_few(spark):
    rng = random.Random(2)
    points = [(k, rng.uniform(0, 10), rng.uniform(0, 10)) for k in range(20_000)]
    centers = [(h, h, *points[h][1:], 0) for h in range(20)]
    found = workload.near_candidates(spark.createDataFrame(points, POINT), spark.createDataFrame(centers, CENTER), 100)
    assert all(100 <= r["count"] <= 400 for r in found.groupBy("hotspot_id").count().collect())


def test_bitmaps_of_queries(spark, monkeypatch):
    rng = random.Random(3)
    served = [(n, q * 7) for n, size in enumerate((4000, 900, 60, 12, 1)) for q in rng.sample(range(9000), size)]
    own = {n: {q for m, q in served if m == n} for n in range(5)}
    table = spark.createDataFrame(served, "node long, query_id long")
    blocks = pairs.query_blocks(table).collect()
    assert {n: sum(b.n for b in blocks if b.node == n) for n in own} == {n: len(q) for n, q in own.items()}
    assert any(b.words is None for b in blocks) and any(b.all_words is None for b in blocks)
    asked = [(a, b) for a in range(5) for b in range(a + 1, 5)]
    got = {(r.node_i, r.node_j): (r.shared, r.jaccard) for r in pairs.service_jaccard(table, spark.createDataFrame(asked * 2, "node_i long, node_j long")).collect()}
    assert got == {(a, b): (len(own[a] & own[b]), len(own[a] & own[b]) / len(own[a] | own[b])) for a, b in asked}


def test_pairs_of_a_hub_in_blocks(spark):
    """A star of 100,000 leaves: its pairs lie in many places, none with more than a block by a block."""
    leaves = 100_000
    star = spark.range(1, leaves + 1).select(F.lit(0).cast("long").alias("node"), F.col("id").alias("nbr"))
    left, right = graph.wedge_blocks(star)
    sizes = left.groupBy("node", "i", "j").agg(F.count("*").alias("l")).join(right.groupBy("node", "i", "j").agg(F.count("*").alias("r")), ["node", "i", "j"])
    places = sizes.collect()
    blocks = -(-leaves // graph.HUB_BLOCK)
    assert len(places) == blocks * (blocks + 1) // 2
    assert max(p.l * p.r for p in places) <= (1.2 * graph.HUB_BLOCK) ** 2
    assert sum(p.l * p.r if p.i < p.j else p.l * (p.l - 1) // 2 for p in places) == leaves * (leaves - 1) // 2


@pytest.mark.parametrize("block", [2, 2048])
def test_two_hops_in_blocks(spark, block):
    rng = random.Random(4)
    edges = [(k, 0 if k < 12 else rng.randint(0, 30), rng.randint(0, 30), 1.0) for k in range(50)]
    und = spark.createDataFrame(edges, "edge_index long, src long, dst long, weight double")
    near = {(a, b) for _, x, y, _ in edges if x != y for a, b in ((x, y), (y, x))}
    one = {p for p in near if p[0] < p[1]}
    two = {(a, d) for a, b in near for c, d in near if b == c and a < d}
    rows = lambda hop: [tuple(r) for r in graph.two_hop_neighbors(und, hop, block).collect()]
    assert sorted(rows(True)) == sorted(one | two) and sorted(rows(False)) == sorted(two - one)


EVENT = "u long, v long, w double, directed boolean, seq long"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_graph_grows_as_if_all_arrived_at_once(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = [(rng.randint(0, 4), rng.randint(0, 4), float(rng.randint(0, 1)), rng.random() < 0.6, k) for k in range(80)]
    cuts = sorted(rng.sample(range(81), 4))
    grown = graph.GrowingGraph(spark, f"{tmp_path}/g", most=2)
    assert grown.edges().count() == 0 and grown.points().count() == 0
    for a, b in zip([0, *cuts], [*cuts, 80]):
        grown.add_arcs(spark.createDataFrame(events[a:b], EVENT))
    whole = graph.build_graph(spark.createDataFrame(events, EVENT))
    assert sorted(tuple(r) for r in grown.edges().collect()) == sorted(tuple(r) for r in whole.collect())
    grown.add_arcs(spark.createDataFrame(events[cuts[0] :], EVENT))  # a batch that comes again
    assert sorted(tuple(r) for r in grown.edges().collect()) == sorted(tuple(r) for r in whole.collect())
    states = [graph.graph_state(spark.createDataFrame(events[k::3], EVENT)) for k in range(3)]
    merged = graph.edges_of(graph.merge_states(states[2], graph.merge_states(states[1], states[0])))
    assert sorted(tuple(r) for r in merged.collect()) == sorted(tuple(r) for r in whole.collect())


def test_a_version_that_was_not_finished_does_not_count(spark, tmp_path):
    grown = graph.GrowingGraph(spark, f"{tmp_path}/g")
    grown.add_points(spark.createDataFrame([(1, 0.0, 0.0)], "id long, x_loc double, y_loc double"))
    (tmp_path / "g/points/v9").mkdir()
    grown.add_points(spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0)], "id long, x_loc double, y_loc double"))
    assert sorted(r.id for r in grown.points().collect()) == [1, 1, 2]


def test_graph_follows_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, 2, 5.0, True, 0), (2, 1, 5.0, True, 1)], EVENT).coalesce(1).write.parquet(f"{tmp_path}/in")
    grown = graph.GrowingGraph(spark, f"{tmp_path}/g")
    for batch in ([(4, 5, 1.0, True, 2)], [(5, 4, 1.0, True, 3), (6, 7, 1.0, False, 4)]):
        spark.createDataFrame(batch, EVENT).write.mode("append").parquet(f"{tmp_path}/in")
        grown.follow(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in"), f"{tmp_path}/c", availableNow=True).awaitTermination(120)
    assert sorted(tuple(r)[:4] for r in grown.edges().collect()) == [(1, 2, 5.0, False), (4, 5, 1.0, False), (6, 7, 1.0, False)]


def test_points_by_position(spark, monkeypatch):
    points = spark.createDataFrame([(k * 3 % 50, float(k), k) for k in range(1, 41)], "id long, x_loc double, seq long").repartition(3)
    for most in (10_000, 5):
        monkeypatch.setattr(graph, "MOST_TAKEN", most)
        assert [r.id for r in graph.point_at(points, 9).collect()] == [27] and graph.point_at(points, 41).count() == 0 == graph.point_at(points, 0).count()
