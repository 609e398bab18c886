from __future__ import annotations

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadlark.operators import frequency, pairs, paths, workload
from roadlark.plans import frequency_samples as plans
from roadlark.plans.stable import numbered

UND = "edge_index long, src long, dst long, weight double"
ASK = "query_id long, origin long, destination long, count long"


def rows(df):
    return sorted((r.query_id, r.reachable, r.distance, list(r.nodes), list(r.edges)) for r in df.collect())


@pytest.fixture
def triangle(spark):
    return spark.createDataFrame([(0, 1, 2, 1.0), (1, 2, 3, 1.0), (2, 1, 3, 5.0)], UND)


@pytest.mark.parametrize("method", ["arrow", "relax"])
def test_small_graph(spark, triangle, method):
    q = spark.createDataFrame([(1, 1, 3, 2), (2, 2, 2, 1), (3, 1, 4, 3), (4, 8, 8, 1), (5, 8, 9, 1)], ASK)
    got = rows(paths.trace_paths(triangle, q, method))
    assert got == [(1, True, 2.0, [1, 2, 3], [0, 1]), (2, True, 0.0, [2], []), (3, False, None, [], []), (4, True, 0.0, [8], []), (5, False, None, [], [])]


def test_counts_of_small_graph(spark, triangle):
    q = spark.createDataFrame([(1, 1, 3, 2), (2, 2, 2, 1), (3, 1, 4, 3)], ASK)
    universe = spark.range(1, 5).selectExpr("id AS node", "0.0D AS lon", "0.0D AS lat")
    t = plans.sample_tables(universe, triangle, q)
    nodes = {r.node: (r.origin_count, r.destination_count, r.pass_count) for r in t["nodes"].collect()}
    assert nodes == {1: (5, 0, 2), 2: (1, 1, 3), 3: (0, 2, 2), 4: (0, 3, 0)}
    assert {r.edge_index: r.pass_count for r in t["edges"].collect()} == {0: 2, 1: 2, 2: 0}
    assert tuple(t["summary"].first()) == (3, 1)


def random_graph(seed: int, n: int = 14, m: int = 30, zero: bool = False):
    rng = random.Random(seed)
    edges = {(min(a, b), max(a, b), float(rng.randint(0 if zero else 1, 4))) for a, b in ((rng.randint(1, n), rng.randint(1, n)) for _ in range(m))}
    return [(k, *e) for k, e in enumerate(sorted(edges))]


def floyd(edges, n):
    d = {(i, j): 0.0 if i == j else math.inf for i in range(1, n + 1) for j in range(1, n + 1)}
    for _, a, b, w in edges:
        d[a, b] = min(d[a, b], w)
        d[b, a] = min(d[b, a], w)
    for k in range(1, n + 1):
        for i in range(1, n + 1):
            for j in range(1, n + 1):
                d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    return d


@pytest.mark.parametrize(("seed", "zero", "pairwise"), [(1, False, 4), (2, True, 4), (3, False, 99), (4, False, 99)])
def test_methods_agree_and_are_shortest(spark, seed, zero, pairwise):
    edges = random_graph(seed, zero=zero)
    und = spark.createDataFrame(edges, UND)
    asked = spark.createDataFrame([(a * 100 + b, a, b, 1) for a in range(1, 15, 2) for b in range(1, 15, 3)], ASK)
    before = paths.MOST_PAIRWISE
    paths.MOST_PAIRWISE = pairwise
    try:
        traced = rows(paths.trace_paths(und, asked, "arrow"))
    finally:
        paths.MOST_PAIRWISE = before
    one, two = traced, rows(paths.trace_paths(und, asked, "relax"))
    assert one == two
    best = floyd(edges, 14)
    for q, reachable, distance, nodes, used in one:
        a, b = divmod(q, 100)
        assert reachable == (best[a, b] < math.inf)
        if reachable:
            assert distance == best[a, b] == sum(edges[e][3] for e in used)
            assert (nodes[0], nodes[-1], len(used)) == (a, b, len(nodes) - 1)
            assert all({nodes[k], nodes[k + 1]} == set(edges[e][1:3]) for k, e in enumerate(used))
    sources = asked.select(F.col("origin").alias("src"))
    near = lambda method: sorted(tuple(r) for r in paths.distances(und, sources, method).collect())
    assert near("arrow") == near("relax")


def test_search_from_both_ends():
    """Against one search, over many graphs with ties: the same paths."""
    import numpy as np

    for seed in range(60):
        edges = random_graph(seed, n=25, m=60)
        columns = [np.array([e[k] for e in edges]) for k in (1, 2, 3, 0)]
        graph = paths.Rows(*columns)
        for a in range(0, len(graph.ids), 3):
            whole = graph.reach(a, None)
            for b in range(len(graph.ids)):
                if a == b:
                    continue
                done = graph.between(a, b)
                assert (b in done) == (b in whole)
                if b in done:
                    assert done[b][0] == whole[b][0]
                    assert graph.back(done, a, b) == graph.back(whole, a, b)


def test_guided_search(spark):
    rng = random.Random(7)
    xy = {k: (rng.random(), rng.random()) for k in range(1, 31)}
    edges = [(k, a, b, 10 * math.dist(xy[a], xy[b]) + rng.random()) for k, (a, b) in enumerate((rng.randint(1, 30), rng.randint(1, 30)) for _ in range(80)) if a != b]
    und = spark.createDataFrame(edges, UND)
    points = spark.createDataFrame([(k, *p) for k, p in xy.items()], "id long, x_loc double, y_loc double")
    asked = spark.createDataFrame([(k, k, 31 - k, 1) for k in range(1, 16)], ASK)
    scale = paths.admissible_scale(points, und).first()[0]
    assert scale > 0
    assert rows(paths.trace_paths(und, asked, "arrow", points, scale)) == rows(paths.trace_paths(und, asked, "arrow"))


def test_top_decile(spark):
    t = spark.createDataFrame([(k, 3 if k == 7 else 0) for k in range(1, 21)], "node long, pass_count long")
    assert sorted(r.node for r in frequency.top_decile(t, "node").collect()) == [1, 7]
    assert frequency.top_decile(t.where("node <= 5"), "node").count() == 1
    told = frequency.label(t, "node")
    roles = {r.sample_role: r["count"] for r in told.groupBy("sample_role").count().collect()}
    assert roles == {"positive": 2, "negative": 2, "unused": 16}
    assert told.where("label = 1").count() == 2


def test_negatives_like_python(spark):
    c = spark.createDataFrame([(k * 3,) for k in range(1, 31)], "node long")
    expected = set(random.Random(42).sample([k * 3 for k in range(1, 31)], 5))
    got = {r.node for r in frequency.sample_negatives_like_random(c, "node", 5, random.Random(42)).collect()}
    assert got == expected
    assert frequency.sample_negatives(c, "node", 99).count() == 30


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-50, 50), max_size=40))
def test_numbered(spark, values):
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v long, k long").repartition(3)
    got = [(r.n, r.v, r.k) for r in numbered(df, [F.desc("v"), F.asc("k")], "n").collect()]
    expected = [(n, v, k) for n, (v, k) in enumerate(sorted(((v, k) for k, v in enumerate(values)), key=lambda x: (-x[0], x[1])))]
    assert sorted(got) == expected


def test_windows(spark):
    p = spark.createDataFrame([(1, [12, 45, 78, 93, 120, 151]), (2, [5]), (3, [])], "query_id long, nodes array<long>")
    got = pairs.window_pairs(p, 3)
    assert {r.window_distance: r["count"] for r in got.groupBy("window_distance").count().collect()} == {1: 5, 2: 4, 3: 3}
    assert abs(pairs.pair_counts(got).agg(F.sum("decay")).first()[0] - (5 + 2 + 1)) < 1e-9


def test_strength(spark):
    t = spark.createDataFrame([(12, 6), (4, 4), (5, 2)], "cooccur_count long, query_count long").withColumn("s", pairs.strength())
    assert {(r.cooccur_count, r.query_count): r.s for r in t.collect()} == {(12, 6): "strong", (4, 4): "weak", (5, 2): "weak"}


def test_workload(spark):
    p = spark.createDataFrame([(k, float(k % 20), float(k // 20)) for k in range(1, 401)], "node long, lon double, lat double")
    c = workload.hotspot_centers(p, 6)
    m = workload.nearest_nodes(p, c, 30).cache()
    members = {}
    for r in m.collect():
        members.setdefault(r.hotspot_id, set()).add(r.node)
    assert all(len(x) == 30 for x in members.values()) and len(members) == 6
    q = workload.generate_queries(p, m, 3000).collect()
    assert sorted(r.query_id for r in q) == list(range(1, 3001))
    assert all(r.origin != r.destination for r in q)
    for r in q:
        assert (r.source_hotspot == -1) == (r.query_type == "random")
        assert (r.target_hotspot != -1) == (r.query_type == "hotspot_to_hotspot")
        assert r.source_hotspot != r.target_hotspot or r.source_hotspot == -1
        assert r.source_hotspot == -1 or r.origin in members[r.source_hotspot]
        assert r.target_hotspot == -1 or r.destination in members[r.target_hotspot]
    share = sum(r.query_type == "hotspot_to_hotspot" for r in q) / 3000
    assert abs(share - 0.7) < 0.04
    with pytest.raises(ValueError):
        workload.hotspot_centers(p, 401)


def test_pair_tables(spark, triangle):
    q = spark.createDataFrame([(1, 1, 3, 2)], ASK)
    t = plans.pair_tables(triangle, paths.trace_paths(triangle, q))
    assert t["samples"].where("label = 1").count() == 3
    assert t["samples"].where("label = 0").join(t["counts"], ["node_i", "node_j"]).count() == 0
    assert t["ppmi"].count() == t["jaccard"].count() == 3


def test_negatives_are_as_many_as_asked(spark):
    nodes = spark.createDataFrame([(k,) for k in range(1, 60)], "node long")
    counts = spark.createDataFrame([(1, k) for k in range(2, 60)], "node_i long, node_j long")
    got = [(r.node_i, r.node_j) for r in pairs.random_negatives(nodes, counts, 300, 5).collect()]
    assert len(got) == len(set(got)) == 300 and all(1 < i < j for i, j in got)
    few = pairs.random_negatives(nodes.where("node <= 3"), counts, 10, 5).collect()
    assert [(r.node_i, r.node_j) for r in few] == [(2, 3)]


def test_area_negatives(spark):
    """Each pair lies in one cell and in no window; a crowded cell's pairs are not all written out."""
    points = spark.createDataFrame([(k, (k % 5) * 10.0 + 1, 1.0) for k in range(1, 101)], "id long, x_loc double, y_loc double")
    counts = spark.createDataFrame([(1, 6)], "node_i long, node_j long")
    got = [(r.node_i, r.node_j) for r in pairs.area_negatives(points, counts, 10.0).collect()]
    assert 50 <= len(got) <= 100 and all(i < j and i % 5 == j % 5 for i, j in got) and (1, 6) not in got
    assert pairs.area_negatives(points, counts, 10.0, 7).count() == 7
