from __future__ import annotations

import itertools

import pytest

from roadlark.operators import graph

EDGE = "from_point long, to_point long, value double, directed boolean"


def built(spark, *events):
    """(u, v, w, directed) in order of arrival."""
    rows = [(*e, k) for k, e in enumerate(events)]
    got = graph.build_graph(spark.createDataFrame(rows, "u long, v long, w double, directed boolean, seq long"))
    return sorted(tuple(r) for r in got.select("from_point", "to_point", "value", "directed").collect())


@pytest.mark.parametrize(
    ("events", "expected"),
    [
        ([(1, 2, 803.0, True), (2, 1, 803.0, True)], [(1, 2, 803.0, False)]),
        ([(1, 2, 5.0, True), (2, 1, 6.0, True)], [(1, 2, 5.0, True), (2, 1, 6.0, True)]),
        ([(1, 2, 5.0, True), (1, 2, 5.0, True)], [(1, 2, 5.0, True)]),
        ([(3, 3, 1.0, True)], []),
        ([(1, 2, 5.0, True), (1, 2, 5.0, False), (2, 1, 5.0, True)], [(1, 2, 5.0, False)]),
        ([(2, 1, 5.0, False), (1, 2, 5.0, True)], [(2, 1, 5.0, False)]),
    ],
)
def test_merge(spark, events, expected):
    assert built(spark, *events) == expected


def step_by_step(events):
    """Edges one at a time: state of one bucket, and which arrivals change it."""
    state, changed = None, []
    for u, v, directed in events:
        before = state
        if u != v:
            if state is None:
                state = (u, v, directed)
            elif directed and state[2] and state[:2] == (v, u):
                state = (min(u, v), max(u, v), False)
        changed.append(state != before)
    return state, changed


def test_all_short_histories(spark):
    kinds = [(1, 2, True), (2, 1, True), (1, 2, False), (2, 1, False), (1, 1, True)]
    histories = [h for n in range(1, 5) for h in itertools.product(kinds, repeat=n)]
    rows = [(u, v, float(k), d, s) for k, h in enumerate(histories) for s, (u, v, d) in enumerate(h)]
    arcs = spark.createDataFrame(rows, "u long, v long, w double, directed boolean, seq long").cache()
    got = {int(r.value): (r.from_point, r.to_point, r.directed) for r in graph.build_graph(arcs).collect()}
    told = {(int(r.w), r.seq): r.accepted for r in graph.accepted_events(arcs).collect()}
    for k, h in enumerate(histories):
        state, changed = step_by_step(h)
        assert got.get(k) == state, h
        assert [told[k, s] for s in range(len(h))] == changed, h


def test_neighbors_and_degrees(spark):
    points = spark.createDataFrame([(1,), (2,), (3,), (9,)], "id long")
    edges = spark.createDataFrame([(1, 2, 1.0, False), (1, 2, 2.0, False), (1, 3, 1.0, True), (1, 77, 1.0, True)], EDGE)
    assert sorted(r.neighbor for r in graph.neighbors(points, edges, 1).collect()) == [2, 2, 3]
    got = {r.node: (r.degree, r.in_degree, r.out_degree) for r in graph.degrees(points, edges).collect()}
    assert got == {1: (3, 2, 3), 2: (2, 2, 2), 3: (0, 1, 0), 9: (0, 0, 0)}
    assert tuple(graph.summary(points, edges, "x").first()) == ("x", 4, 2, 2, 4)
    assert graph.out_edges(points, edges, 77).count() == 0
    assert graph.in_edges(points, edges, 3).count() == 1


def test_lookups(spark):
    edges = spark.createDataFrame([(1, 2, 3.0, True), (2, 1, 4.0, True), (2, 1, 1.0, False)], EDGE)
    one = lambda **k: [tuple(r) for r in graph.get_edge(edges, 1, 2, **k).collect()]
    assert one() == [(1, 2, 3.0, True)]
    assert one(directed=False) == [(2, 1, 1.0, False)]
    assert one(value=1.0) == [(2, 1, 1.0, False)]
    assert one(value=4.0) == []
    assert graph.edges_between(edges, 1, 2).count() == 2
    assert graph.edges_between(edges, 2, 1, True).count() == 1
    asked = spark.createDataFrame([(1, 2), (5, 6)], "a long, b long")
    assert {(r.a, r.b): r.found for r in graph.has_edges(edges, asked).collect()} == {(1, 2): True, (5, 6): False}


def test_undirected_keeps_loops_and_first_order(spark):
    arcs = spark.createDataFrame([(1, 5, 2, 1.0), (2, 2, 5, 1.0), (3, 3, 3, 1.0), (4, 2, 5, 9.0)], "line long, u long, v long, w double")
    und = graph.build_undirected(arcs)
    assert sorted(tuple(r) for r in und.collect()) == [(0, 2, 5, 1.0), (1, 3, 3, 1.0), (2, 2, 5, 9.0)]
    assert graph.adjacency(und).where("node = 3").count() == 2
    assert graph.build_undirected(arcs.limit(0)).count() == 0


def test_first_inserted_edge(spark):
    """Of the edges of a pair the first that arrived counts, whatever its value; lists keep the order of arrival."""
    arcs = spark.createDataFrame([(1, 2, 9.0, 0), (1, 2, 3.0, 1), (1, 3, 1.0, 2), (1, 2, 5.0, 3)], "u long, v long, w double, seq long")
    edges = graph.build_graph(arcs)
    assert graph.get_edge(edges, 1, 2).first()["value"] == 9.0
    points = spark.createDataFrame([(k,) for k in (1, 2, 3)], "id long")
    told = {r.node: [e.value for e in r.out_edges] for r in graph.edge_lists(points, edges).collect()}
    assert told[1] == [9.0, 3.0, 1.0, 5.0]
    assert [x.w for x in graph.adjacency_of_arcs(arcs).first()["neighbors"]] == [9.0, 3.0, 1.0, 5.0]
