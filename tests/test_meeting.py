"""Searches of many queries at once, against one search from each origin."""

from __future__ import annotations

import numpy as np
import pytest

from roadlark.operators import meeting, paths

from .test_paths_and_samples import random_graph


def graph_of(edges):
    return paths.Rows(*(np.array([e[k] for e in edges]) for k in (1, 2, 3, 0)))


def check(graph, origins, goals):
    distance, nodes, edges = graph.searches.paths(origins, goals)
    for s, t, d, v, e in zip(origins.tolist(), goals.tolist(), distance.tolist(), nodes, edges):
        whole = graph.reach(s, None)
        assert d == (whole[t][0] if t in whole else np.inf)
        assert (graph.nodes(v).tolist(), e.tolist()) == (graph.back(whole, s, t) if t in whole else ([], []))
    assert not graph.searches.slots.any()


@pytest.mark.parametrize(("n", "m"), [(25, 60), (25, 30), (60, 400)])
def test_same_paths_as_one_search(n, m):
    for seed in range(15):
        graph = graph_of(random_graph(seed, n=n, m=m))
        a, b = np.meshgrid(np.arange(0, len(graph.ids), 3), np.arange(len(graph.ids)))
        a, b = a.ravel(), b.ravel()
        check(graph, a[a != b], b[a != b])


@pytest.mark.parametrize("unit", [False, True])
def test_long_ways_hubs_and_parts(unit):
    """A grid of streets, a hub with an edge to all of them, heavy and light edges; weights that are not whole."""
    rng, side = np.random.default_rng(3), 30
    at = np.arange(side * side).reshape(side, side)
    src, dst = np.concatenate([at[:, :-1].ravel(), at[:-1].ravel()]), np.concatenate([at[:, 1:].ravel(), at[1:].ravel()])
    weight = np.ones(len(src)) if unit else rng.random(len(src)) + 0.01
    src, dst = np.append(src, np.full(side * side, 5000)), np.append(dst, at.ravel())
    weight = np.append(weight, 25.0 + (0 if unit else 1) * rng.random(side * side))
    src, dst, weight = np.append(src, 9000), np.append(dst, 9001), np.append(weight, 1e6)
    graph = paths.Rows(src, dst, weight, np.arange(len(src)))
    origins, goals = rng.integers(0, len(graph.ids), (2, 60))
    keep = origins != goals
    check(graph, np.append(origins[keep], [900, 901]), np.append(goals[keep], [3, 902]))


@pytest.mark.parametrize("limit", ["MOST_ENTRIES", "MOST_PAIRS", "MOST_BALLS", "MOST_COPIED"])
def test_small_limits_change_nothing(monkeypatch, limit):
    monkeypatch.setattr(meeting, limit, 3)
    graph = graph_of(random_graph(8, n=40, m=120))
    starts = graph.starts
    cut = int(starts[20])
    parts = [(starts[a : b + 1] - starts[a], graph.to[starts[a] : starts[b]].astype(np.int32), graph.weight[starts[a] : starts[b]], graph.edge[starts[a] : starts[b]]) for a, b in ((0, 20), (20, len(graph.ids)))]
    graph._searches = meeting.Searches(parts, 20)
    assert cut and len(graph.searches.to.parts) == (2 if limit == "MOST_COPIED" else 1)
    a, b = np.meshgrid(np.arange(0, len(graph.ids), 2), np.arange(1, len(graph.ids), 2))
    check(graph, a.ravel(), b.ravel())


def test_queries_of_one_end_share_its_ball():
    rng = np.random.default_rng(1)
    src, dst = rng.integers(0, 4000, (2, 40_000))
    graph = paths.Rows(src, dst, rng.integers(1, 500, 40_000).astype(float), np.arange(40_000))
    told = []
    for goals in (np.zeros(40, np.int64), np.arange(100, 140)):
        batch = meeting.Batch(graph.searches, np.arange(1, 41), goals)
        batch.seed()
        batch._meet()
        told.append(batch.count)
        batch.clear()
    assert told[0] < 0.8 * told[1] < 0.8 * 80 * 0.1 * 4000  # a search settles a small part of the graph


def test_lengths_from_several_places():
    """Ends that come to the graph at several places, at one that both have, or at none."""
    rng = np.random.default_rng(5)
    for seed in range(20):
        graph = graph_of(random_graph(seed, n=40, m=45 if seed % 2 else 90))
        ends = [{k: (np.unique(rng.integers(0, len(graph.ids), rng.integers(0, 4))), None) for k in range(12)} for _ in range(2)]
        ends = [{k: (p, rng.integers(0, 6, len(p)).astype(float)) for k, (p, _) in e.items()} for e in ends]
        a, b = (x.ravel() for x in np.meshgrid(np.arange(12), np.arange(12)))
        told = graph.searches.lengths(a, b, *ends)
        assert told.tolist() == [graph.length(*(dict(zip(p.tolist(), d.tolist())) for p, d in (ends[0][s], ends[1][t]))) for s, t in zip(a.tolist(), b.tolist())]
        assert not graph.searches.slots.any()
