"""What runs leave on disks, and how much they move."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlark.operators import graph, pairs, paths
from roadlark.plans.stable import kept, numbered


def shuffle_files(spark) -> set[str]:
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().iterator()
    out = set()
    while files.hasNext():
        name = files.next().getName()
        if name.startswith("shuffle_"):
            out.add(name)
    return out


@pytest.fixture
def arcs(spark):
    return spark.range(3000).select("id", (F.col("id") % 200).alias("u"), (F.col("id") * 37 % 201).alias("v"), (1 + F.col("id") % 9).cast("double").alias("w")).withColumnRenamed("id", "line")


def test_kept_tables_leave_no_shuffles(spark, arcs):
    before = shuffle_files(spark)
    und = graph.build_undirected(arcs)
    assert {f for f in shuffle_files(spark) - before if f.endswith(".data")} == set()
    before = shuffle_files(spark)
    assert kept(und.groupBy("src").agg(F.max("weight"))).columns == ["src", "max(weight)"]
    assert shuffle_files(spark) == before


def test_labels_and_files_leave_no_shuffles(spark, tmp_path):
    from roadlark.operators import frequency
    from roadlark.sources import write_table

    table = spark.range(400_000).groupBy(F.col("id").alias("src")).agg(F.count("*").alias("pass_count"))
    before = shuffle_files(spark)
    told = frequency.label(table, "src")
    top = frequency.top_decile(table, "src")
    assert write_table(told, f"{tmp_path}/told", "csv", "src", n=F.count(F.lit(1)))["n"] == told.count() and top.count() == frequency.share(told.count())
    assert {f for f in shuffle_files(spark) - before if shuffled_size(spark, f) > 150_000} == set()  # histograms of 4,096 cells stay


def shuffled_size(spark, name: str) -> int:
    return spark._jsc.sc().env().blockManager().diskBlockManager().getFile(name).length()


def test_numbers_stand(spark):
    """Numbers are the same each time they are read, whatever partitions are made of them."""
    rows = numbered(spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")), [F.col("k")], "n")
    assert [r.n for r in rows.repartition(7).orderBy("k").collect()] == list(range(5000))
    assert [r.n for r in rows.orderBy("k").collect()] == list(range(5000))


def shuffled(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).iterator()
    n = 0
    while stages.hasNext():
        n += stages.next().shuffleWriteBytes()
    return n


@pytest.mark.parametrize("blocks", [1, 16])
def test_bitmaps_are_sent_once_not_once_a_pair(spark, monkeypatch, blocks):
    """300 nodes, 8192 queries, all 44,850 pairs: 1 KB a node, 46 MB if each pair took its bitmaps along."""
    monkeypatch.setattr(pairs, "REGION_BLOCKS", blocks, raising=False)
    served = spark.range(300 * 8192).select((F.col("id") % 300).alias("node"), F.expr("id div 300").alias("query_id")).where("pmod(xxhash64(node, query_id), 4) = 0")
    nodes = spark.range(300)
    asked = nodes.toDF("node_i").crossJoin(nodes.toDF("node_j")).where("node_i < node_j")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as tables of size are joined
    before = shuffled(spark)
    try:
        got = {(r.node_i, r.node_j): r.shared for r in pairs.service_jaccard(served, asked).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled(spark) - before < 12 << 20
    own: dict[int, set[int]] = {n: set() for n in range(300)}
    for r in served.collect():
        own[r.node].add(r.query_id)
    assert got == {(a, b): len(own[a] & own[b]) for a in range(300) for b in range(a + 1, 300)}


def test_tasks_of_line_paths_grow_in_number(spark, monkeypatch):
    from roadlark.queries import derive

    folder = "/root/testdata/sf0.001"
    items = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    monkeypatch.setattr(derive, "ITEMS_PER_TASK", 500, raising=False)
    told = pairs.window_pairs(derive.line_paths(spark, folder), 3).groupBy(F.spark_partition_id()).agg(F.count_distinct("query_id").alias("n")).collect()
    assert len(told) >= 0.9 * items / 500


@pytest.mark.parametrize("least", [0, 1])
@pytest.mark.parametrize("edges", [0, 40, 3000])
def test_whole_frontiers_find_what_a_heap_finds(least, edges):
    rng = np.random.default_rng(edges + least)
    src, dst = rng.integers(0, 300, edges + 1), rng.integers(0, 300, edges + 1)
    rows = paths.Rows(src, dst, rng.integers(least, 50, edges + 1) / 7.0, np.arange(edges + 1))
    for origin in range(0, len(rows.ids), 7):
        nodes, told = rows.spread(origin)
        assert dict(zip(nodes.tolist(), told.tolist())) == {v: d for v, (d, _) in rows.reach(origin, None).items()}


def test_graph_files_are_narrow(spark):
    """Whole weights and usual edge numbers take 12 bytes each way, and both ways of an edge go through one narrow shuffle."""
    n = 60_000
    und = kept(spark.range(n).select(F.col("id").alias("edge_index"), (F.col("id") * 7919 % 9973 * 3).alias("src"), (F.col("id") * 104729 % 9967 * 3).alias("dst"), (1 + F.col("id") % 500).cast("double").alias("weight")))
    before = shuffled(spark)
    files = paths.GraphFiles(und)
    assert shuffled(spark) - before < 36 * n
    folder = Path("/" + files.base.removeprefix("file:").lstrip("/"))
    assert sum(x.stat().st_size for x in folder.iterdir() if x.name.startswith("rows-")) < 13 * 2 * n + 16 * 20_000 + 200


@pytest.mark.parametrize("number", [0, 1 << 40])
@pytest.mark.parametrize("part", [1.0, 0.1, 1e-300])
def test_graph_files_keep_every_bit(spark, monkeypatch, number, part):
    """Weights and edge numbers that 32 bits don't hold, ids far apart, two edges of a pair, a loop."""
    rng = np.random.default_rng(3)
    far = lambda k: int(k) * (1 << 50) - (1 << 53)
    edges = [(number + k, far(a), far(b), float(w) * part) for k, (a, b, w) in enumerate(zip(rng.integers(0, 12, 60), rng.integers(0, 12, 60), rng.integers(1, 99, 60)))]
    monkeypatch.setattr(paths, "ROWS_PER_FILE", 30)
    rows = paths.GraphFiles(spark.createDataFrame(edges, "edge_index long, src long, dst long, weight double").repartition(3)).value
    assert len(rows.parts) > 2
    got = sorted((int(e), int(rows.nodes([u])[0]), int(rows.nodes([v])[0]), w) for u in (rows.place(far(k)) for k in range(12)) if u >= 0 for v, w, e in zip(*rows.row(u), rows.edges(u)))
    assert got == sorted([(k, a, b, w) for k, a, b, w in edges] + [(k, b, a, w) for k, a, b, w in edges])


def test_block_tables_do_not_pass_the_driver(spark):
    """Cells, borders and what else grows with the graph are merged, however small they look."""
    from roadlark.operators import overlay

    und = spark.createDataFrame([(k, k, k + 1, 1.0) for k in range(30)], "edge_index long, src long, dst long, weight double")
    places = spark.range(31).select("id", (F.col("id") / 3.0).alias("x_loc"), F.lit(0.0).alias("y_loc"))
    blocks = overlay.Overlay(und, places, 2.0, 8)
    assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None
    got = overlay.distances(blocks, spark.createDataFrame([(3,)], "src long"), "arrow")
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.node: r.distance for r in got.collect()} == {k: float(abs(k - 3)) for k in range(31)}


def test_edges_stay_where_they_are(spark):
    """Pass counts and the nodes of the top tenth are looked up: neither labels nor hard negatives shuffle a table of all edges."""
    from roadlark.operators import frequency

    n = 120_000
    und = kept(spark.range(n).select(F.col("id").alias("edge_index"), (F.col("id") * 7919 % 9973).alias("src"), (F.col("id") * 104729 % 9967 + 5000).alias("dst"), (1 + F.col("id") % 500).cast("double").alias("weight")))
    traced = kept(spark.range(900).select(F.lit(2).cast("long").alias("count"), F.array((F.col("id") % 300) * 400, F.lit(n - 1).cast("long")).alias("edges")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as tables of size are joined
    before = shuffled(spark)
    try:
        features = kept(frequency.edge_features(und, traced))
        cold = kept(pairs.edge_hard_negatives(features))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled(spark) - before < 2 * n
    assert features.dtypes == [("edge_index", "bigint"), ("src", "bigint"), ("dst", "bigint"), ("weight", "double"), ("pass_count", "bigint")]
    assert {r.edge_index: r.pass_count for r in features.where("pass_count > 0").collect()} == {400 * k: 6 for k in range(300)} | {n - 1: 1800}
    assert features.count() == n and features.join(und, und.columns, "left_anti").isEmpty()
    ends = {x for r in features.where("pass_count > 0").collect() for x in (r.src, r.dst)}
    rows = features.where("pass_count = 0").collect()
    assert {r.edge_index for r in cold.collect()} == {r.edge_index for r in rows if r.src in ends or r.dst in ends}


def test_counts_of_nothing(spark):
    from roadlark.operators import frequency

    und = spark.createDataFrame([(0, 1, 2, 1.0)], "edge_index long, src long, dst long, weight double")
    none = spark.createDataFrame([], "count long, edges array<long>")
    assert [tuple(r) for r in frequency.edge_features(und, none).collect()] == [(0, 1, 2, 1.0, 0)]
    assert pairs.edge_hard_negatives(frequency.edge_features(und, none)).collect() == []


def _crowd(spark, n=4000, hub=3000):
    ring = spark.range(n).select("id", F.col("id").alias("src"), ((F.col("id") * 7 + 1) % n).alias("dst"))
    return kept(ring.unionByName(spark.range(1, hub).select((F.col("id") + n).alias("id"), F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))).select(F.col("id").alias("edge_index"), "src", "dst", F.lit(1.0).alias("weight")))


def test_drawn_negatives_do_not_move_all_pairs(spark):
    """A hub of 3,000 has 4.5 million pairs two hops apart; the 50 with the least draws are found without a shuffle of the others."""
    und = _crowd(spark)
    held = spark.createDataFrame([(5, 6), (1, 3)], "node_i long, node_j long")
    before = shuffled(spark)
    got = {(r.node_i, r.node_j) for r in pairs.hard_negatives(und, held, 50).collect()}
    assert shuffled(spark) - before < 2 << 20
    every = graph.two_hop_neighbors(und).join(held, ["node_i", "node_j"], "left_anti")
    assert got == {(r.node_i, r.node_j) for r in pairs._some(every, 50, 42).collect()}


@pytest.mark.parametrize("n", [0, 3, 10**6])
def test_drawn_negatives_where_few_are_left(spark, monkeypatch, n):
    monkeypatch.setattr(pairs, "DRAWN_TIMES", 1e-3, raising=False)
    und = spark.createDataFrame([(k, k % 9, k * k % 10, 1.0) for k in range(20)], "edge_index long, src long, dst long, weight double")
    every = {(r.node_i, r.node_j) for r in graph.two_hop_neighbors(und).collect()}
    left = sorted(every)[:2] + sorted(every)[-2:]
    held = spark.createDataFrame(sorted(every - set(left)), "node_i long, node_j long")
    want = {(r.node_i, r.node_j) for r in pairs._some(spark.createDataFrame(left, "node_i long, node_j long"), n, 42).collect()}
    assert {(r.node_i, r.node_j) for r in pairs.hard_negatives(und, held, n).collect()} == want


def test_draws_of_arrays_are_those_of_sql(spark):
    from roadlark.functions import draw, drawn

    rows = spark.range(-50, 50).select((F.col("id") * 123_456_789_012).alias("id")).withColumn("d", draw("id", 42)).toPandas()
    assert drawn(rows["id"].to_numpy(), 42).tolist() == rows["d"].tolist()


@pytest.mark.parametrize("block", [2, 3, 2048])
def test_chosen_pairs_are_all_pairs_chosen(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "PAIRS_AT_ONCE", 7, raising=False)
    und = spark.createDataFrame([(k, k % 9, k * k % 10, 1.0) for k in range(20)], "edge_index long, src long, dst long, weight double")
    got = [(r.node_i, r.node_j) for r in graph.chosen_two_hop(und, lambda i, j: (i + j) % 3 > 0, block).collect()]
    assert sorted(got) == sorted((r.node_i, r.node_j) for r in graph.two_hop_neighbors(und).collect() if (r.node_i + r.node_j) % 3)


def test_steps_do_not_pass_the_driver(spark):
    """A step of 100,000 nodes meets the graph and what is known without being sent to the driver."""
    from roadlark.operators import stepping

    n = 100_000
    und = kept(spark.range(n).select(F.col("id").alias("edge_index"), F.lit(0).cast("long").alias("src"), F.xxhash64("id").alias("dst"), (1 + F.abs(F.xxhash64("id", F.lit(1))) % 1_000_003 / 1e6).alias("weight")))
    told = lambda: _sum_of_stages(spark, "resultSize")
    before = told()
    got = stepping.distances(graph.adjacency(und), spark.sql("SELECT 7L AS src, 0L AS node, 0D AS distance, 0L AS hops"), 2.5)
    assert told() - before < 1 << 20
    assert spark.conf.get("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "0b") in ("0", "0b")
    assert got.count() == n + 1 and got.join(und, got.node == und.dst).where("distance = weight").count() == n


def _sum_of_stages(spark, figure: str) -> int:
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).iterator()
    n = 0
    while stages.hasNext():
        n += getattr(stages.next(), figure)()
    return n
