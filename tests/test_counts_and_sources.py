"""The data source, counters of writes, selection by rank, paths as a table function, negatives."""

from __future__ import annotations

import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from roadlark import cli, sources
from roadlark.operators import frequency, pairs, paths
from roadlark.plans.stable import nth_smallest, smallest, stable_counted
from roadlark.sources import datasource

UND = "edge_index long, src long, dst long, weight double"


@pytest.mark.parametrize("step", [1, 3, 7, 64, 10_000])
def test_every_line_is_in_one_range(step):
    data = b"".join(b"a %d %d 1\n" % (k, k * k) for k in range(40)) + b"\n" + b"last"
    found = [x for r in datasource.ranges([("f", len(data))], step) for x in datasource.lines_of(io.BytesIO(data), r.start, r.end)]
    whole = io.BytesIO(data).readlines()
    assert [line for _, line in found] == whole and all(data[at : at + len(line)] == line for at, line in found)


def test_data_source(spark, tmp_path):
    lines = ["c sample", "p sp 900 800", "p aux sp co 5"] + [f"a {k} {k + 1} {k % 7}" for k in range(800)] + ["v 7 2000000 -3000000", ""]
    (tmp_path / "x.gr").write_text("\n".join(lines))
    with gzip.open(tmp_path / "y.gr.gz", "wt") as f:
        f.write("a 5000 5001 2\n")
    (tmp_path / "_SUCCESS").write_text("")
    arcs = sources.read_roads(spark, str(tmp_path), "arcs", 1000)
    assert arcs.rdd.getNumPartitions() > 8
    assert sorted((r.u, r.v, r.w) for r in arcs.collect()) == [(k, k + 1, float(k % 7)) for k in range(800)] + [(5000, 5001, 2.0)]
    in_file = arcs.where(F.col("file").endswith("x.gr")).orderBy("at").select("u").collect()
    assert [r.u for r in in_file] == list(range(800))
    uri = f"file://{tmp_path}/x.gr"
    assert [(r.id, r.x_loc, r.y_loc) for r in sources.read_roads(spark, uri, "points", 50).collect()] == [(7, 2.0, -3.0)]
    assert sorted((r.kind, r.n, r.m) for r in sources.read_roads(spark, uri, "problem").collect()) == [("arcs", 900, 800), ("points", 5, None)]
    tags = sources.read_roads(spark, uri, "lines", 500)
    assert {r.tag: r["count"] for r in tags.groupBy("tag").count().collect()} == {"c": 1, "p": 2, "a": 800, "v": 1}
    pushed = tags.where("tag = 'p' AND rest LIKE 'sp%'")
    assert [r.rest for r in pushed.collect()] == ["sp 900 800"]
    plan = pushed._jdf.queryExecution().executedPlan().toString()
    assert "tag" not in plan.split("Filter")[1].split("\n")[0] or "= p" not in plan  # the scan does it, not Spark
    (tmp_path / "bad.gr").write_text("a 1 2\n")
    with pytest.raises(Exception, match="not 4 fields"):
        sources.read_roads(spark, str(tmp_path / "bad.gr"), "arcs").collect()
    with pytest.raises(Exception, match="kind is one of"):
        sources.read_roads(spark, uri, "nothing")
    with pytest.raises(Exception, match="nowhere"):
        sources.read_roads(spark, str(tmp_path / "nowhere"), "arcs").count()


def jobs(spark, name, act) -> int:
    spark.sparkContext.setJobGroup(name, name)
    try:
        act()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_counters_take_no_pass_of_their_own(spark, tmp_path):
    table = spark.range(0, 1000, 1, 5).withColumn("x", F.col("id") % 7)
    seen = {}
    plain = jobs(spark, "plain", lambda: sources.write_table(table, f"{tmp_path}/a", "csv", order="id"))
    counted = jobs(spark, "counted", lambda: seen.update(sources.write_table(table, f"{tmp_path}/b", "csv", order="id", n=F.count("*"), sevens=F.count_if(F.col("x") == 0))))
    assert seen == {"n": 1000, "sevens": 143} and plain == counted
    kept, told = stable_counted(table, n=F.count("*"), most=F.max("x"))
    assert told == {"n": 1000, "most": 6} and kept.count() == 1000


def test_commands_report_what_they_wrote(spark, tmp_path, capsys):
    (tmp_path / "c.co").write_text("".join(f"v {k} {k * 1000} {k * k % 97 * 1000}\n" for k in range(1, 101)))
    (tmp_path / "g.gr").write_text("".join(f"a {k} {k % 100 + 1} {1 + k % 7}\n" for k in range(1, 101)))
    co, out = str(tmp_path / "c.co"), str(tmp_path / "w")

    def numbers(*args):
        cli.main(list(args), spark)
        rows = [[c.strip() for c in line.strip("|").split("|")] for line in capsys.readouterr().out.splitlines() if line.startswith("|")]
        return dict(zip(rows[0], map(int, rows[1])))

    assert numbers("workload", "--coords", co, "--output-dir", out, "--train-size", "30", "--test-size", "5", "--num-hotspots", "3", "--nodes-per-hotspot", "6") == {"nodes": 100, "hotspots": 3, "train_queries": 30, "test_queries": 5}
    got = numbers("samples", "--coords", co, "--graph", str(tmp_path / "g.gr"), "--queries", f"{out}/queries_train", "--output-dir", f"{out}/s", "--workers", "3", "--chunk-size", "7")
    assert got == {"num_queries": 30, "unreachable_queries": 0, "nodes": 100, "positive_nodes": 10, "negative_nodes": 10, "edges": 100, "positive_edges": 10, "negative_edges": 10}
    assert numbers("hotspots", "--coords", co, "--hotspots", f"{out}/hotspots", "--output", f"{out}/h") == {"points": 100, "hotspots": 3}
    assert numbers("combined", "--coords", co, "--hotspots", f"{out}/hotspots", "--node-counts", f"{out}/s/node_counts", "--edge-counts", f"{out}/s/edge_counts", "--output", f"{out}/l") == {"hotspots": 3, "positive_nodes": 10, "positive_edges": 10}


def test_number_of_tasks_can_be_asked_for(spark):
    und = spark.createDataFrame([(k, k, k + 1, 1.0) for k in range(30)], UND)
    asked = spark.createDataFrame([(k, k % 30, (k * 7) % 30, 1) for k in range(90)], "query_id long, origin long, destination long, count long")
    assert paths.trace_paths(und, asked, "arrow", tasks=5).rdd.getNumPartitions() == 5


def test_selection_by_rank(spark, monkeypatch):
    rng = random.Random(12)
    values = [rng.choice([0, 0, 0, 1, 5, 10**12, -7, rng.randint(-(10**15), 10**15)]) for _ in range(400)]
    rows = spark.createDataFrame([(k * 3, v) for k, v in enumerate(values)], "key long, value long").repartition(3)
    expected = sorted(range(400), key=lambda k: (values[k], k))
    for cells in (9, 4096):
        monkeypatch.setattr("roadlark.plans.stable.CELLS", cells)
        for n in (1, 200, 400) if cells > 9 else (57,):
            assert nth_smallest(rows, "value", n) == sorted(values)[n - 1]
            assert sorted(r.key for r in rows.where(smallest(rows, n, "value", "key")).collect()) == sorted(3 * k for k in expected[:n])
    wide = spark.createDataFrame([(k, v) for k, v in enumerate((-(2**62), 5, 2**62, 7))], "key long, value long")
    assert [nth_smallest(wide, "value", n) for n in (1, 2, 3, 4)] == [-(2**62), 5, 7, 2**62]


def test_a_tenth_moves_no_rows(spark):
    rng = random.Random(3)
    counts = [rng.choice([0, 0, 0, 1, 2, 9]) for _ in range(95)]
    table = spark.createDataFrame([(k, c) for k, c in enumerate(counts)], "node long, pass_count long").repartition(4)
    top = frequency.top_decile(table, "node")
    best = sorted(range(95), key=lambda k: (-counts[k], k))[:10]
    assert sorted(r.node for r in top.collect()) == sorted(best)
    told = frequency.label(table, "node")
    for df in (top, told):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    roles = {r.node: r.sample_role for r in told.collect()}
    assert sorted(k for k, r in roles.items() if r == "positive") == sorted(best) and sum(r == "negative" for r in roles.values()) == 10
    assert frequency.label(table.limit(0), "node").count() == 0 and frequency.top_decile(table.limit(0), "node").count() == 0
    few = frequency.label(table.where("node < 1"), "node").collect()
    assert [(r.label, r.sample_role) for r in few] == [(1, "positive")]


def test_python_draws_go_on_where_the_task_stopped(spark):
    """Nodes, then edges, by one generator, as a single program would draw them."""
    rows = spark.range(50).withColumnRenamed("id", "key")
    ours, theirs = random.Random(9), random.Random(9)
    for n in (7, 13):
        assert sorted(r.key for r in frequency.sample_negatives_like_random(rows, "key", n, ours).collect()) == sorted(theirs.sample(range(50), n))
    assert ours.random() == theirs.random()


def test_paths_as_a_table_function(spark):
    traced = spark.createDataFrame([(1, [4, 5, 6], [10, 11]), (2, [9], []), (3, [], [])], "query_id long, nodes array<long>, edges array<long>")
    want = [(1, 0, 4, 10), (1, 1, 5, 11), (1, 2, 6, None), (2, 0, 9, None)]
    assert sorted(tuple(r) for r in paths.path_steps(traced).collect()) == want
    paths.register_path_steps(spark)
    traced.createOrReplaceTempView("traced")
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM path_steps(TABLE(traced))").collect()) == want
    with pytest.raises(Exception, match="query_id, nodes and edges"):
        spark.sql("SELECT * FROM path_steps(TABLE(SELECT 1 AS x))").collect()


def test_each_pair_is_a_sample_once(spark):
    counts = spark.createDataFrame([(1, 2, 5, 3, 1.0)], "node_i long, node_j long, cooccur_count long, query_count long, decay double")
    table = lambda rows, source: pairs._negatives(spark.createDataFrame(rows, "node_i long, node_j long"), source)
    got = pairs.pair_samples(counts, table([(1, 3), (2, 3)], "hard_negative"), table([(2, 3), (1, 2), (4, 5)], "random_negative")).collect()
    assert sorted((r.node_i, r.node_j, r.label, r.source) for r in got) == [(1, 2, 1, "path_window"), (1, 3, 0, "hard_negative"), (2, 3, 0, "hard_negative"), (4, 5, 0, "random_negative")]


def test_random_negatives_of_a_small_graph(spark):
    """As many as are asked for, or all that there are."""
    nodes = spark.range(9).withColumnRenamed("id", "node")
    held = [(0, 1), (3, 5), (7, 8)]
    counts = spark.createDataFrame(held, "node_i long, node_j long")
    every = {(a, b) for a in range(9) for b in range(a + 1, 9)} - set(held)
    for n in (2, 20, 33, 500):
        got = [(r.node_i, r.node_j) for r in pairs.random_negatives(nodes, counts, n).collect()]
        assert len(got) == len(set(got)) == min(n, len(every)) and set(got) <= every
    assert pairs.random_negatives(nodes, counts, 0).count() == 0


def test_what_a_run_left_can_be_deleted(spark):
    from roadlark.plans.stable import Tables, clean, run_folder

    tables = Tables(spark, "some")
    spark.range(3).write.parquet(tables.path("rows"))
    assert tables.listed(tables.base) == ["0001-rows"] and tables.base.startswith(run_folder(spark))
    tables.drop()
    spark.range(3).write.parquet(Tables(spark, "others").path("rows"))
    clean(spark)
    with pytest.raises(Exception, match="does not exist"):
        tables.listed(run_folder(spark))
