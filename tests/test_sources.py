from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from roadlark import cli, sources
from roadlark.operators import layers, paths

CO = "c sample\np aux sp co 3\nv 1 -73530767 41085396\nv 2 -73530538 41086098\nv 4 -73519366 41048796\n"
GR = "c sample\np sp 4 5\na 1 2 1\na 2 1 1\na 2 4 1\na 1 4 5\na 4 4 2\n"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "small").mkdir()
    co, gr = tmp_path / "small" / "x.co", tmp_path / "x.gr"
    co.write_text(CO)
    gr.write_text(GR)
    return co, gr


def test_points(spark, files):
    got = sorted(tuple(r) for r in sources.read_points(spark, str(files[0])).select("id", "x_loc", "y_loc").collect())
    assert got == [(1, -73.530767, 41.085396), (2, -73.530538, 41.086098), (4, -73.519366, 41.048796)]


def test_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "x.co.gz", "wt") as f:
        f.write(CO)
    assert sources.read_points(spark, str(tmp_path / "x.co.gz")).count() == 3


def test_universe_fills_gaps_and_last_line_wins(spark, tmp_path):
    (tmp_path / "d.co").write_text(CO + "v 1 1000000 2000000\n")
    got = {r.node: (r.lon, r.lat) for r in sources.points_universe(sources.read_points(spark, str(tmp_path / "d.co"))).collect()}
    assert got == {1: (1.0, 2.0), 2: (-73.530538, 41.086098), 3: (0.0, 0.0), 4: (-73.519366, 41.048796)}
    assert sources.points_universe(sources.read_points(spark, str(tmp_path / "d.co")), fill_gaps=False).count() == 3


def test_empty_and_damaged(spark, tmp_path):
    (tmp_path / "e.co").write_text("c nothing\n")
    assert sources.read_points(spark, str(tmp_path / "e.co")).count() == 0
    assert sources.points_universe(sources.read_points(spark, str(tmp_path / "e.co"))).count() == 0
    with pytest.raises(ValueError):
        sources.read_points(spark, str(tmp_path / "e.co"), allow_empty=False)
    (tmp_path / "bad.co").write_text("v 1 2\n")
    with pytest.raises(Exception, match="four fields"):
        sources.read_points(spark, str(tmp_path / "bad.co")).collect()


def test_unit_edges(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# FromNodeId ToNodeId\n0 1\n0\t6309\n1 0\n")
    got = sorted(tuple(r) for r in sources.read_unit_edges(spark, str(tmp_path / "s.txt")).select("u", "v", "w").collect())
    assert got == [(0, 1, 1.0), (0, 6309, 1.0), (1, 0, 1.0)]


def test_queries_without_count(spark, tmp_path):
    (tmp_path / "q.csv").write_text("query_id,origin,destination,extra\n7,1,2,x\n")
    assert [tuple(r) for r in sources.read_queries(spark, str(tmp_path / "q.csv")).drop("line").collect()] == [(7, 1, 2, 1)]


def test_scale_and_title():
    assert sources.scale_paths("/d", "medium")[1].endswith("BAY.gr")
    with pytest.raises(ValueError):
        sources.scale_paths("/d", "huge")
    assert layers.title("/a/Small/NY.co.txt", 1234) == "DIMACS small nodes - NY (1,234 points)"
    assert layers.title("x.txt", 5) == "DIMACS DIMACS nodes - x (5 points)"


def test_command_line(spark, files, tmp_path, capsys):
    co, gr = map(str, files)
    cli.main(["summary", "--coords", co, "--graph", gr], spark)
    assert "num_total_edges" in capsys.readouterr().out
    (tmp_path / "big.co").write_text("".join(f"v {k} {k * 1000} {k * k % 977 * 1000}\n" for k in range(1, 200)))
    big, out = str(tmp_path / "big.co"), str(tmp_path / "w")
    cli.main(["workload", "--coords", big, "--output-dir", out, "--train-size", "50", "--test-size", "20", "--num-hotspots", "4", "--nodes-per-hotspot", "10"], spark)
    assert sources.read_queries(spark, f"{out}/queries_train").count() == 50
    assert sources.read_hotspots(spark, f"{out}/hotspots").select("num_nodes").distinct().collect()[0][0] == 10
    (tmp_path / "big.gr").write_text("".join(f"a {k} {k % 199 + 1} {1 + k % 7}\n" for k in range(1, 200)))
    cli.main(["samples", "--coords", big, "--graph", str(tmp_path / "big.gr"), "--queries", f"{out}/queries_train", "--output-dir", f"{out}/s", "--max-queries", "20"], spark)
    nodes = sources.read_node_samples(spark, f"{out}/s/node_counts", None)
    assert nodes.count() == 199 and nodes.where("sample_role = 'positive'").count() == 20
    cli.main(["combined", "--coords", big, "--hotspots", f"{out}/hotspots", "--node-counts", f"{out}/s/node_counts", "--edge-counts", f"{out}/s/edge_counts", "--output", f"{out}/l"], spark)
    assert spark.read.parquet(f"{out}/l/positive_nodes").count() == 20
    assert spark.read.parquet(f"{out}/l/regions").count() == 40
    assert spark.read.parquet(f"{out}/s/layers_base").count() > 0 and spark.read.parquet(f"{out}/s/layers_positive_nodes").count() > 0
    cli.main(["pairs", "--coords", big, "--graph", str(tmp_path / "big.gr"), "--queries", f"{out}/queries_test", "--output-dir", f"{out}/pairs"], spark)
    samples = spark.read.csv(f"{out}/pairs/node_pair_samples", header=True)
    assert samples.columns == ["node_i", "node_j", "label", "strength", "weight", "cooccur_count", "query_count", "source"] and {r[0] for r in samples.select("label").distinct().collect()} == {"0", "1"}
    assert spark.read.csv(f"{out}/pairs/paths_train", header=True).columns == ["query_id", "origin", "destination", "distance", "path"]
    assert spark.read.csv(f"{out}/pairs/node_features", header=True).columns == ["node", "lon", "lat", "origin_count", "destination_count", "pass_count"]
    assert spark.read.csv(f"{out}/pairs/edge_features", header=True).columns == ["src", "dst", "weight", "pass_count"]
    cli.main(["points", "--input", big, "--output", f"{out}/p"], spark)
    cli.main(["hotspots", "--coords", big, "--hotspots", f"{out}/hotspots", "--output", f"{out}/h"], spark)
    assert spark.read.parquet(f"{out}/h/centers").count() == 4


def test_lines_of_many_splits_stay_in_order(spark, tmp_path):
    (tmp_path / "many.gr").write_text("".join(f"a {k} {k + 1} 1\n" for k in range(1, 5001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        from roadlark.operators import graph

        arcs = sources.read_arcs(spark, str(tmp_path / "many.gr"))
        assert arcs.rdd.getNumPartitions() > 3
        bad = graph.build_undirected(arcs).where(F.col("edge_index") != F.col("src") - 1)
        assert bad.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_path_text(spark):
    und = spark.createDataFrame([(0, 1, 2, 1.0), (1, 2, 3, 1.0)], "edge_index long, src long, dst long, weight double")
    q = spark.createDataFrame([(5, 1, 3, 1)], "query_id long, origin long, destination long, count long")
    assert paths.path_text(paths.trace_paths(und, q)).first().path == "1 2 3"


def test_first_queries_are_the_first_in_the_files(spark, tmp_path):
    from roadlark.operators.frequency import first_queries

    rows = [(9, 1, 2, 1), (3, 4, 5, 2), (7, 6, 7, 1), (1, 8, 9, 1)]
    (tmp_path / "q.csv").write_text("query_id,origin,destination,count\n" + "".join(",".join(map(str, r)) + "\n" for r in rows))
    got = first_queries(sources.read_queries(spark, str(tmp_path / "q.csv")), 2, "line").drop("line").collect()
    assert [tuple(r) for r in got] == rows[:2]


def test_normalised_tables(spark, tmp_path):
    (tmp_path / "n.csv").write_text("node,lon,lat\n1,-73.5,41.0\n2,-73.6,41.1\n")
    (tmp_path / "e.csv").write_text("src,dst,weight\n1,2,803\n2,1,803\n")
    assert [tuple(r) for r in sources.read_nodes(spark, str(tmp_path / "n.csv")).orderBy("id").collect()] == [(1, -73.5, 41.0), (2, -73.6, 41.1)]
    assert [tuple(r) for r in sources.read_edges(spark, str(tmp_path / "e.csv")).orderBy("line").drop("line").collect()] == [(1, 2, 803.0), (2, 1, 803.0)]


def test_unit_edges_of_three_fields_are_an_error(spark):
    lines = spark.createDataFrame([(0, "1 2 3")], "line long, value string")
    with pytest.raises(Exception, match="not two fields"):
        sources.parse_unit_edges(lines).collect()
