"""Node-pair and edge samples from the paths of a workload."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draw, draw_sql, drawn, uniform_sql
from ..functions.draws import MODULUS
from ..plans.stable import kept, numbered, stable
from . import graph
from .frequency import KeptCounts, top_decile
from .graph import grid_cells, two_hop_neighbors

STRONG_QUERIES, STRONG_COUNT = 3, 5
#: How many times the pairs that are asked for are drawn at first, of all pairs that nodes may make.
DRAWN_TIMES = 16


def window_pairs(paths: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, node_i, node_j, window_distance): pairs at most k places apart on a path, node_i < node_j.

    Made within each path's own list, so nothing is joined: a path of n nodes has k * n pairs at most.
    """
    n = F.size("nodes")
    at = lambda d: F.transform(F.sequence(F.lit(1), F.greatest(n - d, F.lit(1))), lambda i: F.struct(F.least(F.element_at("nodes", i), F.try_element_at("nodes", i + d)).alias("node_i"), F.greatest(F.element_at("nodes", i), F.try_element_at("nodes", i + d)).alias("node_j"), d.alias("window_distance")))
    each = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda d: F.when(n > d, at(d)).otherwise(F.array().cast("array<struct<node_i:bigint,node_j:bigint,window_distance:int>>"))))
    return paths.where(n > 1).select("query_id", F.inline(each)).where("node_i <> node_j")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(node_i, node_j, cooccur_count, query_count, decay): summed by query first, so that distinct queries need no second expansion."""
    by_query = pairs.groupBy("node_i", "node_j", "query_id").agg(F.count("*").alias("n"), F.sum(F.lit(1.0) / F.col("window_distance")).alias("d"))
    return by_query.groupBy("node_i", "node_j").agg(F.sum("n").alias("cooccur_count"), F.count("*").alias("query_count"), F.sum("d").alias("decay"))


def strength(cooccur: str = "cooccur_count", queries: str = "query_count") -> Column:
    return F.when((F.col(queries) >= STRONG_QUERIES) & (F.col(cooccur) >= STRONG_COUNT), "strong").otherwise("weak")


def weight(kind: str = "log_product") -> Column:
    """count, log_count, log_product, or decay."""
    c, q = F.col("cooccur_count"), F.col("query_count")
    return {"count": c.cast("double"), "log_count": F.log1p(c), "log_product": F.log1p(c) * F.log1p(q), "decay": F.col("decay")}[kind]


def positive_pairs(counts: DataFrame, kind: str = "log_product") -> DataFrame:
    return counts.select("node_i", "node_j", F.lit(1).alias("label"), strength().alias("strength"), weight(kind).alias("weight"), "cooccur_count", "query_count", F.lit("path_window").alias("source"))


def _negatives(pairs: DataFrame, source: str | Column) -> DataFrame:
    zero = F.lit(0).cast("long")
    return pairs.select("node_i", "node_j", F.lit(0).alias("label"), F.lit("negative").alias("strength"), F.lit(1.0).alias("weight"), zero.alias("cooccur_count"), zero.alias("query_count"), (F.lit(source) if isinstance(source, str) else source).alias("source"))


def _some(pairs: DataFrame, n: int | None, seed: int) -> DataFrame:
    """n pairs by a draw on both ids, or all."""
    return pairs if n is None else pairs.withColumn("_d", draw("node_i * 1000003 + node_j", seed)).orderBy("_d", "node_i", "node_j").limit(n).drop("_d")


def hard_negatives(undirected: DataFrame, counts: DataFrame, n: int | None = None, seed: int = 42) -> DataFrame:
    """Nodes one or two edges apart that no path window holds together; n of them, drawn, if n is given.

    The n are those with the least draws, so only pairs whose draw is below a bar leave the task that makes them. The bar rises until n are found.
    """
    held = counts.select("node_i", "node_j")
    if n is None:
        return _negatives(two_hop_neighbors(undirected).join(held, ["node_i", "node_j"], "left_anti"), "hard_negative")
    degree = graph.adjacency(undirected).groupBy("node").agg(F.count("*").cast("double").alias("n"))
    most = degree.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(1.0))).first()[0]
    bar = DRAWN_TIMES * max(1, n) / most
    while True:
        most_drawn = math.ceil(min(1.0, bar) * MODULUS)
        near = graph.chosen_two_hop(undirected, lambda i, j, most=most_drawn: drawn(i * 1_000_003 + j, seed) < most)
        found = kept(near.join(held, ["node_i", "node_j"], "left_anti"))
        if bar >= 1 or found.count() >= n:
            return _negatives(_some(found, n, seed), "hard_negative")
        bar *= 16


def area_negatives(points: DataFrame, counts: DataFrame, delta: float, n: int | None = None, seed: int = 42) -> DataFrame:
    """Pairs of one grid cell that no path window holds together: each point (id, x_loc, y_loc) with one other of its cell, drawn.

    No cell's pairs are all written out; of the pairs found n are drawn if n is given.
    """
    cells = grid_cells(points, delta).groupBy("id").agg(F.min(F.struct("cell_x", "cell_y")).alias("cell")).select("id", "cell")
    ranked = numbered(cells, [F.col("cell"), F.col("id")], "rank")
    bounds = ranked.groupBy("cell").agg(F.min("rank").alias("low"), F.count("*").alias("size")).where("size > 1")
    step = 1 + F.expr(draw_sql("id", seed)) % (F.col("size") - 1)
    asked = ranked.join(bounds, "cell").select("id", (F.col("low") + (F.col("rank") - F.col("low") + step) % F.col("size")).alias("rank"))
    pairs = asked.join(ranked.select("rank", F.col("id").alias("other")), "rank").select(F.least("id", "other").alias("node_i"), F.greatest("id", "other").alias("node_j")).distinct()
    return _negatives(_some(pairs.join(counts.select("node_i", "node_j"), ["node_i", "node_j"], "left_anti"), n, seed), "hard_negative")


def random_negatives(nodes: DataFrame, counts: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n pairs of different nodes (column `node`) that no path window holds together: the first of a row of draws, each once.

    Where half of all such pairs or more are asked for, all are listed and drawn from, so they are fewer only if there are no more.
    """
    ranked = kept(numbered(nodes.select("node").distinct(), [F.col("node")], "rank"))
    total = ranked.count()
    held = kept(counts.select("node_i", "node_j"))
    spark, every = nodes.sparkSession, total * (total - 1) // 2
    if total < 2 or not n:
        return _negatives(held.limit(0), "random_negative")
    named = lambda pairs: pairs.join(ranked.select(F.col("rank").alias("a"), F.col("node").alias("node_i")), "a").join(ranked.select(F.col("rank").alias("b"), F.col("node").alias("node_j")), "b").join(held, ["node_i", "node_j"], "left_anti")
    draws = n
    while every > 2 * (n + held.count()) and draws <= 16 * every:
        draws *= 2
        drawn = spark.range(1, draws + 1).select("id", F.expr(uniform_sql("id", seed, str(total))).alias("a"), F.expr(uniform_sql("id", seed + 1, str(total))).alias("b")).where("a <> b")
        pairs = drawn.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("id").alias("id"))
        found = stable(named(pairs).orderBy("id").limit(n).select("node_i", "node_j"))
        if found.count() == n:
            return _negatives(found, "random_negative")
    # pairs are no more than what is asked for and held, or than what was drawn; number x is the ranks a < b with x = b (b - 1) / 2 + a
    b = F.floor((1 + F.sqrt(1 + 8 * F.col("x").cast("double"))) / 2).cast("long")
    near = spark.range(every).withColumnRenamed("id", "x").withColumn("b", b)
    near = near.withColumn("b", F.when(F.expr("b * (b - 1) div 2 > x"), F.col("b") - 1).when(F.expr("(b + 1) * b div 2 <= x"), F.col("b") + 1).otherwise(F.col("b")))
    pairs = named(near.select(F.expr("x - b * (b - 1) div 2").alias("a"), "b"))
    return _negatives(_some(pairs.select("node_i", "node_j"), n, seed), "random_negative")


def pair_samples(counts: DataFrame, *negatives: DataFrame, kind: str = "log_product") -> DataFrame:
    """Positive pairs, and the pairs of all negatives: each once, from the first table that has it; none that is positive."""
    out = positive_pairs(counts, kind)
    if not negatives:
        return out
    told = None
    for k, n in enumerate(negatives):
        rows = n.select("node_i", "node_j", F.struct(F.lit(k).alias("at"), "source").alias("s"))
        told = rows if told is None else told.unionByName(rows)
    once = told.groupBy("node_i", "node_j").agg(F.min("s").alias("s")).join(counts.select("node_i", "node_j"), ["node_i", "node_j"], "left_anti")
    return out.unionByName(_negatives(once, F.col("s.source")))


def ppmi(counts: DataFrame, least: float = 0.0) -> DataFrame:
    """(node_i, node_j, cooccur_count, ppmi) of pairs with ppmi >= least: max(0, ln(P(i, j) / (P(i) P(j)))).

    With N pairs in all and m of a node: P(i, j) = c / N, P(i) = m / 2N.
    """
    ends = counts.select(F.explode(F.array("node_i", "node_j")).alias("node"), "cooccur_count").groupBy("node").agg(F.sum("cooccur_count").alias("m"))
    total = counts.agg(F.coalesce(F.sum("cooccur_count"), F.lit(0))).first()[0]
    told = counts.join(ends.select(F.col("node").alias("node_i"), F.col("m").alias("mi")), "node_i").join(ends.select(F.col("node").alias("node_j"), F.col("m").alias("mj")), "node_j")
    score = F.greatest(F.lit(0.0), F.log(F.lit(4.0) * F.lit(float(total)) * F.col("cooccur_count") / (F.col("mi").cast("double") * F.col("mj"))))
    return told.select("node_i", "node_j", "cooccur_count", score.alias("ppmi")).where(F.col("ppmi") >= least)


def services(paths: DataFrame) -> DataFrame:
    """(node, query_id): the queries whose paths pass a node, each once."""
    return paths.select(F.explode("nodes").alias("node"), "query_id").distinct()


#: Words of 64 queries that a block has, and from how many with any query on a node's block is an array of all its words.
BLOCK_WORDS, DENSE_WORDS = 64, 16


def query_blocks(served: DataFrame) -> DataFrame:
    """(node, block, n, words, all_words): the queries of a node as compressed bitmaps, by blocks of 4096 queries that are numbered without gaps.

    `words` are the 64-bit words in which the node has any query, as a map from their place in the block; where they are
    many they stand in `all_words`, an array with all words of the block, and `words` is null. `n` is the number of queries.
    """
    numbers = numbered(served.select("query_id").distinct(), [F.col("query_id")], "number")
    at = served.join(numbers, "query_id").select("node", F.shiftright("number", 12).alias("block"), (F.shiftright("number", 6) % BLOCK_WORDS).cast("int").alias("word"), F.expr("shiftleft(1L, CAST(number % 64 AS INT))").alias("bit"))
    bits = at.groupBy("node", "block", "word").agg(F.bit_or("bit").alias("bits"))
    blocks = bits.groupBy("node", "block").agg(F.sum(F.bit_count("bits")).alias("n"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("found"))
    dense = F.size("found") >= DENSE_WORDS
    every = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("found", i), F.lit(0).cast("long")))
    return blocks.select("node", "block", "n", F.when(~dense, F.col("found")).alias("words"), F.when(dense, every).alias("all_words"))


#: Blocks whose bitmaps meet in one task: 65,536 queries.
REGION_BLOCKS = 16
#: Pairs that are counted at once in a block; their bitmaps take 1 KB each.
PAIRS_AT_ONCE = 20_000


def _count_region(blocks: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """(node_i, node_j, shared) of the asked pairs in the blocks of one region: bits that both bitmaps of a block have."""
    nodes = np.sort(blocks["node"].unique())
    i, j = (np.searchsorted(nodes, asked[c].to_numpy()) for c in ("node_i", "node_j"))
    shared = np.zeros(len(asked), np.int64)
    for _, own in blocks.groupby("block"):
        row = np.full(len(nodes), -1)
        row[np.searchsorted(nodes, own["node"].to_numpy())] = np.arange(len(own))
        bits = np.zeros((len(own), BLOCK_WORDS), np.uint64)
        for k, (at, words) in enumerate(zip(own["at"], own["bits"])):
            bits[k, at] = words.view(np.uint64)
        a, b = row[i], row[j]
        both = np.flatnonzero((a >= 0) & (b >= 0))
        for k in range(0, len(both), PAIRS_AT_ONCE):
            part = both[k : k + PAIRS_AT_ONCE]
            shared[part] += np.bitwise_count(bits[a[part]] & bits[b[part]]).sum(1, dtype=np.int64)
    found = np.flatnonzero(shared)
    return pd.DataFrame({"node_i": asked["node_i"].to_numpy()[found], "node_j": asked["node_j"].to_numpy()[found], "shared": shared[found]})


def service_jaccard(served: DataFrame, candidates: DataFrame, least: float = 0.0) -> DataFrame:
    """(node_i, node_j, shared, jaccard) of candidate pairs: queries that pass both over queries that pass either.

    A task has the bitmaps of a region of queries and the candidates both of whose nodes have queries there, so bitmaps are
    sent once, not once a pair. Only candidates are counted, so a query's path is never squared.
    """
    blocks = kept(query_blocks(served).withColumn("region", F.expr(f"block div {REGION_BLOCKS}")))
    sizes = kept(blocks.groupBy("node").agg(F.sum("n").alias("n")))
    pairs = kept(candidates.select("node_i", "node_j").distinct())
    there = kept(blocks.select("node", "region").distinct())
    asked = pairs.join(there.withColumnRenamed("node", "node_i"), "node_i").join(there.withColumnRenamed("node", "node_j"), ["node_j", "region"])
    every = F.sequence(F.lit(0), F.lit(BLOCK_WORDS - 1))
    bitmaps = blocks.select("region", "node", "block", F.coalesce(F.map_keys("words"), every).alias("at"), F.coalesce(F.map_values("words"), "all_words").alias("bits"))
    met = bitmaps.groupBy("region").cogroup(asked.groupBy("region")).applyInPandas(_count_region, "node_i long, node_j long, shared long")
    shared = met.groupBy("node_i", "node_j").agg(F.sum("shared").alias("shared"))
    told = pairs.join(shared, ["node_i", "node_j"], "left").join(sizes.select(F.col("node").alias("node_i"), F.col("n").alias("ni")), "node_i").join(sizes.select(F.col("node").alias("node_j"), F.col("n").alias("nj")), "node_j")
    s = F.coalesce("shared", F.lit(0))
    return told.select("node_i", "node_j", s.alias("shared"), (s / (F.col("ni") + F.col("nj") - s)).alias("jaccard")).where(F.col("jaccard") >= least)


def edge_samples(features: DataFrame) -> DataFrame:
    """(src, dst, weight, pass_count, label): edges that paths take are positive, others negative."""
    return features.select("edge_index", "src", "dst", "weight", "pass_count", F.when(F.col("pass_count") > 0, 1).otherwise(0).alias("label"))


def edge_hard_negatives(features: DataFrame, low: int = 0) -> DataFrame:
    """Edges passed `low` times at most that touch an edge of the top tenth; `features` has a row for each edge. Edges stay where they
    are: they look up the nodes of the top tenth."""
    hot = top_decile(features, "edge_index").where(F.col("pass_count") > low)
    ends = KeptCounts(hot.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n")), "node", "n")
    cold = features.where(F.col("pass_count") <= low).select("edge_index", "src", "dst", "weight", "pass_count", F.lit(0).alias("label"))

    def touching(batches):
        for batch in batches:
            yield batch.filter(pa.array((ends.of(batch.column(1)) > 0) | (ends.of(batch.column(2)) > 0)))

    return cold.mapInArrow(touching, cold.schema)


def edge_area_negatives(features: DataFrame, points: DataFrame, delta: float, low: int = 0) -> DataFrame:
    """Edges passed `low` times at most that begin in a grid cell where an edge of the top tenth begins or ends; points are (id, x_loc, y_loc)."""
    cells = grid_cells(points, delta).groupBy("id").agg(F.min(F.struct("cell_x", "cell_y")).alias("cell"))
    hot = top_decile(features, "edge_index").where(F.col("pass_count") > low).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    warm = hot.join(cells, "id").select("cell").distinct()
    cold = features.where(F.col("pass_count") <= low).join(cells.withColumnRenamed("id", "src"), "src").join(warm, "cell", "left_semi")
    return cold.select("edge_index", "src", "dst", "weight", "pass_count", F.lit(0).alias("label"))
