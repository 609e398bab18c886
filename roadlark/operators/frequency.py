"""How often a workload passes nodes and edges, and labelled samples from that."""

from __future__ import annotations

import pickle
import random
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import draw
from ..plans.stable import Tables, kept, nth_smallest, numbered, smallest, stable, tidy_shuffles
from .paths import Places, mapped_longs, put_longs


def origin_counts(queries: DataFrame) -> DataFrame:
    """(node, origin_count) over all queries, reachable or not."""
    return queries.groupBy(F.col("origin").alias("node")).agg(F.sum("count").alias("origin_count"))


def destination_counts(queries: DataFrame) -> DataFrame:
    return queries.groupBy(F.col("destination").alias("node")).agg(F.sum("count").alias("destination_count"))


def node_pass_counts(paths: DataFrame) -> DataFrame:
    """(node, pass_count) over the nodes of traced paths, both ends included."""
    return paths.select(F.explode("nodes").alias("node"), "count").groupBy("node").agg(F.sum("count").alias("pass_count"))


def edge_pass_counts(paths: DataFrame) -> DataFrame:
    return paths.select(F.explode("edges").alias("edge_index"), "count").groupBy("edge_index").agg(F.sum("count").alias("pass_count"))


def trace_summary(paths: DataFrame) -> DataFrame:
    """One row: num_queries, unreachable_queries - rows, whatever their count."""
    return paths.agg(F.count("*").alias("num_queries"), F.count_if(~F.col("reachable")).alias("unreachable_queries"))


def _zero(name: str):
    return F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)


def node_features(universe: DataFrame, queries: DataFrame, paths: DataFrame) -> DataFrame:
    """(node, lon, lat, origin_count, destination_count, pass_count) for every node of the universe."""
    counts = origin_counts(queries).join(destination_counts(queries), "node", "full").join(node_pass_counts(paths), "node", "full")
    return universe.join(counts, "node", "left").select("node", "lon", "lat", _zero("origin_count"), _zero("destination_count"), _zero("pass_count"))


class KeptCounts:
    """Counts by a key of 64 bits, in sorted files of the shared folder that workers map, so that a larger table with the key need not move."""

    def __init__(self, counts: DataFrame, key: str, value: str):
        base = Tables(counts.sparkSession, "counts").base

        def run(batches):
            rows = [x for x in batches if len(x)]
            if rows:
                own, name = pd.concat(rows).sort_values(key), uuid.uuid4().hex
                put_longs(base, f"value-{name}", own[value].to_numpy())
                put_longs(base, name, own[key].to_numpy())
                yield pd.DataFrame({"name": [name], "first": own[key].iloc[0], "size": len(own)})

        rows = counts.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(value).cast("long").alias(value))
        with tidy_shuffles(counts.sparkSession):
            told = sorted((r["first"], r["name"], r["size"]) for r in rows.repartitionByRange(key).mapInPandas(run, "name string, first long, size long").collect())  # one row a partition
        self.base, self.names = base, [x[1] for x in told]
        self.places = Places(base, self.names, [x[0] for x in told], [x[2] for x in told])

    def of(self, column: pa.Array) -> np.ndarray:
        """The count of each key, 0 where there is none."""
        keys = column.cast(pa.int64()).fill_null(-1 << 63).to_numpy(zero_copy_only=False)
        out = np.zeros(len(keys), np.int64)
        part = np.searchsorted(self.places.firsts, keys, side="right") - 1
        for k in np.unique(part[part >= 0]).tolist():
            own = np.flatnonzero(part == k)
            ids, values = self.places.part(k), mapped_longs(f"{self.base}/value-{self.names[k]}")
            at = np.minimum(np.searchsorted(ids, keys[own]), len(ids) - 1)
            out[own] = np.where(ids[at] == keys[own], values[at], 0)
        return out


def edge_features(undirected: DataFrame, paths: DataFrame) -> DataFrame:
    """(edge_index, src, dst, weight, pass_count) for every edge. Edges stay where they are: they look up what the paths, which are traced here, count."""
    counts = KeptCounts(edge_pass_counts(paths), "edge_index", "pass_count")
    rows = undirected.select("edge_index", "src", "dst", "weight")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts.of(batch.column(0)))], names=[*batch.schema.names, "pass_count"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("pass_count", LongType())]))


def share(n: int) -> int:
    """A tenth of n rounded up, one at least."""
    return max(1, (n + 9) // 10)


def top_decile(table: DataFrame, key: str, value: str = "pass_count") -> DataFrame:
    """The tenth of the rows with the highest values, ties by ascending key; rows with 0 may be among them.

    Both columns are integers, and keys tell rows apart. The edge of the tenth is found by histograms of values, then of
    the keys that tie there, so no row is sorted or moved.
    """
    rows = kept(table)
    n = rows.count()
    return rows.where(_top(rows, share(n), key, value)) if n else rows


def _top(rows: DataFrame, n: int, key: str, value: str) -> Column:
    """The condition that holds for the n rows with the highest values, ties by ascending key."""
    turned = rows.select(F.col(key).alias("_key"), (-F.col(value)).alias("_value"))
    edge = nth_smallest(turned, "_value", n)
    ties = n - turned.where(F.col("_value") < edge).count()
    last = nth_smallest(turned.where(F.col("_value") == edge), "_key", ties)
    return (F.col(value) > -edge) | ((F.col(value) == -edge) & (F.col(key) <= last))


def sample_negatives(candidates: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n candidates (all, if they are fewer) by a draw on their key."""
    drawn = kept(candidates.withColumn("_d", draw(key, seed)))
    if n >= drawn.count():
        return candidates
    return drawn.where(smallest(drawn, n, "_d", key) if n else F.lit(False)).drop("_d")


def sample_negatives_like_random(candidates: DataFrame, key: str, n: int, rng: random.Random) -> DataFrame:
    """The rows that Python's `rng.sample` takes from the candidates in ascending order of key. The ranks are drawn in a task,
    in one row of draws as the generator has but one; `rng` goes on from where that stopped."""
    rows = numbered(candidates, [F.col(key)], "_rank")
    total = rows.count()
    if n >= total:
        return rows.drop("_rank")
    return rows.join(_ranks_like_random(candidates, rng, total, n), "_rank", "left_semi").drop("_rank")


def _ranks_like_random(rows: DataFrame, rng: random.Random, total: int, n: int) -> DataFrame:
    state = pickle.dumps(rng.getstate())

    def run(batches):
        for _ in batches:
            own = random.Random()
            own.setstate(pickle.loads(state))
            ranks = own.sample(range(total), n)
            for k in range(0, n, 100_000):
                yield pd.DataFrame({"_rank": ranks[k : k + 100_000], "_state": None})
            yield pd.DataFrame({"_rank": [-1], "_state": [pickle.dumps(own.getstate())]})

    told = stable(rows.sparkSession.range(0, 1, 1, 1).mapInPandas(run, "_rank long, _state binary"))
    rng.setstate(pickle.loads(bytes(told.where("_rank < 0").first()["_state"])))
    return told.where("_rank >= 0").select("_rank")


def label(table: DataFrame, key: str, value: str = "pass_count", seed: int = 42, rng: random.Random | None = None) -> DataFrame:
    """All rows with label (1 for the top tenth, else 0) and sample_role (positive, negative, unused); as many negatives as positives.

    Both kinds are conditions on a row's own value, key and draw, so rows stay where they are.
    """
    rows = kept(table)
    total = rows.count()
    if not total:
        return rows.withColumn("label", F.lit(0)).withColumn("sample_role", F.lit("unused"))
    n = share(total)
    positive = _top(rows, n, key, value)
    if rng is not None:
        drawn = sample_negatives_like_random(rows.where(~positive).select(key), key, n, rng)
        rows, negative = rows.join(drawn.withColumn("_negative", F.lit(True)), key, "left"), F.coalesce(F.col("_negative"), F.lit(False))
    else:
        rows = rows.withColumn("_draw", draw(key, seed))
        rest = rows.where(~positive).select("_draw", key)
        negative = smallest(rest, n, "_draw", key) if n < total - n else F.lit(True)
    role = F.when(positive, "positive").when(negative, "negative").otherwise("unused")
    return rows.withColumn("label", F.when(positive, 1).otherwise(0)).withColumn("sample_role", role).select(*table.columns, "label", "sample_role")


def label_by_threshold(table: DataFrame, positive_from: int = 1, negative_to: int = 0, value: str = "pass_count") -> DataFrame:
    """The other rule: positive from a count on, negative up to a count, the rest unused."""
    v = F.col(value)
    role = F.when(v >= positive_from, "positive").when(v <= negative_to, "negative").otherwise("unused")
    return table.withColumn("label", F.when(v >= positive_from, 1).otherwise(0)).withColumn("sample_role", role)


def first_queries(queries: DataFrame, n: int, order: str = "query_id") -> DataFrame:
    """The first n rows in order; a negative n is an error."""
    if n < 0:
        raise ValueError("n must not be negative")
    return queries.orderBy(order).limit(n)
