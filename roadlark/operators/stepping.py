"""Distances on graphs that no executor can hold: delta-stepping over files, and searches from both ends on top of it.

Distances are cut into buckets of width delta. A round settles one bucket: it reads only the offers that fall into it,
drops those whose node was settled shortly before, follows edges that stay inside the bucket until nothing improves, and
then appends the settled rows to one file set and what they offer to later buckets to others. Nothing that is settled is
written again: an offer is written once and read once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stable import Tables, small_broadcasts, stable

#: Width of a bucket, in mean weights over the mean number of neighbours: about the distance that a frontier grows by when
#: each of its nodes settles so many others. Wider buckets take fewer rounds, but steps in them that are corrected later.
DELTA_MEANS = 4.0
MOST_ROUNDS = 1_000_000
#: Bytes of a partition up to which what a step adds is hashed to meet the graph.
HASHED = 64 << 20


def _label() -> Column:
    return F.struct("distance", "hops")


def _least(rows: DataFrame) -> DataFrame:
    """(src, node, distance, hops): the nearest of each, then the one with the fewest edges."""
    return rows.groupBy("src", "node").agg(F.min(_label()).alias("l")).select("src", "node", "l.distance", "l.hops")


def _next(rows: DataFrame, adj: DataFrame) -> DataFrame:
    """What rows offer to their neighbours."""
    return rows.join(adj.where("node <> nbr"), "node").select("src", F.col("nbr").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"), (F.col("hops") + 1).alias("hops"))


class Stepping:
    """Rounds over rows (src, node, distance, hops), src of any type; `seeds` have distance and hops of where a search starts."""

    def __init__(self, adj: DataFrame, seeds: DataFrame, delta: float | None = None):
        by_node = adj.groupBy("node").agg(F.count("*").alias("n"), F.sum("weight").alias("s"), F.max("weight").alias("most"), F.min("weight").alias("least"))
        told = by_node.agg(F.sum("s") / F.sum("n"), F.max("most"), F.min("least"), F.avg("n")).first()
        if told[2] is not None and told[2] < 0:
            raise ValueError("weights must not be negative")
        self.adj, self.spark = adj, adj.sparkSession
        self.delta = float(delta or DELTA_MEANS * (told[0] or 0) / (told[3] or 1) or 1.0)
        #: Buckets back to which the node of an offer may have been settled: its distance is at most two edges less.
        self.reach = math.ceil(2 * (told[1] or 0) / self.delta) + 1
        self.tables = Tables(self.spark, "stepping")
        self.schema = seeds.select("src", "node", "distance", "hops").schema
        self.pending: dict[int, list[str]] = {}
        self.settled: dict[int, str] = {}
        self._offer(seeds)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _offer(self, rows: DataFrame) -> None:
        path = self.tables.path("offers")
        rows.select(*self.schema.names, F.floor(F.col("distance") / F.lit(self.delta)).alias("bucket")).write.partitionBy("bucket").parquet(path)
        for name in self.tables.listed(path):
            if name.startswith("bucket="):
                self.pending.setdefault(int(name.removeprefix("bucket=")), []).append(f"{path}/{name}")

    def waiting(self) -> DataFrame:
        """All offers that no round has read."""
        return self._read([p for paths in self.pending.values() for p in paths])

    def all(self) -> DataFrame:
        """All rows that are settled."""
        return self._read(list(self.settled.values()))

    def round(self, active: DataFrame | None = None) -> tuple[DataFrame, float] | None:
        """Settle the next bucket that has offers; its rows, and the distance below which all is settled. None if no offer is left.

        With `active` (src) only those searches go on; offers of others are dropped unread.
        """
        if not self.pending:
            return None
        with small_broadcasts(self.spark, HASHED):
            return self._round(active)

    def _round(self, active: DataFrame | None) -> tuple[DataFrame, float]:
        k = min(self.pending)
        end = (k + 1) * self.delta
        offers = self._read(self.pending.pop(k))
        if active is not None:
            offers = offers.join(active, "src", "left_semi")
        recent = self._read([p for b, p in self.settled.items() if b >= k - self.reach]).select("src", "node")
        levels = [stable(_least(offers).join(recent, ["src", "node"], "left_anti"))]
        inside = self.adj.where(F.col("weight") < F.lit(self.delta))
        while not levels[-1].isEmpty():
            step = _least(_next(levels[-1], inside).where(F.col("distance") < F.lit(end)))
            known = _least(_union(levels)).select("src", "node", _label().alias("l"))
            better = step.join(known, ["src", "node"], "left").where(F.col("l").isNull() | (_label() < F.col("l"))).drop("l")
            levels.append(stable(better.join(recent, ["src", "node"], "left_anti")))
        path = self.tables.path(f"settled-{k}")
        _least(_union(levels)).write.parquet(path)
        new = self._read([path])
        self.settled[k] = path
        self._offer(_least(_next(new, self.adj).where(F.col("distance") >= F.lit(end))))
        return new, end


def _union(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def distances(adj: DataFrame, seeds: DataFrame, delta: float | None = None) -> DataFrame:
    """(src, node, distance, hops) of all nodes that each search reaches."""
    search = Stepping(adj, seeds, delta)
    for _ in range(MOST_ROUNDS):
        if search.round() is None:
            return search.all()
    raise RuntimeError(f"not settled after {MOST_ROUNDS} rounds")


PAIR = ("origin", "destination")


def _side(side: int) -> Column:
    return F.struct(*PAIR, F.lit(side).alias("side")).alias("src")


class BothEnds:
    """Shortest paths of pairs (origin, destination) by two frontiers each, all in tables.

    `best` holds the shortest meeting of each pair so far. When all nodes within r of both ends are settled and the best
    meeting is shorter than 2 r, no other can be as short, and the pair retires; so does one of whose sides nothing is
    left. `lengths` are the meetings of all pairs that are connected.
    """

    def __init__(self, adj: DataFrame, pairs: DataFrame, delta: float | None = None):
        self.adj, self.pairs = adj, stable(pairs.select(*PAIR).distinct().where("origin <> destination"))
        start = lambda side, c: self.pairs.select(_side(side), F.col(c).alias("node"), F.lit(0.0).alias("distance"), F.lit(0).cast("long").alias("hops"))
        self.search = Stepping(adj, start(0, "origin").unionByName(start(1, "destination")), delta)
        self.lengths = self._run()

    def _run(self) -> DataFrame:
        best = stable(self.pairs.select(*PAIR, F.lit(None).cast("double").alias("best")))
        active = None
        while (done := self.search.round(active)) is not None:
            new, radius = done
            best = stable(self._meetings(best, new))
            going = best.where(F.col("best").isNull() | (F.col("best") >= F.lit(2 * radius))).select(*PAIR)
            alive = self.search.waiting().select("src").distinct().groupBy("src.origin", "src.destination").count().where("count = 2").select(*PAIR)
            active = stable(going.join(alive, list(PAIR), "left_semi")).select(F.explode(F.array(_side(0), _side(1))).alias("src"))
            if active.isEmpty():
                break
        return best.where("best IS NOT NULL").withColumnRenamed("best", "length")

    def _meetings(self, best: DataFrame, new: DataFrame) -> DataFrame:
        """best after a round: what the new rows and their edges reach of the other side."""
        tips = new.unionByName(_next(new, self.adj)).select(F.struct("src.origin", "src.destination", (1 - F.col("src.side")).alias("side")).alias("src"), "node", F.col("distance").alias("d"))
        met = tips.join(self.search.all().select("src", "node", "distance"), ["src", "node"]).groupBy("src.origin", "src.destination").agg(F.min(F.col("d") + F.col("distance")).alias("met"))
        return best.join(met, list(PAIR), "left").select(*PAIR, F.least("best", "met").alias("best"))

    def forward(self) -> DataFrame:
        """(origin, destination, node, distance, hops) from the origin: exact for every node of a shortest path.

        The origin's search goes on from where it stood, but only over nodes that the other search has settled and
        that leave room for the length.
        """
        mine = self.search.all().where("src.side = 0").select(*(F.col(f"src.{c}").alias(c) for c in PAIR), "node", "distance", "hops").join(self.lengths, list(PAIR)).where(F.col("distance") <= F.col("length") * (1 + 1e-12))
        theirs = stable(self.search.all().where("src.side = 1").select(*(F.col(f"src.{c}").alias(c) for c in PAIR), "node", F.col("distance").alias("rest")).join(self.lengths, list(PAIR)))
        levels = [stable(mine.select(F.struct(*PAIR).alias("src"), "node", "distance", "hops"))]
        room = theirs.select(F.struct(*PAIR).alias("src"), "node", "rest", "length")
        while not levels[-1].isEmpty():
            step = _least(_next(levels[-1], self.adj))
            near = step.join(room, ["src", "node"]).where(F.col("distance") + F.col("rest") <= F.col("length") * (1 + 1e-12)).select("src", "node", "distance", "hops")
            known = _least(_union(levels)).select("src", "node", _label().alias("l"))
            levels.append(stable(near.join(known, ["src", "node"], "left").where(F.col("l").isNull() | (_label() < F.col("l"))).drop("l")))
        return stable(_least(_union(levels)).select("src.origin", "src.destination", "node", "distance", "hops"))
