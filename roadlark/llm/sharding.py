"""Shards of near equal bytes by sampled splitters.

Keys are drawn with a chance in proportion to their rows' weight, quantiles of the draws become splitters, and rows
are dealt into the ranges between them. Ranges that turn out overfull are drawn from again and subdivided, so a key
that many rows share is cut as well. Ranges are then measured in full, and shards are runs of whole ranges and of the
parts of those that a border falls into. Splitters only decide which task sorts what: the result doesn't depend on them.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, Scratch, tidy

SHARDS = 16
#: Rows of a range, about; a table has no more ranges than its rows over this, or LEAST_RANGES.
ROWS_PER_RANGE = 1_000_000
LEAST_RANGES = 256
#: Draws for each range that is wanted.
DRAWS = 24
#: A range is overfull beyond so many times the weight that it should have.
OVERFULL = 2
MOST_ROUNDS = 12
#: A row with more than its shard's bytes over this is dealt out by itself. There are HEAVY * shards such rows at most.
HEAVY = 64

KEY = ("_id", "_tag", "_salt")


def _ranges_of(keys: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """The number of splitters at or before each key; keys are ordered by all columns in turn."""
    low, high = np.zeros(len(keys[0]), np.int64), np.full(len(keys[0]), len(splitters[0]), np.int64)
    while len(splitters[0]) and (open_ := low < high).any():
        middle = np.minimum((low + high) // 2, len(splitters[0]) - 1)
        after, equal = np.zeros(len(low), bool), np.ones(len(low), bool)
        for key, splitter in zip(keys, splitters):
            s = splitter[middle]
            after |= equal & (key > s)
            equal &= key == s
        right = open_ & (after | equal)
        low = np.where(right, middle + 1, low)
        high = np.where(open_ & ~right, middle, high)
    return low


def _with_ranges(rows: DataFrame, splitters: list[tuple]) -> DataFrame:
    """Rows with `_range`, the place of their key among the splitters."""
    shared = rows.sparkSession.sparkContext.broadcast([np.array([s[k] for s in splitters], np.int64) for k in range(len(KEY))])
    at = [rows.columns.index(k) for k in KEY]

    def run(batches):
        for batch in batches:
            found = _ranges_of([batch.column(k).to_numpy() for k in at], shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "_range"])

    return rows.mapInArrow(tidy(run), rows.select("*", F.lit(0).cast("long").alias("_range")).schema)


def _drawn(rows: DataFrame, total: float, draws: int, seed: int) -> list[tuple]:
    """(key, weight that it stands for) of about `draws` rows, in order of keys: a row is drawn with a chance in proportion to its weight."""
    chance = F.least(F.lit(1.0), F.col("_weight") * F.lit(draws / total))
    found = rows.where(F.rand(seed) < chance).select(*KEY, F.greatest(F.col("_weight"), F.lit(total / draws)).alias("w")).collect()
    return sorted((tuple(r[:3]), r[3]) for r in found)


def _quantiles(drawn: list[tuple], pieces: int) -> list[tuple]:
    """Keys that cut the draws into pieces of equal weight, each once."""
    if not drawn:
        return []
    sums = np.cumsum([w for _, w in drawn])
    places = np.searchsorted(sums, sums[-1] * np.arange(1, pieces) / pieces)
    return sorted({drawn[min(int(p), len(drawn) - 1)][0] for p in places})


def _splitters(rows: DataFrame, total: float, ranges: int, seed: int) -> list[tuple]:
    """Splitters by draws; then, round by round, more of them within ranges that are overfull by the weight of all their rows."""
    found = _quantiles(_drawn(rows, total, DRAWS * ranges, seed), ranges)
    fair = total / ranges
    done: set = set()
    for k in range(MOST_ROUNDS):
        dealt = _with_ranges(rows.select(*KEY, "_weight"), found)
        over = {r[0]: r[1] for r in dealt.groupBy("_range").agg(F.sum("_weight").alias("w"), F.count("*").alias("n")).where(f"n > 1 AND w > {OVERFULL * fair}").collect()}
        bounds = {r: (found[r - 1] if r else None, found[r] if r < len(found) else None) for r in over}
        left = {r: w for r, w in over.items() if bounds[r] not in done}  # a range that draws can't cut further stays
        if not left:
            break
        done |= {bounds[r] for r in left}
        pieces = {r: int(w / fair) + 1 for r, w in left.items()}
        inside = dealt.where(F.col("_range").isin(list(left)))
        drawn = _drawn(inside, sum(left.values()), DRAWS * sum(pieces.values()), seed + 1 + k)
        by_range: dict[int, list] = {}
        for key, w in drawn:
            by_range.setdefault(bisect_right(found, key), []).append((key, w))
        found = sorted({*found, *(s for r, own in by_range.items() if r in pieces for s in _quantiles(own, pieces[r]))})
    return found


def _dealt_alone(heavy: list[tuple[int, int]], shards: int) -> tuple[dict[int, int], list[int]]:
    """The shard of each heavy row, largest first to the shard with the least bytes; and the bytes of the shards."""
    loads = [(0, s) for s in range(shards)]
    out: dict[int, int] = {}
    for row, size in heavy:
        load, s = heapq.heappop(loads)
        out[row] = s
        heapq.heappush(loads, (load + size, s))
    return out, [load for load, _ in sorted(loads, key=lambda x: x[1])]


def _borders(loads: list[int], light: int) -> list[int]:
    """Twice the places in the light bytes at which shards 1, 2, .. begin, so that all shards reach one level where they can."""
    level, n = 0, 0
    for k, load in enumerate(sorted(loads), 1):  # the k lowest shards rise to level / n
        if n and load * n >= level:
            break
        level, n = light + sum(sorted(loads)[:k]), k
    out, filled = [], 0
    for load in loads[:-1]:
        filled += max(0, level - load * n)
        out.append(2 * filled // n)
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", carry: tuple[str, ...] = (), seed: int = 42) -> DataFrame:
    """Each row of docs as (doc_id, size, text_crc32, law, shard, slot, grown_shard), with the columns of `carry` as a struct `row`.

    size is the text's bytes and one more. Rows are in order of `key` (an integer column; null last), then of a hash of
    their text, and a shard is a run of that order; rows with more than a 64th of a shard's bytes are dealt out before,
    largest first. So shards differ by a 64th of their size at most, but for a row that alone is larger than a shard.
    The law is `bytes`; grown_shard is null. A null text counts as empty. Equal keys, equal texts and repeated rows,
    however many, are spread over ranges like others; which of two equal rows comes first is of no matter. An empty table
    has no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]).alias("row")] if carry else []
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_tag"), F.expr(f"CAST(rand({seed}) * 9e18 AS BIGINT)").alias("_salt"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), *kept)
    rows = scratch.write(narrow, "rows")
    told = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    total, count = int(told["b"]), int(told["n"])
    out = ["doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(["row"] if carry else [])]
    if not count:
        return rows.select("*", F.lit(0).alias("shard"), F.lit(0).alias("slot")).select(*out)
    is_heavy = F.col("size") * F.lit(HEAVY * shards) > F.lit(total)
    heavy = sorted((-r[3], r[0], r[1], r[2]) for r in rows.where(is_heavy).select(*KEY, "size").collect())
    alone, loads = _dealt_alone([(k, -h[0]) for k, h in enumerate(heavy)], shards)
    light = rows.where(~is_heavy)
    borders = _borders(loads, total - sum(loads))
    # weight: bytes, and rows at their mean size, so that ranges are bounded in both
    weighed = light.withColumn("_weight", F.col("size") + F.lit(total / count))
    ranges = max(LEAST_RANGES, 4 * shards, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), count // ROWS_PER_RANGE)
    splitters = _splitters(weighed, 2.0 * total, ranges, seed)
    dealt = _with_ranges(light, splitters)
    sums = sorted(tuple(r) for r in dealt.groupBy("_range").agg(F.sum("size"), F.count("*")).collect())
    before, b, n = [], 0, 0
    for r, size, rows_in in sums:
        before.append((r, b, n))
        b, n = b + size, n + rows_in
    offsets = spark.createDataFrame(before, "_range long, _bytes long, _rows long")  # a row for each range
    order = Window.partitionBy("_range").orderBy(*KEY, "size", "text_crc32")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = dealt.withColumn("_upto", upto).withColumn("_at", F.row_number().over(order)).join(F.broadcast(offsets), "_range")
    middle = 2 * (F.col("_bytes") + F.col("_upto")) - F.col("size")
    shard = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in borders]), lambda x: x <= middle)) if borders else F.lit(0)
    placed = scratch.write(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("_rows") + F.col("_at") - 1).alias("_place"), *(["row"] if carry else [])), "placed")
    first = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("_place")).collect()}
    n_heavy = [sum(s == k for s in alone.values()) for k in range(shards)]
    shift = F.array(*[F.lit(n_heavy[s] - first.get(s, 0)).cast("long") for s in range(shards)])
    result = placed.withColumn("slot", F.col("_place") + F.element_at(shift, F.col("shard") + 1)).select(*out)
    if heavy:
        slots: list[tuple] = []
        taken = [0] * shards
        for k, (_, i, tag, salt) in enumerate(heavy):  # at most HEAVY * shards rows
            slots.append((i, tag, salt, alone[k], taken[alone[k]]))
            taken[alone[k]] += 1
        where = spark.createDataFrame(slots, "_id long, _tag long, _salt long, shard int, slot long")
        result = result.unionByName(rows.where(is_heavy).join(F.broadcast(where), list(KEY)).select(*out))
    return result


def write_shards(sharded: DataFrame, path: str, kind: str = "parquet", rows_per_file: int = ROWS_PER_RANGE) -> None:
    """Write what shard_documents returned with `carry` as folders shard=0, shard=1, ..; rows in order of slots, files of so many rows."""
    part = F.floor(F.col("slot") / rows_per_file).alias("part")
    rows = sharded.select("shard", "slot", part, "row.*")
    rows.repartition("shard", "part").sortWithinPartitions("shard", "slot").drop("part").write.partitionBy("shard").format(kind).save(path)
