"""Sharding, source divergence and ranked search against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlark.llm import divergence, search, sharding
from roadlark.llm.common import Scratch
from roadlark.llm.queries import QUERIES

from .conftest import SCHEMA, sentence

FOLDER = "/root/testdata/sf0.001"

# Sharding


def slow_shards(rows, shards):
    """(doc_id, size, crc, shard, slot) by one sort, for rows (doc_id, text) with distinct ids."""
    own = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows]
    total = sum(s for _, s, _ in own)
    heavy = sorted((r for r in own if r[1] * 64 * shards > total), key=lambda r: (-r[1], r[0]))
    loads, out, taken = [0] * shards, [], [0] * shards
    for i, size, crc in heavy:
        k = loads.index(min(loads))
        out.append((i, size, crc, k, taken[k]))
        loads[k] += size
        taken[k] += 1
    light = sorted(set(own) - set(heavy))
    left = sum(r[1] for r in light)
    level = min((left + sum(sorted(loads)[:k])) / k for k in range(1, shards + 1))  # as high as the lowest k shards get, for the best k
    ends = np.cumsum([max(0.0, level - x) for x in loads])
    at = 0
    for i, size, crc in light:
        k = int(np.searchsorted(ends[:-1] - 1e-9, at + size / 2, side="right"))
        out.append((i, size, crc, k, taken[k]))
        taken[k] += 1
        at += size
    return sorted(out)


def check_slots(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_shards_by_one_sort(docs, corpus, crowded, shards):
    got = sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard_documents(crowded, shards).collect())
    assert got == slow_shards(corpus, shards)


def test_op11_rows(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op11_sharding"](spark, FOLDER).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rows) == slow_shards([tuple(r) for r in table], 16)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_shards_of_hot_keys(spark, monkeypatch):
    """A third without an id, a third under one id, equal texts among both: all rows, in near equal shards, ranges bounded."""
    monkeypatch.setattr(sharding, "LEAST_RANGES", 64)
    rng = random.Random(5)
    texts = [sentence(rng, rng.randint(3, 30)) for _ in range(300)]
    rows = [(None, texts[k % 3]) for k in range(2000)] + [(7, texts[k % 300]) for k in range(2000)] + [(k, rng.choice(texts)) for k in range(2000)]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(5)
    got = sharding.shard_documents(table).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t) + 1, zlib.crc32(t.encode())) for i, t in rows)
    check_slots(got)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= max(r.size for r in got)
    keyed = table.select(F.coalesce("doc_id", F.lit(sharding.NO_ID)).alias("_id"), F.xxhash64("text").alias("_tag"), F.expr("CAST(rand(3) * 9e18 AS BIGINT)").alias("_salt"), F.lit(1.0).alias("_weight"))
    keyed = Scratch(spark, "test").write(keyed, "keys")
    splitters = sharding._splitters(keyed, 6000.0, 64, 1)
    in_range = [r["count"] for r in sharding._with_ranges(keyed, splitters).groupBy("_range").count().collect()]
    assert sum(in_range) == 6000 and max(in_range) <= sharding.OVERFULL * 6000 / 64 + 1


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    """Draws so few that the first splitters are bad: further rounds bring every range below the bound."""
    monkeypatch.setattr(sharding, "DRAWS", 2)
    rows = spark.range(0, 5000, 1, 4).select(F.least("id", F.lit(2500)).alias("_id"), F.xxhash64("id").alias("_tag"), F.col("id").alias("_salt"), F.lit(1.0).alias("_weight"))
    splitters = sharding._splitters(rows, 5000.0, 50, 3)
    sizes = [r["count"] for r in sharding._with_ranges(rows, splitters).groupBy("_range").count().collect()]
    assert sum(sizes) == 5000 and max(sizes) <= sharding.OVERFULL * 100


def test_ranges_are_those_of_bisect():
    from bisect import bisect_right

    rng = random.Random(2)
    keys = [(rng.randint(0, 4), rng.randint(0, 4), rng.randint(0, 9)) for _ in range(2000)]
    splitters = sorted(set(rng.sample(keys, 60)))
    found = sharding._ranges_of([np.array([k[c] for k in keys], np.int64) for c in range(3)], [np.array([s[c] for s in splitters], np.int64) for c in range(3)])
    assert found.tolist() == [bisect_right(splitters, k) for k in keys]
    assert sharding._ranges_of([np.array([1])] * 3, [np.array([], np.int64)] * 3).tolist() == [0]


def test_shards_of_odd_tables(spark, nothing, repeated, tmp_path):
    assert sharding.shard_documents(nothing).count() == 0
    rows = sharding.shard_documents(repeated).collect()
    assert len(rows) == repeated.count() and sum(r.doc_id is None for r in rows) == 1
    check_slots(rows)
    longest = spark.createDataFrame([(1, "x" * 200_000, "en", "s", 0), (2, None, None, None, None), (3, "", "", "", 0)], SCHEMA)
    got = {r.doc_id: r for r in sharding.shard_documents(longest, 4).collect()}
    assert got[1].size == 200_001 and (got[2].size, got[2].text_crc32) == (1, 0) and got[1].shard not in (got[2].shard, got[3].shard)
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 5, SCHEMA)
    check_slots(sharding.shard_documents(nulls, 2).collect())


def test_written_shards(spark, docs, corpus, tmp_path):
    sharded = sharding.shard_documents(docs, 4, carry=("doc_id", "text"))
    sharding.write_shards(sharded, f"{tmp_path}/out", rows_per_file=10)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in back.collect()) == Counter((r.row.doc_id, r.row.text, r.shard, r.slot) for r in sharded.collect())


# Divergence


def slow_divergence(rows, least=10, top=10):
    """Rows (lang, source, text) compared source by source and term by term."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(g, s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower))) for g, s, t in rows]
    out = []
    for lang in {g for g, _, _ in found}:
        df = Counter(w for g, _, ws in found if g == lang for w in set(ws))
        kept = sorted(w for w, n in df.items() if n >= least)
        counts = defaultdict(Counter)
        for g, s, ws in found:
            if g == lang:
                counts[s].update(w for w in ws if w in set(kept))
        whole = sum(counts.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pair = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in counts if o != s]
            term = [(f(p[s][w], q[w]), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, values, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(values, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


def told(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r.rank) for r in df.collect())


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(3)
    common = [sentence(rng, 1) for _ in range(40)]
    own = {s: [sentence(rng, 1) for _ in range(15)] for s in range(9)}
    rows = []
    for k in range(260):
        s = 0 if k % 3 == 0 else rng.randint(1, 8)  # one source holds a third
        words = rng.choices(common, k=rng.randint(0, 60)) + rng.choices(own[s], k=rng.randint(0, 30))
        rng.shuffle(words)
        rows.append((rng.choice(["en", "en", "de", None]), None if s == 5 else f"s{s}", ["Éa ", "x9y-Z", ""][k % 3] + " ".join(words)))
    return [*rows, ("en", "empty", None), ("fr", "few", "only this"), ("fr", "other", ""), (None, "s1", "A a A"), ("en", "Z", "e" * 5000), *[rows[0]] * 12]


@pytest.mark.parametrize("block", [64, 3])
def test_divergence_by_brute_force(spark, mixed, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "MOST_HELD", 50)
    table = spark.createDataFrame([(k, t, g, s, 0) for k, (g, s, t) in enumerate(mixed)], SCHEMA).repartition(3)
    assert told(divergence.source_divergence(table.withColumn("value", F.lit("own")).withColumn("p", F.lit(1)))) == slow_divergence(mixed)


def test_divergence_sums_in_tasks_with_small_blocks(mixed):
    """The sums of pairs by array operations against single values, in blocks of three sources."""
    rng = np.random.default_rng(1)
    p0 = rng.integers(1, 10**6, 7)
    vectors = [{int(s): int(rng.integers(1, 10**9)) for s in rng.choice(7, rng.integers(1, 7), replace=False)} for _ in range(50)]
    m = rng.integers(1, 9, 50)
    f = lambda a, b: (a - b) ** 2 // (a + b)
    expected = Counter()
    for v, n in zip(vectors, m.tolist()):
        for a in v:
            for b in v:
                if a < b:
                    expected[a, b] += n * (f(v[a], v[b]) - f(v[a], int(p0[b])) - f(int(p0[a]), v[b]) + f(int(p0[a]), int(p0[b])))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 50), pa.array(m), pa.array([[{"idx": s, "p": x, "p0": int(p0[s])} for s, x in v.items()] for v in vectors], pa.list_(pa.struct([("idx", pa.int64()), ("p", pa.int64()), ("p0", pa.int64())])))], names=["lang", "m", "entries"])
    for size, held in ((3, 512), (3, 1), (64, 512)):
        old = divergence.BLOCK, divergence.MOST_SUMS
        divergence.BLOCK, divergence.MOST_SUMS = size, held
        try:
            got = Counter()
            for out in divergence._pair_batches([batch]):
                for _, a, b, value in zip(*(c.to_pylist() for c in out.columns)):
                    got[a, b] += value
        finally:
            divergence.BLOCK, divergence.MOST_SUMS = old
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in expected.items() if v}


def test_divergence_of_odd_tables(spark, nothing, docs, repeated):
    assert divergence.source_divergence(nothing).count() == 0
    one = told(divergence.source_divergence(docs))  # a single source: no pairs, no term above its language
    assert one == slow_divergence([(r.lang, r.source, r.text) for r in docs.collect()])
    assert told(divergence.source_divergence(repeated)) == slow_divergence([(r.lang, r.source, r.text) for r in repeated.collect()])


# Search


def slow_search(rows, items, k=50):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
    own = [(i, Counter(terms(t))) for i, t in rows]
    own = [(i, c) for i, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(w for _, c in own for w in c)
    out = []
    for item, text in sorted({(i, t or "") for i, t in items}):
        scores = []
        for i, c in own:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if w in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=lambda r: (r[0], r[1], r[3], r[2] or 0))


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=lambda r: (r[0], r[1], r[3], r[2] or 0))


@pytest.fixture(scope="module")
def items(corpus):
    rng = random.Random(8)
    texts = [t for _, t in corpus if t and len(t) > 40]
    out = [(k, " ".join(rng.choices(rng.choice(texts).split(), k=12)).upper() if k % 2 else rng.choice(texts)[:300]) for k in range(12)]
    return [*out, (90, None), (91, ""), (92, "unheardof ?!"), (93, "again again"), (1, "again x"), (93, "again again")]


@pytest.mark.parametrize("size", [8 << 20, 3000])
def test_search_by_brute_force(spark, corpus, crowded, items, monkeypatch, size):
    monkeypatch.setattr(search, "SHARD_BYTES", size)
    monkeypatch.setattr(search, "BLOCK_ITEMS", 5 if size < 10_000 else 4096)
    queries = spark.createDataFrame(items, "item_id long, text string").withColumn("number", F.lit("own"))
    assert found(search.rank_documents(crowded, queries)) == slow_search(corpus, items)


def test_search_ties_repeats_and_nothing(spark, docs, nothing, repeated, items):
    queries = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k % 40, "same words here" if k % 5 else "other words") for k in range(300)] + [(None, "same words")] * 3
    ties = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(4)
    asked = [(1, "same words"), (2, "other"), (3, "here same same")]
    assert found(search.rank_documents(ties, spark.createDataFrame(asked, "item_id long, text string"))) == slow_search(rows, asked)
    assert search.rank_documents(nothing, queries).count() == 0
    assert search.rank_documents(docs, queries.limit(0)).count() == 0
    every = [(r.doc_id, r.text) for r in repeated.collect()]
    assert found(search.rank_documents(repeated, queries)) == slow_search(every, items)


def test_best_of_keeps_all_ties():
    rng = random.Random(4)
    for _ in range(200):
        n, k = rng.randint(1, 30), rng.randint(1, 8)
        scores, ids = np.array([rng.randint(0, 4) for _ in range(n)]), np.array(rng.sample(range(100), n))
        expected = sorted(((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if s > 0))[:k]
        got = search.best_of(scores, ids, k)
        assert [(-s, i) for s, i in zip(got[0].tolist(), got[1].tolist())] == expected
