"""How much the sources of a language differ in the words that they use.

Terms with the same sparse vector of counts by source weigh the same in every comparison. So terms are grouped by that
vector, each pair of sources is compared once for each distinct vector, and the result is multiplied by the number of
its terms; only the terms that rank are looked up again.

p = 1 + floor(10^9 * (count + 2) / (N + 2 V)) is a term's share of a group, f = floor((p - q)^2 / (p + q)) the distance of
two shares. A vector says nothing of the sources where its terms are missing, so f is split up: what two missing terms
give, times all terms; what each source's counts change to that against a missing term (`_margins`); and what two counts
change beyond it (`_pair_sums`, over the entries that vectors have).
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, chunks, tidy

LEAST_DOCUMENTS = 10
TOP = 10
UNIT = 1_000_000_000
#: Terms of a task that are counted before they are handed on.
MOST_HELD = 400_000
#: Sources of a block; pairs are summed for a block against a block.
BLOCK = 64
#: Blocks against blocks of which a task holds the sums.
MOST_SUMS = 512
SALTS = 32

#: Bytes of terms: letters, lower-cased, and all beyond ASCII; the rest become blanks.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The maximal runs of letters and characters beyond ASCII, A-Z lower-cased; a null text has none."""
    return text.encode("utf-8").translate(_TERM_BYTES).split() if text else []


_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("cnt", pa.int64()), ("df", pa.int64())])


def _count_batches(batches):
    """(lang, source, term, cnt, df), summed over many texts of a task before they are handed on."""
    counts: dict[tuple, Counter] = defaultdict(Counter)
    holders: dict[tuple, Counter] = defaultdict(Counter)
    held = 0

    def told():
        for (lang, source), own in counts.items():
            df, n = holders[lang, source], len(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64()), pa.array([df[t] for t in own], pa.int64())], schema=_COUNTED)

    for batch in chunks(batches, "text", 2 << 20):
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            words, own = terms_of(text), counts[lang, source]
            held -= len(own)
            own.update(words)
            held += len(own)
            holders[lang, source].update(set(words))
        if held > MOST_HELD:
            yield from told()
            counts.clear()
            holders.clear()
            held = 0
    yield from told()


def _share(count: str, total: str) -> Column:
    """p of a count in a group; by decimals, as 10^9 times a count may not fit 64 bits."""
    return F.expr(f"1 + (CAST({UNIT} AS DECIMAL(10, 0)) * ({count} + 2)) div greatest({total}, 1L)")


def _distance(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class _Sums:
    """Sums by pair of sources, held for blocks of sources against blocks."""

    def __init__(self):
        self.sums: dict[tuple, np.ndarray] = {}

    def add(self, lang: str, weights: np.ndarray, parts: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Vectors of a language with their numbers of terms; block -> (shares by vector and source, 0 where missing; share of a missing term by source)."""
        for i, (p, p0) in parts.items():
            for j, (q, q0) in parts.items():
                if j < i:
                    continue
                rows = np.flatnonzero((p > 0).any(axis=1) & (q > 0).any(axis=1))
                if not len(rows):
                    continue
                into = self.sums.setdefault((lang, i, j), np.zeros((BLOCK, BLOCK), np.int64))
                for a in np.flatnonzero((p[rows] > 0).any(axis=0)).tolist():
                    own = rows[p[rows, a] > 0]
                    x, y, x0 = p[own, a][:, None], q[own], p0[a]
                    beyond = _far(x, y) - _far(x, q0[None, :]) - _far(x0, y) + _far(x0, q0)[None, :]
                    into[a] += (weights[own][:, None] * np.where(y > 0, beyond, 0)).sum(axis=0)

    def told(self) -> pa.RecordBatch:
        langs, a, b, values = [], [], [], []
        for (lang, i, j), sums in self.sums.items():
            left, right = np.nonzero(sums)
            if i == j:
                left, right = left[left < right], right[left < right]
            langs += [lang] * len(left)
            a.append(left + i * BLOCK)
            b.append(right + j * BLOCK)
            values.append(sums[left, right])
        self.sums = {}
        whole = lambda parts: pa.array(np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), whole(a), whole(b), whole(values)], names=["lang", "a", "b", "value"])


def _pair_batches(batches):
    """What pairs of entries of vectors (lang, m, entries of (idx, p, p0)) change, summed by pair of sources."""
    sums = _Sums()
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        weights = batch.column(1).to_numpy()
        lists = batch.column(2)
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        idx, p, p0 = (f.to_numpy() for f in lists.flatten().flatten())
        for lang in sorted(set(langs)):
            of_lang = np.flatnonzero(langs == lang)
            for at in range(0, len(of_lang), 1024):
                some = of_lang[at : at + 1024]
                place = np.full(batch.num_rows, -1)
                place[some] = np.arange(len(some))
                mine = np.flatnonzero(place[row] >= 0)
                parts = {}
                for block in np.unique(idx[mine] // BLOCK).tolist():
                    e = mine[idx[mine] // BLOCK == block]
                    dense, missing = np.zeros((len(some), BLOCK), np.int64), np.ones(BLOCK, np.int64)
                    dense[place[row[e]], idx[e] % BLOCK] = p[e]
                    missing[idx[e] % BLOCK] = p0[e]
                    parts[block] = (dense, missing)
                sums.add(lang, weights[some], parts)
                if len(sums.sums) > MOST_SUMS:
                    yield sums.told()
    yield sums.told()


def count_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, vec, total): the terms in at least `least` documents of a language, vec their counts by source, in order of sources."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counted = docs.select(text("lang"), text("source"), text("text")).mapInArrow(tidy(_count_batches), "lang string, source string, term string, cnt long, df long")
    # dealt by language and term, counts of a source and vectors of a term are both summed where they are
    by_source = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("cnt").alias("cnt"), F.sum("df").alias("df"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sort_array(F.collect_list(F.struct("source", "cnt"))).alias("vec"), F.sum("cnt").alias("total"))
    return by_term.where(F.col("df") >= least).select("lang", "term", "vec", "total")


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group of lang and source that docs have.

    Part `pair`: each other source of the language, value the sum of f over all kept terms, highest first, all of them.
    Part `term`: the terms that are more frequent in the group than in its whole language, by f, `top` of them.
    Equal values are in order of items' bytes. Null text, lang and source count as empty texts. A group without kept
    terms has pairs (of value 0 where its language keeps no term) and no terms; a language's only source has no pair.
    Repeated rows count as often as they are there, ids are not looked at, an empty table has no rows.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    terms = scratch.write(count_terms(docs, least), "terms")
    vectors = terms.groupBy("lang", "vec", "total").agg(F.count("*").alias("m"), F.min("term").alias("first"))
    vectors = scratch.write(vectors.withColumn("vid", F.monotonically_increasing_id()), "vectors")
    entries = vectors.select("lang", "vid", "m", "first", "total", F.inline("vec"))
    langs = vectors.groupBy("lang").agg(F.sum("m").alias("v"), F.sum(F.col("m") * F.col("total")).alias("n_lang"))
    sums = entries.groupBy("lang", "source").agg(F.sum(F.col("m") * F.col("cnt")).alias("n"))
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    groups = docs.select(own("lang"), own("source")).distinct().join(langs, "lang", "left").join(sums, ["lang", "source"], "left").select("lang", "source", zero("v"), zero("n_lang"), zero("n"))
    groups = groups.withColumn("idx", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")).withColumn("p0", _share("0L", "n + 2 * v"))
    groups = scratch.write(groups, "groups")
    known = entries.join(groups, ["lang", "source"]).withColumn("p", _share("cnt", "n + 2 * v"))
    pairs = _pairs(known, groups)
    pairs = pairs.join(groups.select("lang", "source", F.col("idx").alias("a")), ["lang", "a"]).join(groups.select("lang", F.col("source").alias("item"), F.col("idx").alias("b")), ["lang", "b"])
    told = _ranked(pairs, "pair").unionByName(_ranked(_top_terms(known, vectors, terms, top), "term").where(F.col("rank") <= top))
    return told.select("lang", "source", "part", "item", "value", "rank")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value").withColumn("rank", F.row_number().over(by))


def _pairs(known: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value), both ways."""
    # a language's groups are as many copies, so that no task has all that one language compares
    salted = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("idx").alias("b"), F.col("p0").alias("q0"))
    lowest, highest = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    alone = groups.select("lang", "v", F.col("idx").alias("a"), "p0", (F.col("idx") % SALTS).cast("int").alias("salt")).join(salted, ["lang", "salt"]).where("a < b")
    missing = alone.select("lang", "a", "b", F.expr(f"v * {_distance('p0', 'q0')}").alias("value"))
    margins = known.groupBy("lang", F.col("idx").alias("a"), "p", "p0").agg(F.sum("m").alias("m")).withColumn("salt", F.expr(f"CAST(pmod(hash(a, p), {SALTS}) AS INT)"))
    margins = margins.join(salted, ["lang", "salt"]).where("a <> b").select("lang", lowest, highest, F.expr(f"m * ({_distance('p', 'q0')} - {_distance('p0', 'q0')})").alias("value"))
    vectors = known.groupBy("lang", "vid", "m").agg(F.collect_list(F.struct("idx", "p", "p0")).alias("entries"))
    both = vectors.select("lang", "m", "entries").mapInArrow(tidy(_pair_batches), "lang string, a long, b long, value long")
    total = missing.unionByName(margins).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return total.select("lang", F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))), "value")


def _top_terms(known: DataFrame, vectors: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value): of each group the terms that may rank.

    All terms of a vector have its value, so the `top` vectors by value and then by their first term hold the `top` terms,
    and of each vector its `top` first terms do.
    """
    q = _share("total", "n_lang + 2 * v")
    valued = known.withColumn("q", q).where("p > q").select("lang", "source", "vid", "first", F.expr(_distance("p", "q")).alias("value"))
    by_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "first")
    best = valued.withColumn("r", F.row_number().over(by_group)).where(F.col("r") <= top).select("source", "vid", "value")
    chosen = best.join(vectors.select("vid", "lang", "vec"), "vid")
    by_vector = Window.partitionBy("lang", "vec").orderBy("term")
    named = terms.join(chosen.select("lang", "vec").distinct(), ["lang", "vec"], "left_semi").withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= top)
    return chosen.join(named.select("lang", "vec", F.col("term").alias("item")), ["lang", "vec"]).select("lang", "source", "item", "value")
