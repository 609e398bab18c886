"""Ranked search over an inverted index that is cut by documents.

Each shard of the index holds some documents: its terms in order, where their postings begin, and for each posting the
document's place in the shard and its impact, an integer that is computed once, when the index is built. A query goes
through its terms one at a time and adds weight times impact into a dense row of sums, a place for each document of
the shard. The best of a shard are picked out by partition, with all ties at the edge, and merged into the best of a
task; a window merges those of the tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, Scratch, chunks, doc_columns, gathered, tidy

TOP = 50
#: Bytes of text of a shard, about; a longer text is a shard of its own.
SHARD_BYTES = 8 << 20
#: Queries that are sent to tasks at once, and bytes of their texts.
BLOCK_ITEMS, BLOCK_BYTES = 4096, 4 << 20
#: Tasks of a search for each core; each merges the best of its shards before they travel.
TASKS_PER_CORE = 4
#: Fixed values of the score: scale, its unit, what length counts for in percent.
SCALE, UNIT, LENGTH = 1_000_000_000, 1000, 50

#: Bytes of terms: digits, letters, lower-cased, and all beyond ASCII; the rest become blanks.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased; a null text has none."""
    return text.encode("utf-8").translate(_TERM_BYTES).split() if text else []


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """10^9 tf div (1000 tf + 20 m); tf below 2^33 and m below 2^58 keep to 64 bits."""
    return SCALE * tf // (UNIT * tf + 20 * m)


def norms(lengths: Iterable[int], n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents by their numbers of terms; by Python's integers, as length times documents may not fit 64 bits."""
    return np.array([100 - LENGTH + (LENGTH * n * n_docs) // n_terms for n in lengths], np.int64)


def build_shard(ids: list[int | None], texts: list[str | None], n_docs: int, n_terms: int) -> dict:
    """A shard of the documents that have terms; none if there is none."""
    places: dict[bytes, int] = {}
    term_of, tfs, sizes, lengths, kept = [], [], [], [], []
    for i, text in zip(ids, texts):
        words = terms_of(text)
        if not words:
            continue
        counts = Counter(words)
        term_of.append(np.fromiter((places.setdefault(w, len(places)) for w in counts), np.int64, len(counts)))
        tfs.append(np.fromiter(counts.values(), np.int64, len(counts)))
        sizes.append(len(counts))
        lengths.append(len(words))
        kept.append(NO_ID if i is None else i)
    if not kept:
        return {}
    terms, tf, doc = np.concatenate(term_of), np.concatenate(tfs), np.repeat(np.arange(len(kept)), sizes)
    names = sorted(places)
    rank = np.empty(len(names), np.int64)
    rank[[places[w] for w in names]] = np.arange(len(names))
    order = np.argsort(rank[terms], kind="stable")
    df = np.bincount(terms, minlength=len(names))[[places[w] for w in names]]
    found = impacts(tf, norms(lengths, n_docs, n_terms)[doc])[order]
    return {"terms": names, "df": df, "doc_ids": np.array(kept, np.int64), "docs": doc[order].astype(np.int32), "impacts": found.astype(np.int32)}


_SHARD = pa.schema([("terms", pa.list_(pa.string())), ("df", pa.list_(pa.int32())), ("doc_ids", pa.binary()), ("docs", pa.binary()), ("impacts", pa.binary())])


class Index:
    """An index in the shared folder: a table of shards and a table (term, df). n_docs and n_terms are over documents with terms."""

    def __init__(self, shards: DataFrame, vocabulary: DataFrame, n_docs: int, n_terms: int):
        self.shards, self.vocabulary, self.n_docs, self.n_terms = shards, vocabulary, n_docs, n_terms


def _lengths(batches):
    for batch in chunks(batches, "text"):
        n = [len(terms_of(t)) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in n)], pa.int64()), pa.array([sum(n)], pa.int64())], names=["docs", "terms"])


def build_index(docs: DataFrame) -> Index:
    """Index all documents: one pass for the number of documents and terms, one for the shards."""
    told = doc_columns(docs).select("text").mapInArrow(tidy(_lengths), "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    n_docs, n_terms = int(told[0]), int(told[1])

    def run(batches):
        for table in gathered(chunks(batches, "text", SHARD_BYTES), SHARD_BYTES):
            shard = build_shard(*(c.to_pylist() for c in table.columns), n_docs, n_terms)
            if shard:
                terms = pa.ListArray.from_arrays([0, len(shard["terms"])], pa.array(shard["terms"], pa.binary()).cast(pa.string()))
                df = pa.ListArray.from_arrays([0, len(shard["terms"])], pa.array(shard["df"], pa.int32()))
                yield pa.RecordBatch.from_arrays([terms, df, *(pa.array([shard[c].tobytes()], pa.binary()) for c in ("doc_ids", "docs", "impacts"))], schema=_SHARD)

    scratch = Scratch(docs.sparkSession, "index")
    shards = scratch.write(doc_columns(docs).mapInArrow(tidy(run), "terms array<string>, df array<int>, doc_ids binary, docs binary, impacts binary"), "shards", **{"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"})
    pairs = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
    vocabulary = scratch.write(pairs.groupBy("term").agg(F.sum("df").alias("df")), "vocabulary")
    return Index(shards, vocabulary, n_docs, n_terms)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores above 0 and their ids, equal scores by ascending id; a partition, then a sort of what is left and its ties."""
    some = np.flatnonzero(scores > 0)
    if len(some) > k:
        edge = np.partition(scores[some], len(some) - k)[len(some) - k]
        some = some[scores[some] >= edge]
    some = some[np.lexsort((ids[some], -scores[some]))][:k]
    return scores[some], ids[some]


class Block:
    """Some queries as arrays: the distinct terms of all with their weights, and which of them each query asks for."""

    def __init__(self, numbers: list[int], texts: list[str], df: dict[str, int], n_docs: int):
        asked = [sorted({w for w in terms_of(t)}) for t in texts]
        self.numbers = numbers
        self.terms = sorted({w for words in asked for w in words if w.decode("utf-8") in df})
        place = {w: k for k, w in enumerate(self.terms)}
        self.weights = np.array([weight(df[w.decode("utf-8")], n_docs) for w in self.terms], np.int64)
        self.asked = [[place[w] for w in words if w in place] for words in asked]

    def search(self, terms: list[bytes], df: np.ndarray, doc_ids: np.ndarray, docs: np.ndarray, impact: np.ndarray, k: int, floors: list[int]):
        """(query's place, scores, ids) of a shard; scores below a query's floor are left out."""
        ends = np.cumsum(df)
        place = {w: i for i, w in enumerate(terms)}
        postings = []
        for w, weight in zip(self.terms, self.weights):
            i = place.get(w)
            postings.append(None if i is None else (docs[ends[i] - df[i] : ends[i]], weight * impact[ends[i] - df[i] : ends[i]].astype(np.int64)))
        sums = np.zeros(len(doc_ids), np.int64)
        for q, asked in enumerate(self.asked):
            here = [postings[t] for t in asked if postings[t] is not None]
            if not here:
                continue
            sums[:] = 0
            for at, add in here:
                sums[at] += add
            if sums.max() >= max(1, floors[q]):
                yield q, *best_of(sums, doc_ids, k)


def search(index: Index, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): for each query (item_id, text) its k best documents with a score above 0, ties by ascending id.

    Queries go to tasks in blocks of a bounded size, against all shards. Each distinct (item_id, text) is answered once;
    one without terms has no rows. A null doc_id ranks behind others of its score; repeated documents rank each. Documents
    without terms are never found. Empty tables give no rows.
    """
    spark = queries.sparkSession
    scratch = Scratch(spark, "search")
    asked = queries.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    asked = scratch.write(asked.withColumn("number", F.monotonically_increasing_id()), "queries")
    schema = "number long, doc_id long, score long"
    found = spark.createDataFrame([], schema)
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    for numbers, texts in _blocks(asked):
        block = _block(index, numbers, texts)
        if not block.terms:
            continue
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            own = shared.value
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            floors = [0] * len(own.numbers)
            for batch in batches:
                for row in range(batch.num_rows):
                    words = batch.column(0)[row].values.cast(pa.binary()).to_pylist()
                    df = batch.column(1)[row].values.to_numpy().astype(np.int64)
                    ids, docs, impact = (np.frombuffer(batch.column(c)[row].as_buffer(), kind) for c, kind in ((2, np.int64), (3, np.int32), (4, np.int32)))
                    for q, scores, names in own.search(words, df, ids, docs, impact, k, floors):
                        if q in best:
                            scores, names = best_of(np.concatenate([best[q][0], scores]), np.concatenate([best[q][1], names]), k)
                        best[q] = scores, names
                        floors[q] = int(scores[-1]) if len(scores) == k else 0
            for q, (scores, names) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), own.numbers[q])), pa.array(names), pa.array(scores)], names=["number", "doc_id", "score"])

        part = index.shards.coalesce(tasks).mapInArrow(tidy(run), schema)
        found = found.unionByName(scratch.write(_first(part, k).drop("rank"), "best"))
    told = _first(found, k).join(asked.select("number", "item_id"), "number")
    return told.select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def _first(rows: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("number").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _blocks(asked: DataFrame):
    """(numbers, texts) of queries, of a bounded size; the driver holds one block at a time."""
    numbers, texts, size = [], [], 0
    for row in asked.select("number", "text").toLocalIterator():
        numbers.append(row[0])
        texts.append(row[1])
        size += len(row[1])
        if len(numbers) == BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield numbers, texts
            numbers, texts, size = [], [], 0
    if numbers:
        yield numbers, texts


def _block(index: Index, numbers: list[int], texts: list[str]) -> Block:
    """A block with the weights of its terms, looked up in the index's vocabulary."""
    words = sorted({w.decode("utf-8") for t in texts for w in terms_of(t)})
    spark = index.shards.sparkSession
    found = index.vocabulary.join(F.broadcast(spark.createDataFrame([(w,) for w in words], "term string")), "term").collect() if words else []  # bounded by the block
    return Block(numbers, texts, {r["term"]: int(r["df"]) for r in found}, index.n_docs)


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """Index all documents, then search for all queries."""
    return search(build_index(docs), queries, k)
