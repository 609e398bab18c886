"""Language-model scores by a weighted backoff automaton, trained on and applied to the whole corpus.

States are the n-grams (n < ORDER) seen in training, the start of a text among them. With h a state, h' the state
without h's first word, and c counts in training, the arcs are

    arc      h -w->  log10 p(w | h),  p(w | h) = (c(h w) + mu p(w | h')) / (c(h) + mu)     where c(h w) > 0
    failure  h ----> h'  log10(mu / (c(h) + mu))                                           where no arc has the word
    root     w           log10 p(w),  p(w) = (c(w) + a) / (N + a (V + 1))

which are the probabilities of a Dirichlet-smoothed n-gram model (MacKay and Peto 1995) and sum to one. A text is
read once from left to right: each word takes the arc of the present state, or failure arcs down to a state that has
one, and leads to the longest n-gram seen that ends there. What the walk needs is, at each word, how often the
n-grams that end there were seen; a state's own count is that of the n-gram that ended one word before.

Counts are found without a table of all n-grams in one place. A chunk of texts deals the distinct hashes of its
n-grams out to shards by range of hash, each shard sums the chunks' training counts and returns one count for each
hash that it was asked for, and nothing else. Orders go up: an n-gram is asked for only where both of its (n-1)-grams
occur elsewhere too, in training or not; where not, it occurs just here.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Words, chunks, doc_columns, gathered, mix64, tidy

#: Fixed values of the base score: what is added to a count, and the word that ends a text (no word has a line feed).
ADD, END = 0.1, b"\n"
MU = 8.0
ORDER = 3
FOLDS = 10
#: Tasks that read chunks, at most.
MOST_TASKS = 50_000
#: Hashes that a shard is asked for, about, and text of a chunk; they bound the memory of a task.
SHARD_GRAMS = 500_000
CHUNK = 5 << 20
GOLD = np.uint64(0x9E3779B97F4A7C15)
END_HASH = np.uint64(xxhash.xxh3_64_intdigest(END))


class BackoffAutomaton:
    """The same automaton in memory, walked word by word; for small corpora and as the measure of the distributed one."""

    def __init__(self, texts: list[list[bytes]], order: int = ORDER, mu: float = MU):
        self.order, self.mu = order, mu
        self.seen: Counter[tuple[bytes, ...]] = Counter()
        for t in texts:
            told = [END, *t, END]
            for k in range(1, len(told)):
                for n in range(1, min(order, k + 1) + 1):
                    self.seen[tuple(told[k + 1 - n : k + 1])] += 1
        self.counts = {g[0]: n for g, n in self.seen.items() if len(g) == 1}
        self.total, self.distinct = sum(self.counts.values()), len(self.counts)

    def root(self, word: bytes) -> float:
        return (self.counts.get(word, 0) + ADD) / (self.total + ADD * (self.distinct + 1))

    def arc(self, state: tuple[bytes, ...], word: bytes) -> float | None:
        """Probability of the arc, if the state has one for the word."""
        if not state:
            return self.root(word)
        below = self.arc(state[1:], word)
        if below is None or not (seen := self.seen[(*state, word)]):
            return None
        return (seen + self.mu * below) / (self.seen[state] + self.mu)

    def failure(self, state: tuple[bytes, ...]) -> float:
        return math.log10(self.mu / (self.seen[state] + self.mu))

    def step(self, state: tuple[bytes, ...], word: bytes) -> tuple[tuple[bytes, ...], float]:
        """The next state, and the weight of the arcs that lead to it."""
        here, weight = state, 0.0
        while (p := self.arc(here, word)) is None:
            weight += self.failure(here)
            here = here[1:]
        after = (*state, word)[-(self.order - 1) :] if self.order > 1 else ()
        while after and not self.seen[after]:
            after = after[1:]
        return after, weight + math.log10(p)

    def start(self) -> tuple[bytes, ...]:
        return (END,) if self.order > 1 and self.seen[(END,)] else ()

    def score(self, words: list[bytes]) -> float:
        state, total = self.start(), 0.0
        for w in [*words, END]:
            state, weight = self.step(state, w)
            total += weight
        return total


def is_held_out(doc_id: int | None) -> bool:
    """A null id counts as the text 'None'."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


class Chunk:
    """Texts of one chunk as numbers of words, frequent words first; written as one file and read again in each round."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, held: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, tokens: np.ndarray):
        self.ids, self.known, self.held, self.lengths, self.hashes, self.tokens = ids, known, held, lengths, hashes, tokens

    KINDS = ("<i8", "u1", "u1", "<i8", "<u8", "<u4")

    @classmethod
    def of(cls, table: pa.Table) -> Chunk:
        """Words of each text in lower case, and then END."""
        ids = table.column(0).to_pylist()
        told = Words(pc.ascii_lower(table.column(1).combine_chunks()))
        lengths = told.lengths
        hashes, numbers, counts = np.unique(told.hashes, return_inverse=True, return_counts=True)
        by_count = np.argsort(-counts, kind="stable")
        hashes, numbers = hashes[by_count], np.argsort(by_count)[numbers]
        ends = np.cumsum(lengths + 1) - 1
        tokens = np.full(len(numbers) + len(lengths), len(hashes), np.uint32)
        inner = np.ones(len(tokens), bool)
        inner[ends] = False
        tokens[inner] = numbers
        return cls(np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids], np.uint8), np.array([is_held_out(i) for i in ids], np.uint8), lengths + 1, np.append(hashes, END_HASH), tokens)

    def packed(self) -> bytes:
        parts = [np.ascontiguousarray(x, k) for x, k in zip((self.ids, self.known, self.held, self.lengths, self.hashes, self.tokens), self.KINDS)]
        return b"".join(planes(p) for p in parts)

    @classmethod
    def unpacked(cls, blob: bytes) -> Chunk:
        at, out = 0, []
        for kind in cls.KINDS:
            values, at = read_planes(blob, kind, at)
            out.append(values)
        return cls(*out)

    def grams(self, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For n = 1 .. order: hashes of the n-grams that end at each token, and whether there is one (the start counts as a word)."""
        words = self.hashes[self.tokens]
        starts = np.cumsum(self.lengths) - self.lengths
        place = np.arange(len(words)) - np.repeat(starts, self.lengths)
        out = [(words, np.ones(len(words), bool))]
        for n in range(2, order + 1):
            history = np.roll(out[-1][0], 1)
            if n == 2:
                history[starts] = END_HASH
            with np.errstate(over="ignore"):
                out.append((mix64(history * GOLD + words), place + 2 >= n))
        return out

    def train(self) -> np.ndarray:
        return np.repeat(self.held == 0, self.lengths)


class Asked:
    """The distinct n-grams of a chunk that shards are asked for, in order of hash, and where each token's is.

    Counts are pairs of arrays: of training texts, and of all texts.
    """

    def __init__(self, chunk: Chunk, counts: list[tuple[np.ndarray, np.ndarray]], n: int):
        hashes, there = chunk.grams(n)[n - 1]
        self.there, self.train = there, chunk.train()
        if n > 2:
            # an n-gram occurs no more often than either of its (n-1)-grams does
            every = counts[n - 2][1]
            there = there & (every > 1) & (np.roll(every, 1) > 1)
        self.mask = there
        self.hashes, self.place = np.unique(hashes[there], return_inverse=True)

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.bincount(self.place, w, len(self.hashes)).astype(np.int64) for w in (self.train[self.mask], None))

    def spread(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of each token's n-gram; one that nobody was asked for occurs here alone."""
        out = np.where(self.there & self.train, 1, 0), np.where(self.there, 1, 0)
        for own, told in zip(out, found):
            own[self.mask] = told[self.place]
        return out


def narrow(values: np.ndarray) -> bytes:
    """Numbers in as few bytes as the greatest needs, compressed; the first byte says how many, the next eight how long they are."""
    most = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    raw = values.astype(f"<u{width}").tobytes()
    return bytes([width]) + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte - first bytes of all, second bytes of all, and so on - compressed, behind both lengths."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()
    packed = pa.compress(raw, codec="zstd", asbytes=True)
    return np.array([len(values), len(packed)], "<i8").tobytes() + packed


def read_planes(blob: bytes, kind: str, at: int = 0) -> tuple[np.ndarray, int]:
    """The numbers written at a place, and where they end."""
    n, size = np.frombuffer(blob, "<i8", 2, at).tolist()
    width = np.dtype(kind).itemsize
    raw = pa.decompress(blob[at + 16 : at + 16 + size], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).reshape(n), at + 16 + size


def ascending(hashes: np.ndarray) -> bytes:
    """Hashes in ascending order, by their steps."""
    return planes(np.diff(hashes, prepend=np.uint64(0)))


def read_ascending(blob: bytes) -> tuple[np.ndarray, int]:
    steps, at = read_planes(blob, "<u8")
    return np.cumsum(steps, dtype=np.uint64), at


def both(counts: tuple[np.ndarray, np.ndarray]) -> bytes:
    return narrow(np.concatenate(counts))


def halves(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    told = widened(blob)
    return told[: len(told) // 2], told[len(told) // 2 :]


def widened(blob: bytes) -> np.ndarray:
    raw = pa.decompress(blob[9:], decompressed_size=int.from_bytes(blob[1:9], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(raw, f"<u{blob[0]}").astype(np.int64)


SHARDED = "shard long, chunk long, n int, blob binary"
RETURNED = "chunk long, n int, shard long, blob binary, tokens long, kinds long"


def _texts(folder: str):
    def run(batches):
        """Each chunk goes to a file of its own in the shared folder; a task that runs again writes others, and the manifest has the ones that count."""
        filesystem, base = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(base, recursive=True)
        for table in gathered(chunks(batches, limit=CHUNK), CHUNK):
            chunk, number = Chunk.of(table), uuid.uuid4().int >> 65
            with filesystem.open_output_stream(f"{base}/{number}.chunk") as out:
                out.write(chunk.packed())
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(chunk.tokens)], pa.int64())], names=["chunk", "tokens"])

    return run


def _opened(folder: str, number: int) -> Chunk:
    filesystem, base = fs.FileSystem.from_uri(folder)
    with filesystem.open_input_stream(f"{base}/{number}.chunk") as source:
        return Chunk.unpacked(source.read())


def _gathered_counts(chunk: Chunk, rows: list[tuple[int, int, bytes]], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts at each token for n = 1 .. order, as shards have returned them."""
    counts: list[tuple[np.ndarray, np.ndarray]] = []
    for n in range(1, order + 1):
        found = [halves(b) for k, _, b in sorted(((s, k, b) for k, s, b in rows if k == n))]
        none = [np.zeros(0, np.int64)]
        counts.append(Asked(chunk, counts, n).spread(tuple(np.concatenate([f[k] for f in found] or none) for k in (0, 1))))
    return counts


def _told(table) -> list[tuple[int, int, bytes]]:
    return list(zip(*(table.column(c).to_pylist() for c in ("n", "shard", "blob"))))


def _ask(folder: str, shards: int, orders: tuple[int, ...]):
    """Rows for the shards: hashes in order, and their training counts in the chunk."""

    def batch(number: int, chunk: Chunk, rows) -> pa.RecordBatch:
        counts = _gathered_counts(chunk, rows, orders[0] - 1)
        out: list[list] = [[], [], [], []]
        for n in orders:
            asked = Asked(chunk, counts, n)
            own = asked.own()
            cuts = np.searchsorted((asked.hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1, dtype=np.uint64))
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[s], cuts[s + 1])
                for column, x in zip(out, (s, number, n, ascending(asked.hashes[part]) + both(tuple(x[part] for x in own)))):
                    column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["shard", "chunk", "n", "blob"])

    def mapped(batches):
        for b in batches:
            for number in b.column(0).to_pylist():
                yield batch(number, _opened(folder, number), [])

    def grouped(key, table):
        number = key[0].as_py()
        return pa.Table.from_batches([batch(number, _opened(folder, number), _told(table))])

    return mapped, grouped


def _count(key, table):
    """One shard: sums over chunks, one count returned for each hash that a chunk asked for; and its tokens and kinds."""
    out: list[list] = [[] for _ in range(6)]
    ns = table.column("n").to_numpy()
    chunk_of, blobs = table.column("chunk").to_pylist(), table.column("blob")
    for n in np.unique(ns).tolist():
        rows = np.flatnonzero(ns == n).tolist()
        hashes, own = [], []
        for r in rows:
            blob = blobs[r].as_py()
            told, at = read_ascending(blob)
            hashes.append(told)
            own.append(halves(blob[at:]))
        flat = np.concatenate(hashes)
        kinds, place = np.unique(flat, return_inverse=True)
        total, every = (np.bincount(place, np.concatenate([o[k] for o in own]), len(kinds)).astype(np.int64) for k in (0, 1))
        at = 0
        for k, (r, h) in enumerate(zip(rows, hashes)):
            first = k == 0
            values = (chunk_of[r], n, key[0].as_py(), both(tuple(x[place[at : at + len(h)]] for x in (total, every))), int(total.sum()) if first else 0, int((total > 0).sum()) if first else 0)
            for column, x in zip(out, values):
                column.append(x)
            at += len(h)
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    return pa.table({name: pa.array(c, t) for name, c, t in zip(("chunk", "n", "shard", "blob", "tokens", "kinds"), out, kinds)})


class Arcs:
    """The arcs and failure arcs that a chunk's texts may take: at each token, for a state of n words, whether it has an arc for
    the token (it leads to n + 1 words), the arc's weight, and that of the failure arc to n - 1 words.

    counts[n][t] says how often the n + 1 words that end at token t were seen; a state's own count is that of its words.
    """

    def __init__(self, counts: list[np.ndarray], lengths: np.ndarray, total: int, distinct: int, starts_seen: int, mu: float):
        first = np.cumsum(lengths) - lengths
        self.start, self.order = 1 if starts_seen else 0, len(counts)
        probability = (counts[0] + ADD) / (total + ADD * (distinct + 1))
        self.seen, self.weight, self.failure = [counts[0] > 0], [np.log10(probability)], [np.zeros(len(probability))]
        for n in range(1, self.order):
            state = np.roll(counts[n - 1], 1)
            state[first] = starts_seen if n == 1 else 0
            probability = (counts[n] + mu * probability) / (state + mu)
            self.seen.append(counts[n] > 0)
            self.weight.append(np.log10(probability))
            self.failure.append(math.log10(mu) - np.log10(state + mu))

    def scores(self, lengths: np.ndarray) -> list[float]:
        """One walk over each text from left to right: the state goes from token to token, weights add up."""
        out, longest = [], self.order - 1
        ends = np.cumsum(lengths)
        for a, b in _stretches(ends, WALKED):
            low, high = int(ends[a - 1]) if a else 0, int(ends[b - 1])
            seen, weight, failure = ([x[low:high].tolist() for x in parts] for parts in (self.seen, self.weight, self.failure))
            at = 0
            for size in lengths[a:b].tolist():
                n, score = self.start, 0.0
                for t in range(at, at + size):
                    while n and not seen[n][t]:  # no arc: back off
                        score += failure[n][t]
                        n -= 1
                    score += weight[n][t]
                    if n or seen[0][t]:  # a word never seen leads to the root
                        n = n + 1 if n < longest else longest
                at += size
                out.append(score)
        return out


#: Tokens whose arcs are lists at once, about.
WALKED = 100_000


def _stretches(ends: np.ndarray, most: int):
    """Runs of whole texts (from, to) with at most so many tokens, or one text."""
    a = 0
    while a < len(ends):
        base = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield a, b
        a = b


def _walked(folder: str, order: int, total: int, distinct: int, starts_seen: int, mu: float):
    rest = math.log10(total + ADD * (distinct + 1))

    def run(key, table):
        chunk = _opened(folder, key[0].as_py())
        counts = [train for train, _ in _gathered_counts(chunk, _told(table), order)]
        starts = np.cumsum(chunk.lengths) - chunk.lengths
        known = np.add.reduceat((counts[0] > 0).astype(np.int64), starts)
        base = np.add.reduceat(np.log10(counts[0] + ADD), starts) - chunk.lengths * rest
        score = Arcs(counts, chunk.lengths, total, distinct, starts_seen, mu).scores(chunk.lengths)
        return pa.table({"doc_id": pa.array(chunk.ids, mask=chunk.known == 0), "held_out": pa.array(chunk.held == 1), "n_tokens": pa.array(chunk.lengths), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(starts), total, np.int64)), "base_score": pa.array(base), "score": pa.array(score)})

    return run


def score_documents(docs: DataFrame, mu: float = MU, order: int = ORDER) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    A null or empty text is the end token alone. Repeated rows are trained on and scored each for itself.
    With no training tokens at all every count is 0. An empty table has no rows.
    """
    if order < 2:
        raise ValueError("the order is to be 2 at least")
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    folder = scratch.path("chunks")
    texts = scratch.write(doc_columns(docs).mapInArrow(tidy(_texts(folder)), "chunk long, tokens long"), "texts")
    parts, size = texts.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    shards = max(8, -(-size // SHARD_GRAMS))
    told: list[DataFrame] = []
    for orders in ((1, 2), *((n,) for n in range(3, order + 1))):
        mapped, grouped = _ask(folder, shards, orders)
        # a manifest is small whatever its chunks are: by number, so that each chunk is a task's
        first = texts.select("chunk").repartition(max(1, min(parts, MOST_TASKS))).mapInArrow(tidy(mapped), SHARDED)
        asked = _together(told).groupBy("chunk").applyInArrow(grouped, SHARDED) if told else first
        told.append(scratch.write(asked.groupBy("shard").applyInArrow(_count, RETURNED), f"counts{orders[0]}"))
    total, distinct = told[0].where("n = 1").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    starts_seen = _training_texts(docs)
    return _together(told).groupBy("chunk").applyInArrow(_walked(folder, order, total, distinct, starts_seen, mu), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _together(told: list[DataFrame]) -> DataFrame:
    out = told[0].select("chunk", "n", "shard", "blob")
    for t in told[1:]:
        out = out.unionByName(t.select("chunk", "n", "shard", "blob"))
    return out


def _training_texts(docs: DataFrame) -> int:
    """How often the start of a text was seen in training: as often as its end."""
    doc_id = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("None"))
    return docs.where(F.crc32(doc_id.cast("binary")) % FOLDS != 0).count()
