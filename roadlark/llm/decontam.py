"""Benchmark decontamination: CGK embedding, bit-sampling LSH over windows, exact edit check.

A random walk (Chakraborty, Goldenberg, Koucky 2016) turns edit distance over words into Hamming
distance: at step j the output is the word under the pointer, which moves on if a random bit of
(j, word) says so. Repetitions with walks of their own sample a few output places into a hash key;
windows and items that share a key are compared by exact semi-global edit distance.

The embedding's distortion grows with the number of edits, so a walk over a long item with a fifth of its words edited
leaves little to find. Items are therefore cut into parts that may have one edit at most: of c parts within e edits in all,
one has no more than its own share by the pigeonhole principle. Windows are of the parts' sizes; a part that is found
and that is one edit away at most asks for the check of its whole item there.

Windows start at every word of every text; near its end they are as long as what is left of it, down to the fewest
words that a part may be cut to. One cheap necessary condition comes first: with one edit, one half of the part is
untouched, so a window is looked at where the words of a half stand, at its start or at its end.
"""

from __future__ import annotations

from collections import OrderedDict, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Words, chunks, doc_columns, mix64, tidy

EDGE = b".,;:!?\"'()[]{}<>#*$%&|-_"
LEAST_WORDS = 5
SIMILARITY = 0.8
#: Words of a part, at most, whatever the similarity allows.
PART = 16
#: Repetitions, and output places that each samples.
REPETITIONS, SAMPLES = 10, 3
#: Items of one index, and indexes that a worker holds at once; a larger benchmark is searched index by index.
BLOCK_ITEMS, HELD = 4096, 4
#: Text that a worker keeps while it goes through more indexes than it can hold.
TEXT_HELD = 64 << 20
CHUNK = 3 << 20


def item_words(text: str | None) -> list[bytes]:
    """Lower-case words without the punctuation at their edges; words of punctuation alone go."""
    words = (w.strip(EDGE) for w in (text or "").lower().encode("utf-8", "surrogatepass").split())
    return [w for w in words if w]


def allowed_edits(n: int, similarity: float = SIMILARITY) -> int:
    """Edits that an item of n words may have: 1 - edits / n >= similarity, without rounding trouble."""
    return int((1 - similarity) * n + 1e-9)


def part_words(similarity: float) -> int:
    """The most words that may have one edit."""
    return max(1, max((n for n in range(1, PART + 1) if allowed_edits(n, similarity) <= 1), default=1))


@dataclass
class Part:
    """Words [start, start + size) of an item."""

    item: int
    start: int
    size: int


def parts_of(item: int, n: int, most: int) -> list[Part]:
    """Parts of about as many words, `most` at most."""
    cuts = [n * k // -(-n // most) for k in range(-(-n // most) + 1)]
    return [Part(item, a, b - a) for a, b in zip(cuts, cuts[1:])]


@dataclass
class SizeClass:
    """Parts of about as many words; their windows have `least` words, the fewest of them, and `fewest` at a document's end."""

    least: int
    fewest: int
    parts: list[int]


def size_classes(lengths: list[int], similarity: float) -> list[SizeClass]:
    out: list[SizeClass] = []
    order = sorted(range(len(lengths)), key=lambda i: lengths[i])
    at = 0
    while at < len(order):
        least, stop = lengths[order[at]], at
        while stop < len(order) and lengths[order[stop]] <= max(least, int(least * 1.3)):
            stop += 1
        group, at = order[at:stop], stop
        out.append(SizeClass(least, max(1, least - allowed_edits(least, similarity)), group))
    return out


def walk_bits(repetition: int, symbols: np.ndarray) -> np.ndarray:
    """64 bits of each symbol: bit j says whether the pointer moves at step j. Symbols are vocabulary numbers, -1 for all other words."""
    with np.errstate(over="ignore"):
        return mix64((symbols + 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((repetition + 1) * 1_000_003))


class Embedding:
    """One repetition's walk for windows of `size` words, cut to the sampled places. `bits` are walk_bits() of -1, 0, 1, ..."""

    def __init__(self, size: int, repetition: int, bits: np.ndarray):
        rng = np.random.default_rng([repetition, size])
        # past two steps a word most walks have left the window
        self.size, self.places = size, np.sort(rng.choice(2 * size, min(SAMPLES, 2 * size), replace=False))
        self.bits = bits
        self.salt = np.uint64(mix64(np.array([repetition * 65_537 + size], np.uint64))[0])

    def keys(self, words: np.ndarray, starts: np.ndarray, allowed: list[np.ndarray] | None = None, room: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Windows of `words` at `starts`: which of them go on to the end, and the keys after each sampled place.

        `room` has the words up to the document's end where that may be fewer than `size`; a walk there is beyond the window.
        With `allowed` (the sorted keys that parts have after each place) windows that already differ from all are left.
        """
        at = np.zeros(len(starts), np.int64)
        key = np.full(len(starts), self.salt)
        left = np.arange(len(starts))
        after: list[np.ndarray] = []
        places = set(self.places.tolist())
        last = np.full(len(starts), self.size - 1) if room is None else np.minimum(room, self.size) - 1
        for step in range(int(self.places[-1]) + 1):
            symbol = words[starts + np.minimum(at, last)] + 1
            symbol[at > last] = 0
            if step in places:
                # the walk beyond the window's end is the same for all; an unknown word is like no part's word
                seen = np.where(at > last, 0, symbol + 1).astype(np.uint64)
                key = mix64(key ^ (seen + np.uint64(step << 32)))
                if allowed is not None:
                    table = allowed[len(after)]
                    hit = table[np.minimum(np.searchsorted(table, key), len(table) - 1)] == key
                    at, key, left, starts, symbol, last = at[hit], key[hit], left[hit], starts[hit], symbol[hit], last[hit]
                after.append(key)
                if not len(starts):
                    break
            at = at + (self.bits[symbol] >> np.uint64(step) & np.uint64(1)).astype(np.int64)
        return left, after


class Sieve:
    """Which of many 64-bit numbers are in a small table: a bit map first, then the table."""

    def __init__(self, members: np.ndarray):
        self.members = np.unique(members)
        self.bits = max(16, min(24, 4 + int(len(self.members)).bit_length()))
        self.map = np.zeros(1 << self.bits, bool)
        self.map[self.members >> np.uint64(64 - self.bits)] = True

    def places(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of values that are in the table, and where they are there."""
        maybe = np.flatnonzero(self.map[values >> np.uint64(64 - self.bits)]) if len(self.members) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.members, values[maybe]), max(0, len(self.members) - 1))
        hit = self.members[at] == values[maybe]
        return maybe[hit], at[hit]


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n neighbouring words; fewer than there are words by n - 1."""
    size = max(0, len(words) - n + 1)
    out = np.full(size, np.uint64(n))
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (words[k : k + size] + 2).astype(np.uint64)
    return mix64(out)


def numbers_in(texts: pa.Array, vocabulary: Sieve) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary numbers of the words of all texts one after another as item_words() has them, -1 for all others, and words in each text."""
    told = Words(pc.utf8_lower(texts), EDGE)
    numbers = np.full(len(told.hashes), -1, np.int64)
    at, which = vocabulary.places(told.hashes)
    numbers[at] = which
    return numbers, told.lengths


class ItemIndex:
    """Items as parts: vocabulary, halves, size classes, and LSH tables for each repetition."""

    def __init__(self, items: list[tuple[int, str | None]], similarity: float = SIMILARITY, least_words: int = LEAST_WORDS):
        self.similarity = similarity
        told = Words(pc.utf8_lower(pa.array([t for _, t in items], pa.string())), EDGE)
        self.vocabulary = Sieve(told.hashes)
        numbers = np.searchsorted(self.vocabulary.members, told.hashes)
        ends = np.cumsum(told.lengths)
        kept = [k for k, (i, _) in enumerate(items) if i is not None and told.lengths[k] >= max(1, least_words)]
        self.ids = [items[k][0] for k in kept]
        self.numbers = [numbers[ends[k] - told.lengths[k] : ends[k]] for k in kept]
        most = part_words(similarity)
        self.parts = [p for i, ws in enumerate(self.numbers) for p in parts_of(i, len(ws), most)]
        self.classes = size_classes([p.size for p in self.parts], similarity)
        self.flat = np.concatenate(self.numbers or [np.zeros(0, np.int64)])
        base = np.cumsum([0, *map(len, self.numbers)])
        self.begins = np.array([base[p.item] + p.start for p in self.parts], np.int64)
        self.sizes = np.array([p.size for p in self.parts], np.int64)
        # (size, words in a half, first halves, last halves) of the parts of each class
        self.halves: list[list[tuple[int, int, Sieve, Sieve]]] = []
        for c in self.classes:
            own = []
            for size in np.unique(self.sizes[c.parts]).tolist():
                half = size if allowed_edits(size, similarity) == 0 else max(1, size // 2)
                hashes = grams(self.flat, half)
                a = self.begins[[k for k in c.parts if self.sizes[k] == size]]
                own.append((size, half, Sieve(hashes[a]), Sieve(hashes[a + size - half])))
            self.halves.append(own)
        self.tables = []
        bits = [walk_bits(r, np.arange(-1, len(self.vocabulary.members))) for r in range(REPETITIONS)]
        for n, c in enumerate(self.classes):
            parts = np.array(c.parts)
            for r in range(REPETITIONS):
                walk = Embedding(c.least, r, bits[r])
                after = walk.keys(self.flat, self.begins[parts])[1]
                order = np.argsort(after[-1], kind="stable")
                self.tables.append((n, walk, [np.unique(x) for x in after], after[-1][order], parts[order]))

    def windows(self, n: int, words: np.ndarray, doc_start: np.ndarray, doc_end: np.ndarray, known: dict[int, np.ndarray]) -> np.ndarray:
        """Starts of windows of a class where a half of a part stands at either end, within one word."""
        want = np.zeros(len(words), bool)
        for size, half, first, last in self.halves[n]:
            if half not in known:
                known[half] = grams(words, half)
            want[first.places(known[half])[0]] = True
            behind = last.places(known[half])[0]
            for shift in (-1, 0, 1) if half < size else ():
                start = behind + half - size - shift
                ok = start >= doc_start[behind]
                want[start[ok]] = True
        starts = np.flatnonzero(want)
        return starts[doc_end[starts] - starts >= self.classes[n].fewest]

    def candidates(self, words: np.ndarray, doc_ends: np.ndarray) -> np.ndarray:
        """Rows (window start, part) of windows that share a key with a part and are one edit away from it at most."""
        found: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
        sizes = np.diff(np.concatenate([[0], doc_ends]))
        doc_end, doc_start = np.repeat(doc_ends, sizes), np.repeat(doc_ends - sizes, sizes)
        known: dict[int, np.ndarray] = {}
        starts_of: dict[int, np.ndarray] = {}
        for n, walk, allowed, keys, parts in self.tables:
            if n not in starts_of:
                starts_of[n] = self.windows(n, words, doc_start, doc_end, known)
            starts = starts_of[n]
            if not len(starts):
                continue
            left, after = walk.keys(words, starts, allowed, doc_end[starts] - starts)
            if not len(left):
                continue
            low, high = np.searchsorted(keys, after[-1], "left"), np.searchsorted(keys, after[-1], "right")
            each = high - low
            hits = np.repeat(low - np.cumsum(each) + each, each) + np.arange(each.sum())
            found.append(np.stack([np.repeat(starts[left], each), parts[hits]], 1))
        told = np.unique(np.concatenate(found), axis=0)
        return told[self.one_edit(words, told[:, 0], told[:, 1], doc_end)] if len(told) else told

    def one_edit(self, words: np.ndarray, starts: np.ndarray, parts: np.ndarray, doc_end: np.ndarray) -> np.ndarray:
        """Whether each part stands at its start with one word substituted, left out or put in at most."""
        out = np.zeros(len(starts), bool)
        for k in range(0, len(starts), 50_000):
            a, p = starts[k : k + 50_000], parts[k : k + 50_000]
            size, end, begin = self.sizes[p], doc_end[a], self.begins[p]
            span = np.arange(int(size.max()))
            inside = span < size[:, None]
            own = self.flat[np.minimum(begin[:, None] + span, len(self.flat) - 1)]

            def equal(shift: int) -> np.ndarray:
                at = a[:, None] + span + shift
                ok = (at >= a[:, None]) & (at < end[:, None])
                return ~inside | (ok & (words[np.minimum(np.maximum(at, 0), len(words) - 1)] == own))

            here = equal(0)
            # words before j are equal in place; then those from j + 1 on (or j, where a word was put in) are, at a shift
            before = np.concatenate([np.ones((len(a), 1), bool), np.logical_and.accumulate(here, 1)], 1)
            from_j = lambda e: np.concatenate([np.logical_and.accumulate(e[:, ::-1], 1)[:, ::-1], np.ones((len(a), 1), bool)], 1)
            substituted, left_out = (before[:, :-1] & from_j(e)[:, 1:] for e in (here, equal(-1)))
            put_in = before[:, :-1] & from_j(equal(1))[:, :-1]
            out[k : k + 50_000] = before[:, -1] | (substituted | left_out | put_in).any(1)
        return out


def edit_search(item: list, text: list) -> tuple[int, int]:
    """(least edit distance of the item to a stretch of text, where that stretch ends), by Myers' bit vectors as Python ints."""
    m = len(item)
    where: dict = defaultdict(int)
    for k, w in enumerate(item):
        where[w] |= 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        eq = where.get(w, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = (minus | ~(diag | plus)) & full, plus & diag
        score += 1 if up & top else -1 if down & top else 0
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = (down | ~(diag | up)) & full, up & diag
        if score < best:
            best, end = score, j + 1
    return best, end


def best_stretch(item: list, text: list) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch nearest to the item; the first of as near ones, as long as can be back from its end."""
    distance, end = edit_search(item, text)
    back, length = edit_search(item[::-1], text[:end][::-1])
    return distance, end - length if back == distance else 0, end


def search_documents(texts: list[str | None] | pa.Array, index: ItemIndex) -> list[tuple[int, int, int, int, int]]:
    """(row, item number, start word, end word, edits): the best stretch of each row and item within the bound."""
    flat, lengths = numbers_in(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), index.vocabulary)
    if not len(flat) or not index.tables:
        return []
    ends = np.cumsum(lengths)
    cut = lambda row: flat[ends[row] - lengths[row] : ends[row]]
    at: dict[tuple[int, int], list[int]] = defaultdict(list)
    found = index.candidates(flat, ends)
    rows = np.searchsorted(ends, found[:, 0], side="right")
    for row, start, part in zip(rows.tolist(), found[:, 0].tolist(), found[:, 1].tolist()):
        p = index.parts[part]
        at[row, p.item].append(start - int(ends[row] - lengths[row]) - p.start)
    out = []
    for (row, item), starts in sorted(at.items()):
        words = index.numbers[item].tolist()
        n = len(words)
        slack = allowed_edits(n, index.similarity)
        best, reached = None, -1
        for start in sorted(starts):  # where the item would begin but for edits before the part
            if start + n + slack <= reached:
                continue
            low = max(0, start - slack)
            reached = min(int(lengths[row]), start + n + 2 * slack)
            distance, a, b = best_stretch(words, cut(row)[low:reached].tolist())
            if distance <= slack and (best is None or distance < best[0]):
                best = (distance, low + a, low + b)
        if best:
            out.append((row, item, best[1], best[2], best[0]))
    return out


class ItemBlocks:
    """The benchmark in the shared folder, a bounded number of items a file; what workers and driver hold does not grow with it."""

    def __init__(self, benchmark: DataFrame, similarity: float, least_words: int, size: int):
        from pyarrow import fs, parquet

        self.similarity, self.least_words = similarity, least_words
        self.folder, self.count = Scratch(benchmark.sparkSession, "benchmark").path("items"), 0
        filesystem, base = fs.FileSystem.from_uri(self.folder)
        filesystem.create_dir(base, recursive=True)
        for items in item_blocks(benchmark, size):
            parquet.write_table(pa.table({"id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())}), f"{base}/{self.count}.parquet", filesystem=filesystem)
            self.count += 1
        self.held: OrderedDict[int, ItemIndex] = OrderedDict()

    def index(self, k: int) -> ItemIndex:
        from pyarrow import fs, parquet

        if k not in self.held:
            filesystem, base = fs.FileSystem.from_uri(self.folder)
            table = parquet.read_table(f"{base}/{k}.parquet", filesystem=filesystem)
            if len(self.held) >= HELD:
                self.held.popitem(last=False)
            self.held[k] = ItemIndex(list(zip(*(c.to_pylist() for c in table.columns))), self.similarity, self.least_words)
        return self.held[k]

    def search(self, texts: pa.Array, k: int) -> list[tuple]:
        """(row, item id, words of the item, start, end, edits) of block k."""
        index = self.index(k)
        return [(row, index.ids[i], len(index.numbers[i]), start, end, edits) for row, i, start, end, edits in search_documents(texts, index)]

    def searched(self, batches, column: str, limit: int):
        """(batch, what search finds in it in all blocks). Where workers can't hold all indexes, each is built once for TEXT_HELD bytes of
        text, and blocks are gone through forth and back, so that the last ones are used again."""
        position = lambda batch: batch.column(batch.schema.names.index(column))
        held, size, forth = [], 0, True

        def told():
            found: list[list[tuple]] = [[] for _ in held]
            for k in range(self.count) if forth else reversed(range(self.count)):
                for batch, own in zip(held, found):
                    own += self.search(position(batch), k)
            return list(zip(held, found))

        for batch in chunks(batches, column=column, limit=limit):
            held.append(batch)
            size += batch.nbytes
            if self.count <= HELD or size >= TEXT_HELD:
                yield from told()
                held, size, forth = [], 0, not forth
        yield from told()


def item_blocks(benchmark: DataFrame, size: int):
    """The benchmark, `size` items at a time, in no set order; only one block is on the driver at once."""
    block = []
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, edits, similarity) for each document and item with a stretch within the bound.

    Documents with nothing of the benchmark have no row. Null and empty texts and items with fewer than `least_words` words
    match nothing. Repeated rows are found each for itself. One scan of the documents, however many items there are.
    """
    names = ["doc_id", "item_id", "start_word", "end_word", "edits", "similarity"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    blocks = ItemBlocks(benchmark, similarity, least_words, block_items)

    def run(batches):
        for batch, found in blocks.searched(batches, "text", CHUNK):
            ids = batch.column(0).to_pylist()
            rows = [(ids[r], item, a, b, e, 1 - e / n) for r, item, n, a, b, e in found]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(types)], names=names)

    return doc_columns(docs).mapInArrow(tidy(run), "doc_id long, item_id long, start_word long, end_word long, edits long, similarity double")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The documents without a stretch of the benchmark, all columns as they were.

    Each row is decided by its own text, where it is searched; ids may be null or repeated. Rows with null or empty
    texts stay, an empty table or benchmark drops nothing. A row travels as one column, so that no name clashes.
    """
    blocks = ItemBlocks(benchmark, similarity, least_words, block_items)

    def run(batches):
        for batch, found in blocks.searched(batches, "_text", CHUNK):
            bad = {row for row, *_ in found}
            rows = batch.select(["_row"])
            yield rows.filter(pa.array([r not in bad for r in range(batch.num_rows)])) if bad else rows

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    kept = whole.select("_row", F.col("_row.text").cast("string").alias("_text")).mapInArrow(tidy(run), whole.schema)
    return kept.select("_row.*")
