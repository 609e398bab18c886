"""Removal of repeated byte strings by a suffix sort.

A byte goes if it lies in a string of `length` bytes that also starts earlier: in a document with a smaller
id, or earlier in the same one. Every window of that length picks the least-hashed gram of GRAM bytes in it
(winnowing), so equal windows pick equal grams at equal places, and only windows of the same gram can be
equal. Neighbouring windows with the same pick form a run, and runs rather than windows travel:

1. Runs meet by their gram. A run whose whole context (all bytes of its windows) was seen earlier is
   marked at once. Grams with a single context need nothing more.
2. For grams with several contexts the first of each is fetched. The windows of one gram at one place in it
   are sorted as suffixes, word by word of eight bytes, and only among suffixes that agree in all words before.
   Neighbours that agree in `length` bytes by hash are held against each other byte by byte, and if a collision
   shows, those bytes alone decide.
3. Marks meet by document and are cut out of its text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, NO_ID, Scratch, chunks, collect_garbage, identified, mix64, powers, starts_of_runs, tidy, whole_groups

LENGTH = 100
GRAM = 32
#: Bytes that are hashed at once, and the longest stretch of one text; bound a worker's memory.
CHUNK = 2 << 20
STRETCH = 2 << 20
#: Windows that are sorted at once, about.
SORTED = 60_000
class PrefixHashes:
    """Hashes of any stretch of a byte string in constant time: a polynomial modulo 2^64, freed of the stretch's place."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=self.sums[1:])
        self.back = powers(pow(BASE, -1, 1 << 64), n + 1)

    def of(self, start: np.ndarray, count) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[start + count] - self.sums[start]) * self.back[start]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values, by doubling."""
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[: len(out) - (width - span)], out[width - span :])
    return out


def find_runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray] | None:
    """Runs of windows with the same pick in texts that lie one after another and end at `ends`.

    first: a run's first window; count: its windows; pick: where its gram starts; gram, context: hashes.
    """
    n = len(data)
    if n < length:
        return None
    hashes = PrefixHashes(data)
    grams = hashes.of(np.arange(n - gram + 1), gram)
    order = (mix64(grams) >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    picks = (sliding_least(order, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    room = ends - starts - length + 1
    windows = np.concatenate([np.arange(s, s + r) for s, r in zip(starts[room > 0], room[room > 0])]) if (room > 0).any() else np.zeros(0, np.int64)
    if not len(windows):
        return None
    pick = picks[windows]
    cut = np.ones(len(windows) + 1, bool)
    cut[1:-1] = (pick[1:] != pick[:-1]) | (windows[1:] != windows[:-1] + 1)
    at = np.flatnonzero(cut)
    first, count = windows[at[:-1]], np.diff(at)
    pick = pick[at[:-1]]
    # a hash of another kind, so that what collides in the one does not in the other
    view = memoryview(data)
    ends_at = first + count + length - 1
    context = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), ends_at.tolist())), np.uint64, len(first))
    return {"first": first, "count": count, "pick": pick, "gram": grams[pick], "context": context}


def _bytes_of(values: list) -> list[bytes]:
    return [v.encode("utf-8", "surrogatepass") if v else b"" for v in values]


def _run_batches(length: int):
    """Rows (gram, context, doc_id, tag, place): a chunk's runs. Of runs with equal contexts the earliest goes on;
    later ones are marks already and have count 0 less than nothing: -count."""

    def run(batches):
        for batch in chunks(batches, limit=CHUNK):
            ids, tags, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), _bytes_of(batch.column(2).to_pylist())
            told = [((i, s), t) for i, s, t in zip(ids, tags, texts) if len(t) >= length]
            for part in _parts(told, length):
                yield from _rows_of(part, length)

    return run


def _parts(told: list[tuple[tuple[int, int], bytes]], length: int):
    """Texts by the chunk; a text too long for one hash table is cut into overlapping stretches (offset, bytes)."""
    held, size = [], 0
    for doc_id, text in told:
        if len(text) > STRETCH:
            for at in range(0, len(text) - length + 1, STRETCH - length + 1):
                yield [(doc_id, at, text[at : at + STRETCH])]
            continue
        if size + len(text) > CHUNK and held:
            yield held
            held, size = [], 0
        held.append((doc_id, 0, text))
        size += len(text)
    if held:
        yield held


def _rows_of(part: list[tuple[tuple[int, int], int, bytes]], length: int):
    data = np.frombuffer(b"".join(t for _, _, t in part), np.uint8)
    ends = np.cumsum([len(t) for _, _, t in part])
    found = find_runs(data, ends, length)
    if found is None:
        return
    row = np.searchsorted(ends, found["first"], side="right")
    base = ends[row] - np.array([len(t) for _, _, t in part], np.int64)[row] - np.array([at for _, at, _ in part], np.int64)[row]
    docs, tags = (np.array([x[0][k] for x in part], np.int64)[row] for k in (0, 1))
    back = found["pick"] - found["first"]
    first = found["first"] - base
    order = np.lexsort((first, tags, docs, found["context"], found["gram"]))
    gram, context, count = found["gram"][order], found["context"][order], found["count"][order]
    docs, tags, first, back = docs[order], tags[order], first[order], back[order]
    runs = starts_of_runs(gram, context)
    lead = np.repeat(runs[:-1], np.diff(runs))
    later = (docs != docs[lead]) | (tags != tags[lead]) | (first != first[lead])
    count = np.where(later, -count, count)
    # marks need no company: any key that deals them out evenly will do
    gram = np.where(later, mix64((docs ^ tags).view(np.uint64) + first.view(np.uint64)), gram)
    for k in range(0, len(gram), 50_000):
        s = slice(k, k + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(gram[s].view(np.int64)), pa.array(context[s].view(np.int64)), pa.array(docs[s]), pa.array(tags[s]), pa.array(_packed(first[s], count[s], back[s]))], names=["gram", "context", "doc_id", "tag", "place"])


def _packed(first: np.ndarray, count: np.ndarray, back: np.ndarray) -> np.ndarray:
    """first < 2^45, |count| < 2^9 and back < 2^8 in one long."""
    return (first << 18) | ((count < 0).astype(np.int64) << 17) | (np.abs(count) << 8) | back


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = (place >> 8) & 0x1FF
    return place >> 18, np.where((place >> 17) & 1 == 1, -size, size), place & 0xFF


_MARKS = "gram long, doc_id long, tag long, first long, count int, back int, sure boolean"


def _meet(batches):
    """Runs of a gram together: later ones of equal contexts are sure marks; the first of several contexts is asked for."""
    for table in whole_groups(batches, ("gram",)):
        gram, context, docs, tags, place = (table.column(c).to_numpy() for c in ("gram", "context", "doc_id", "tag", "place"))
        first, count, back = _unpacked(place)
        marks = np.flatnonzero(count < 0)
        at = np.flatnonzero(count > 0)
        at = at[np.lexsort((first[at], tags[at], docs[at], context[at], gram[at]))]
        runs = starts_of_runs(gram[at], context[at])
        lead = at[runs[:-1]] if len(at) else at
        leads = np.repeat(lead, np.diff(runs)) if len(at) else at
        later = at[(docs[at] != docs[leads]) | (tags[at] != tags[leads]) | (first[at] != first[leads])]
        kinds = starts_of_runs(gram[lead])
        asked = lead[np.repeat(np.diff(kinds) > 1, np.diff(kinds))] if len(lead) else lead
        for rows, sure in ((np.concatenate([marks, later]), True), (asked, False)):
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(gram[rows]), pa.array(docs[rows]), pa.array(tags[rows]), pa.array(first[rows]), pa.array(np.abs(count[rows]).astype(np.int32)), pa.array(back[rows].astype(np.int32)), pa.array(np.full(len(rows), sure))], names=["gram", "doc_id", "tag", "first", "count", "back", "sure"])


def _fetch(length: int):
    """The contexts that are asked for, out of the whole texts."""

    def run(batches):
        for batch in chunks(batches, limit=CHUNK):
            out: list[list] = [[] for _ in range(7)]
            for doc_id, tag, text, asked in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode("utf-8", "surrogatepass")
                for a in asked:
                    at = a["first"]
                    for column, x in zip(out, (a["gram"], doc_id, tag, at, a["count"], a["back"], data[at : at + a["count"] + length - 1])):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["gram", "doc_id", "tag", "first", "count", "back", "context"])

    return run


class SuffixOrder:
    """Order of suffixes of `data`, cut to `length` bytes, within groups."""

    def __init__(self, data: np.ndarray, length: int = LENGTH):
        self.data, self.length = data, length
        self.hashes = PrefixHashes(data)
        self.words = np.ndarray(len(data) + 1, ">u8", np.append(data, np.zeros(8, np.uint8)), 0, (1,))

    def word(self, suffixes: np.ndarray, k: int) -> np.ndarray:
        """The eight bytes from place k on of each suffix as a number that sorts as they do; zeros behind `length`."""
        told = self.words[suffixes + k].astype(np.uint64)
        beyond = max(0, k + 8 - self.length)
        return told >> np.uint64(8 * beyond) << np.uint64(8 * beyond)

    def sort(self, suffixes: np.ndarray, group_ends: np.ndarray) -> np.ndarray:
        """Suffixes with each group in order; groups lie one after another, equal suffixes stay as they came.

        By words of eight bytes, from the first on: each sorts anew what agreed in all words before. Suffixes that no other
        agrees with go, and where all of a class agree nothing is sorted, so the cost grows with the suffixes and not with
        the size of a group.
        """
        out = suffixes.copy()
        starts = np.concatenate([[0], group_ends[:-1]])
        sizes = group_ends - starts
        for k in range(0, self.length, 8):
            more = sizes > 1
            starts, sizes = starts[more], sizes[more]
            if not len(starts):
                break
            begin = np.cumsum(sizes) - sizes
            live = np.repeat(starts - begin, sizes) + np.arange(begin[-1] + sizes[-1])
            word = self.word(out[live], k)
            mixed = np.repeat(np.minimum.reduceat(word, begin) != np.maximum.reduceat(word, begin), sizes)
            if not mixed.any():
                continue
            owner = np.repeat(np.arange(len(begin)), sizes)
            at = np.flatnonzero(mixed)
            order = at[np.lexsort((word[at], owner[at]))]
            out[live[at]], word[at] = out[live[order]], word[order]
            cut = starts_of_runs(owner, word)
            starts, sizes = live[cut[:-1]], np.diff(cut)
        return out

    def classes(self, ordered: np.ndarray, group_ends: np.ndarray) -> np.ndarray:
        """Class numbers of sorted suffixes: neighbours of one group with `length` common bytes, checked byte by byte."""
        n = len(ordered)
        new = np.ones(n, bool)
        if n > 1:
            a, b = ordered[:-1], ordered[1:]
            same = self.hashes.of(a, self.length) == self.hashes.of(b, self.length)
            same[group_ends[:-1] - 1] = False
            at = np.flatnonzero(same)
            for k in range(0, len(at), 50_000):
                s = at[k : k + 50_000]
                span = np.arange(self.length)
                equal = (self.data[a[s][:, None] + span] == self.data[b[s][:, None] + span]).all(1)
                same[s] = equal
            new[1:] = ~same
        return np.cumsum(new) - 1


def _decide(length: int):
    """Marks among the windows of grams with several contexts: all of a class but its first."""

    def run(batches):
        for table in whole_groups(batches, ("gram",), limit=2 << 20):
            gram, docs, tags, first = (table.column(c).to_numpy() for c in ("gram", "doc_id", "tag", "first"))
            once = starts_of_runs(gram, docs, tags, first)[:-1]  # rows that repeat an id bring their runs again
            if len(once) < len(gram):
                table, gram, docs, tags, first = table.take(pa.array(once)), gram[once], docs[once], tags[once], first[once]
            count, back = (table.column(c).to_numpy() for c in ("count", "back"))
            contexts = table.column("context").to_pylist()
            data = np.frombuffer(b"".join(contexts), np.uint8)
            base = np.cumsum([0, *map(len, contexts)])[:-1]
            count = count.astype(np.int64)
            run_of = np.repeat(np.arange(len(count)), count)
            step = np.arange(len(run_of)) - np.repeat(np.cumsum(count) - count, count)
            group_key = np.unique(gram, return_inverse=True)[1][run_of] * 512 + (back[run_of] - step)
            order = np.argsort(group_key, kind="stable")  # runs came by place, and so do their windows at one place of the gram
            run_of, step, group_key = run_of[order], step[order], group_key[order]
            runs = starts_of_runs(group_key)
            alone = np.repeat(np.diff(runs) == 1, np.diff(runs))
            run_of, step, group_key = run_of[~alone], step[~alone], group_key[~alone]
            if not len(run_of):
                continue
            where = base[run_of] + step
            marked = np.zeros(len(where), bool)
            for part in _bounded(starts_of_runs(group_key), SORTED):
                ends = part[1:] - part[0]
                window = where[part[0] : part[-1]]
                touched, local = _compact(data, window, length)
                sorter = SuffixOrder(touched, length)
                by_rank = sorter.sort(local, ends)
                # equal suffixes are stable: the earliest of a class comes first, as groups went in by place
                classes = sorter.classes(by_rank, ends)
                at = np.argsort(local, kind="stable")
                source = at[np.searchsorted(local[at], by_rank)]
                lead = np.unique(classes, return_index=True)[1]
                later = np.ones(len(window), bool)
                later[lead] = False
                marked[part[0] + source[later]] = True
            runs_marked, steps = run_of[marked], step[marked]
            order = np.lexsort((steps, runs_marked))
            runs_marked, steps = runs_marked[order], steps[order]
            if not len(order):
                continue
            cut = np.ones(len(order), bool)
            cut[1:] = (runs_marked[1:] != runs_marked[:-1]) | (steps[1:] != steps[:-1] + 1)
            at = np.flatnonzero(cut)
            lengths = np.diff(np.append(at, len(order)))
            r = runs_marked[at]
            yield pa.RecordBatch.from_arrays([pa.array(docs[r]), pa.array(tags[r]), pa.array(first[r] + steps[at]), pa.array(lengths.astype(np.int32))], names=["doc_id", "tag", "first", "count"])

    return run


def _compact(data: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Just the bytes under the windows, and the windows' places in them; every window stays in one piece."""
    covered = np.zeros(len(data) + 1, np.int32)
    np.add.at(covered, windows, 1)
    np.add.at(covered, windows + length, -1)
    keep = np.cumsum(covered[:-1]) > 0
    return data[keep], (np.cumsum(keep) - 1)[windows]


def _bounded(runs: np.ndarray, most: int):
    """Boundaries of groups, some whole groups at a time."""
    a = 0
    while a < len(runs) - 1:
        b = max(a + 1, int(np.searchsorted(runs, runs[a] + most, side="right")) - 1)
        yield runs[a : b + 1]
        a = b


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, tag, first, count): `count` neighbouring windows from byte `first` on that start earlier as well, in rows as
    common.identified() knows them; runs may overlap.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    plain = identified(docs)
    runs = plain.mapInArrow(tidy(_run_batches(length)), "gram long, context long, doc_id long, tag long, place long")
    met = scratch.write(runs.repartition(F.col("gram")).sortWithinPartitions("gram").mapInArrow(tidy(_meet), _MARKS), "met")
    del runs
    collect_garbage(spark)
    asked = met.where("NOT sure").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("gram", "first", "count", "back")).alias("asked"))
    fetched = plain.where("text IS NOT NULL").join(asked.hint("shuffle_hash"), ["doc_id", "tag"]).select("doc_id", "tag", "text", "asked").mapInArrow(tidy(_fetch(length)), "gram long, doc_id long, tag long, first long, count int, back int, context binary")
    decided = fetched.repartition(F.col("gram")).sortWithinPartitions("gram", "doc_id", "tag", "first").mapInArrow(tidy(_decide(length)), "doc_id long, tag long, first long, count int")
    more = scratch.write(decided, "decided")
    del fetched, decided, asked
    collect_garbage(spark)
    return met.where("sure").select("doc_id", "tag", "first", "count").unionByName(more)


def _cut(length: int):
    def run(batches):
        for batch in chunks(batches, limit=CHUNK):
            out: list[list] = [[] for _ in range(5)]
            for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode("utf-8", "surrogatepass") if text else b""
                kept, removed, starts = _kept(data, spans, length)
                for column, x in zip(out, (doc_id, len(data), removed, starts, kept)):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return run


def _kept(data: bytes, spans: list | None, length: int) -> tuple[bytes, int, list[dict]]:
    """What is left, bytes taken away, and the maximal stretches taken away."""
    if not spans or not data:
        return data, 0, []
    first = np.array([s["first"] for s in spans], np.int64)
    last = np.minimum(first + np.array([s["count"] for s in spans], np.int64) + length - 1, len(data))
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    cut = np.ones(len(first), bool)
    cut[1:] = first[1:] > reach[:-1]
    at = np.flatnonzero(cut)
    starts, ends = first[at], reach[np.append(at[1:], len(first)) - 1]
    keep, here = [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        keep.append(data[here:a])
        here = b
    keep.append(data[here:])
    kept = b"".join(keep)
    return kept, len(data) - len(kept), [{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist())]


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, spans (maximal removed stretches of bytes), kept (bytes left).

    Null and empty texts have 0 bytes. Rows that repeat id and text are one document: what is found in one goes from all;
    different texts of one id are documents of their own. Rows without an id come behind all others.
    Matches never reach over documents.
    """
    marks = repeated_spans(docs, length).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "count")).alias("marks"))
    rows = identified(docs).join(marks.hint("shuffle_hash"), ["doc_id", "tag"], "left")
    return rows.select(F.nullif(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"), "text", "marks").mapInArrow(tidy(_cut(length)), "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")

