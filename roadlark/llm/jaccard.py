"""Exact Jaccard self-join of documents by their word n-grams, with vertical partitioning.

Sets are of 64-bit hashes of n-grams in one global order: grams that are frequent somewhere last, others by
hash. Equal sets are one from the start. The join goes in three steps that never emit all pairs of a group:

1. Prefix filter: sets that can be linked share a gram among the first n - ceil(t n) + 1 of each. Sets of
   one such gram are joined loosely where the fragment sizes allow a link: with the order cut into BUCKETS
   fragments, an overlap is at most the sum of the lesser sizes. A traversal emits a spanning forest.
2. Vertical partitioning: the order is cut into FRAGMENTS; tasks of a loose group, a fragment and a block count
   partial overlaps separately. In groups of more than CROWD sets this is done first with PIVOTS of them alone, which
   is linear: summed, it links most near copies to pivots, and sets linked through pivots have the same label.
3. Left are pairs of different labels. Distances 1 - J obey the triangle inequality, so a pair whose distances to any
   pivot differ by more than a link allows is left out; for the others partial overlaps are counted, without those
   that cannot make it whatever comes, and summed for each pair, and the exact test links.

Components of links are found by stars (components.py). No link between different sets is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, Scratch, Words, chunks, collect_garbage, doc_columns, identified, mix64, starts_of_runs, tidy, whole_groups
from .components import Forest, connected_components

WORDS, PERCENT = 5, 80
BUCKETS, FRAGMENTS = 128, 8
#: Sets of a loose group that one task compares with all of the group.
BLOCK = 16_000
#: Sets of a loose group from which on pivots come first, and how many there are. Links do not depend on either.
CROWD, PIVOTS = 32, 8
#: Frequent grams that are put last in the order; their number is bounded, and any choice gives the same links.
FREQUENT = 1 << 16
CHUNK = 2 << 20
#: A fixed odd number that spreads the words of a gram.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def least_overlap(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


class Shingles:
    """Sets of n-gram hashes of texts: sorted, distinct; one gram for texts with fewer words; none without words."""

    def __init__(self, size: int = WORDS):
        self.size = size

    def of(self, texts: pa.Array):
        """The set of each text in turn."""
        told = Words(pc.ascii_lower(texts))
        for end, n in zip(np.cumsum(told.lengths).tolist(), told.lengths.tolist()):
            yield np.unique(self.grams_of(told.hashes[end - n : end]))

    def grams_of(self, words: np.ndarray) -> np.ndarray:
        n = len(words)
        size = min(self.size, n)
        if n == 0:
            return words
        out = np.full(n - size + 1, np.uint64(size))
        with np.errstate(over="ignore"):
            for k in range(size):
                out = (out ^ (out >> np.uint64(29))) * SPREAD + words[k : n - size + 1 + k]
        return mix64(out)


def frequent_grams(docs: DataFrame, size: int = WORDS, most: int = FREQUENT) -> np.ndarray:
    """Grams that many documents of a chunk have, the most frequent `most` of them all, in ascending order of hash."""

    def run(batches):
        shingles = Shingles(size)
        for batch in chunks(batches, limit=CHUNK):
            # all texts as one: repeats within a text count as well, and the few grams over a seam are in no set
            found, counts = np.unique(shingles.grams_of(Words(pc.ascii_lower(batch.column(1))).hashes), return_counts=True)
            many = counts >= max(6, batch.num_rows // 500)
            yield pa.RecordBatch.from_arrays([pa.array(found[many].view(np.int64)), pa.array(counts[many])], names=["gram", "n"])

    counted = doc_columns(docs).mapInArrow(tidy(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "gram").limit(most).select("gram").collect()  # bounded by `most`
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def in_order(grams: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """Grams in the global order, and how many of them are not frequent."""
    if not len(frequent) or not len(grams):
        return grams, len(grams)
    late = frequent[np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)] == grams
    return np.concatenate([grams[~late], grams[late]]), int((~late).sum())


def set_key(grams: np.ndarray) -> int:
    """64 bits that equal sets share, by sum and exclusive-or of mixed hashes."""
    with np.errstate(over="ignore"):
        total = mix64(grams).sum(dtype=np.uint64)
        parity = np.bitwise_xor.reduce(mix64(grams + SPREAD))
        return int(mix64(np.array([total * SPREAD + parity + np.uint64(len(grams))], np.uint64)).view(np.int64)[0])


def bucket_sizes(grams: np.ndarray) -> np.ndarray:
    """Grams in each of BUCKETS fragments; 255 stands for as many or more."""
    return np.minimum(np.bincount((grams >> np.uint64(57)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8)


def _describe(size: int, percent: int, frequent: np.ndarray):
    def run(batches):
        shingles = Shingles(size)
        seen: set[int] = set()
        for batch in chunks(batches, limit=CHUNK):
            if len(seen) > 500_000:
                seen.clear()
            sizes, keys, prefixes, buckets = [], [], [], []
            for grams in shingles.of(batch.column(1)):
                n = len(grams)
                sizes.append(n)
                key = set_key(grams) if n else None
                keys.append(key)
                if n and key not in seen:
                    seen.add(key)
                    prefixes.append(in_order(grams, frequent)[0][: n - least_overlap(n, percent) + 1].view(np.int64))
                    buckets.append(bucket_sizes(grams).tobytes())
                else:  # no words, or a copy of a set that this task has told already
                    prefixes.append(None)
                    buckets.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(buckets, pa.binary())], names=["doc_id", "n", "key", "prefix", "buckets"])

    return run


def _share_gram(percent: int):
    """Groups (group, key) of sets that share a prefix gram and have neighbours of linkable size; equal groups once a table."""

    def run(batches):
        for table in whole_groups(batches, ("gram",)):
            gram, key, n = (table.column(c).to_numpy() for c in ("gram", "key", "n"))
            order = np.lexsort((key, n, gram))
            gram, key, n = gram[order], key[order], n[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])
            gram, key, n = gram[fresh], key[fresh], n[fresh]
            new = np.ones(len(key) + 1, bool)
            new[1:-1] = (gram[1:] != gram[:-1]) | (percent * n[1:] > 100 * n[:-1])
            runs = np.flatnonzero(new)
            size = np.diff(runs)
            keep = np.repeat(size > 1, size)
            if not keep.any():
                continue
            key, size = key[keep], size[size > 1]
            with np.errstate(over="ignore"):
                starts = np.cumsum(size) - size
                name = mix64(np.add.reduceat(mix64(key.view(np.uint64)), starts) + size.astype(np.uint64))
            once = np.zeros(len(name), bool)
            once[np.unique(name, return_index=True)[1]] = True
            rows = np.repeat(once, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[rows].view(np.int64)), pa.array(key[rows])], names=["group", "key"])

    return run


def may_link(one: np.ndarray, n_one: np.ndarray, others: np.ndarray, n_others: np.ndarray, percent: int) -> np.ndarray:
    """Whether fragment sizes allow a link; sizes of 255 bound nothing."""
    least = np.minimum(one, others)
    bound = least.sum(-1, dtype=np.int64) + np.where((least == 255).any(-1), 1 << 40, 0)
    bound = np.minimum(bound, np.minimum(n_one, n_others))
    return 100 * bound >= percent * (n_one + n_others - bound)


def _loosely(percent: int):
    """Spanning forests (a, b) of the pairs in each group that may be linked."""

    def run(batches):
        for table in whole_groups(batches, ("group",)):
            group, key, n = (table.column(c).to_numpy() for c in ("group", "key", "n"))
            sizes = np.frombuffer(b"".join(table.column("buckets").to_pylist()), np.uint8).reshape(len(key), BUCKETS)
            runs = starts_of_runs(group)
            a, b = [], []
            two = runs[:-1][np.diff(runs) == 2]
            ok = two[may_link(sizes[two], n[two], sizes[two + 1], n[two + 1], percent)]
            a.append(key[ok])
            b.append(key[ok + 1])
            for k in np.flatnonzero(np.diff(runs) > 2):
                lo, hi = runs[k], runs[k + 1]
                waiting = np.arange(lo, hi)
                reached: list[int] = []
                while len(waiting):
                    if not reached:
                        reached, waiting = [int(waiting[0])], waiting[1:]
                        continue
                    v = reached.pop()
                    hit = may_link(sizes[v], n[v], sizes[waiting], n[waiting], percent)
                    got = waiting[hit]
                    a.append(np.full(len(got), key[v]))
                    b.append(key[got])
                    reached += got.tolist()
                    waiting = waiting[~hit]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def _fragments(size: int, frequent: np.ndarray):
    """Cut the sets of loose groups along the global order; rows (component, sets, fragment, key, n, grams)."""

    def run(batches):
        shingles = Shingles(size)
        for batch in chunks(batches, limit=CHUNK):
            out: list[list] = [[] for _ in range(6)]
            for whole, component, key, sets in zip(shingles.of(batch.column(0)), *(c.to_pylist() for c in batch.columns[1:])):
                if set_key(whole) != key:  # another text of a repeated id
                    continue
                grams, rare = in_order(whole, frequent)
                place = (grams >> np.uint64(61)).astype(np.int64)
                place[rare:] = FRAGMENTS - 1
                cuts = np.searchsorted(place, np.arange(FRAGMENTS + 1))
                for f in range(FRAGMENTS):
                    for column, x in zip(out, (component, sets, f, key, len(grams), np.sort(grams[cuts[f] : cuts[f + 1]]).tobytes())):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["component", "sets", "fragment", "key", "n", "grams"])

    return run


_PLACE = ("component", "fragment", "block")
_PIVOTED = "component long, key long, n long, " + ", ".join(f"{c}{k} long" for c in "cp" for k in range(PIVOTS))


def _pivot_overlaps(batches):
    """(component, key, n, c0.., p0..): what each set of a block shares with each pivot in a fragment, and the pivots' sizes."""
    names = ["component", "key", "n", *(f"{c}{k}" for c in "cp" for k in range(PIVOTS))]
    for table in whole_groups(batches, _PLACE, limit=4 << 20):
        component, fragment, block, pivot, key, n = (table.column(c).to_numpy() for c in (*_PLACE, "pivot", "key", "n"))
        grams = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
        runs = starts_of_runs(component, fragment, block)
        for lo, hi in zip(runs[:-1].tolist(), runs[1:].tolist()):
            leads = [k for k in range(lo, hi) if pivot[k] >= 0]
            own = np.array([k for k in range(lo, hi) if pivot[k] < 0], np.int64)
            if not len(own):
                continue
            own = own[np.unique(key[own], return_index=True)[1]]  # rows that repeat an id bring their sets again
            sizes, bits = np.zeros(PIVOTS, np.int64), [np.zeros(0, np.uint64)]
            for k in leads:
                sizes[pivot[k]] = n[k]
                bits.append(np.full(len(grams[k]), np.uint64(1) << np.uint64(pivot[k])))
            theirs = np.concatenate([np.zeros(0, np.uint64), *(grams[k] for k in leads)])
            order = np.argsort(theirs, kind="stable")
            theirs, bits = theirs[order], np.concatenate(bits)[order]
            first = starts_of_runs(theirs)
            kinds = theirs[first[:-1]]
            told = np.bitwise_or.reduceat(bits, first[:-1]) if len(kinds) else bits
            flat = np.concatenate([grams[k] for k in own.tolist()])
            owner = np.repeat(np.arange(len(own)), [len(grams[k]) for k in own.tolist()])
            counts = np.zeros((PIVOTS, len(own)), np.int64)
            if len(kinds) and len(flat):
                at = np.minimum(np.searchsorted(kinds, flat), len(kinds) - 1)
                hit = np.flatnonzero(kinds[at] == flat)
                for k in range(PIVOTS):
                    counts[k] = np.bincount(owner[hit], (told[at[hit]] >> np.uint64(k)) & np.uint64(1), len(own))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), component[lo])), pa.array(key[own]), pa.array(n[own]), *(pa.array(c) for c in counts), *(pa.array(np.full(len(own), x)) for x in sizes)], names=names)


def _labels(percent: int):
    """Of sets with summed overlaps with pivots: (component, key, mask, distances); bit k of mask says that pivot k links."""

    def run(batches):
        for batch in batches:
            n = batch.column(2).to_numpy()[:, None]
            counts, sizes = (np.stack([np.asarray(batch.column(3 + PIVOTS * j + k)) for k in range(PIVOTS)], 1) for j in (0, 1))
            union = n + sizes - counts
            linked = (sizes > 0) & (100 * counts >= percent * union)
            mask = (linked << np.arange(PIVOTS)).sum(1)
            far = np.where(sizes > 0, 1 - counts / np.maximum(union, 1), 1.0).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mask), pa.array([x.tobytes() for x in far], pa.binary())], names=["component", "key", "mask", "far"])

    return run


def _roots(batches):
    """(component, roots, closed) of (component, masks): pivots that sets join have the same root; closed: all sets have one label."""
    for batch in batches:
        roots, closed = [], []
        for masks in batch.column(1).to_pylist():
            forest = Forest(PIVOTS)
            for m in masks:
                own = [k for k in range(PIVOTS) if m >> k & 1]
                for k in own[1:]:
                    forest.join(own[0], k)
            found = [forest.find(k) for k in range(PIVOTS)]
            roots.append(found)
            closed.append(len({found[(m & -m).bit_length() - 1] if m else -1 - j for j, m in enumerate(masks)}) == 1 and 0 not in masks)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(roots, pa.list_(pa.int32())), pa.array(closed, pa.bool_())], names=["component", "roots", "closed"])


def _partial_overlaps(percent: int):
    """For each own set of a place: keys, sizes and partial overlaps of the sets before it, with other labels, that it may link to.

    A place below 0 has one block, whose sets are all own. Others have two: the sets of the first, and behind them own ones,
    which are held against the former alone.
    """
    slack = 1 - percent / 100 + 1e-5

    def run(batches):
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
        names = ["key", "n", "others", "sizes", "overlaps"]
        for table in whole_groups(batches, _PLACE, limit=4 << 20):
            once = starts_of_runs(*(table.column(c).to_numpy() for c in (*_PLACE, "key")))[:-1]
            if len(once) < table.num_rows:  # rows that repeat an id bring their sets again
                table = table.take(pa.array(once))
            component, fragment, block, key, n, label = (table.column(c).to_numpy() for c in (*_PLACE, "key", "n", "label"))
            own, far = table.column("own").to_pylist(), table.column("far").to_pylist()
            grams = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
            runs = starts_of_runs(component, fragment, block)
            out: list[list] = [[] for _ in names]
            held = 0
            for lo, hi in zip(runs[:-1].tolist(), runs[1:].tolist()):
                here = np.array([len(g) for g in grams[lo:hi]], np.int64)
                total, keys = n[lo:hi], key[lo:hi]
                told = pairs_to_count(grams[lo:hi], own[lo:hi], label[lo:hi], far[lo:hi], slack, block[lo] >= 0)
                for at, with_whom, counts in told:
                    bound = counts + np.minimum(total[at] - here[at], total[with_whom] - here[with_whom])
                    some = (100 * bound >= percent * (total[at] + total[with_whom] - bound)) & (counts > 0)
                    others, counts = with_whom[some], counts[some]
                    if not len(others):
                        continue
                    for column, x in zip(out, (keys[at], total[at], keys[others], total[others].astype(np.int32), counts.astype(np.int32))):
                        column.append(x)
                    held += 20 + len(others)
                    if held > 400_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)
                        out, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return run


def pairs_to_count(grams: list[np.ndarray], own: list[bool], label: np.ndarray, far: list[bytes | None], slack: float, between: bool = False):
    """For each own set: its place, the places of sets before it that it may be linked with by a link not known yet, and what they share.
    In a place `between` two blocks only the sets that are not own are looked at.

    A label of -1 is like no other. `far` are distances to pivots, which a link changes by `slack` at most.
    """
    if far[0] is None:
        for at, counts in overlaps_with_earlier(grams, own):
            yield at, np.arange(at), counts
        return
    distances = np.frombuffer(b"".join(far), "<f4").reshape(len(far), PIVOTS)
    everyone, holders = np.arange(len(far)), None
    others = {x: np.flatnonzero(label != x) for x in np.unique(label).tolist() if x >= 0}
    foreign = len(own) - sum(own)  # they come first
    for at in np.flatnonzero(own).tolist():
        near = others.get(int(label[at]), everyone)
        near = near[: np.searchsorted(near, foreign if between else at)]
        near = near[(np.abs(distances[near] - distances[at]) <= slack).all(1)]
        if not len(near):
            continue
        if len(near) > 16:
            holders = holders or Holders(grams)
            yield at, near, holders.earlier(at)[near]
        else:
            yield at, near, np.array([len(np.intersect1d(grams[at], grams[k], assume_unique=True)) for k in near.tolist()], np.int64)


def overlaps_with_earlier(sets: list[np.ndarray], asked: list[bool]):
    """For each set that is asked for: its place, and how many grams it shares with each set before it."""
    if len(sets) <= 6:
        for at, own in enumerate(sets):
            if asked[at]:
                yield at, np.array([len(np.intersect1d(own, other, assume_unique=True)) for other in sets[:at]], np.int64)
        return
    holders = Holders(sets)
    for at in np.flatnonzero(asked).tolist():
        yield at, holders.earlier(at)


class Holders:
    """Which sets hold each gram, in the order of the sets."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")  # holders of a gram lie together, in the order of the sets
        cut = starts_of_runs(every[order])
        which = np.empty(len(every), np.int64)
        which[order] = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        self.rank = np.empty(len(every), np.int64)
        self.rank[order] = np.arange(len(every)) - np.repeat(cut[:-1], np.diff(cut))
        self.first, self.holders, self.ends, self.sizes = cut[which], owner[order], np.cumsum(sizes), sizes

    def earlier(self, at: int) -> np.ndarray:
        """How many grams a set shares with each one before it."""
        mine = slice(self.ends[at] - self.sizes[at], self.ends[at])
        before, first = self.rank[mine], self.first[mine]  # holders of each gram that come before this set
        hits = np.repeat(first - np.cumsum(before) + before, before) + np.arange(before.sum())
        return np.bincount(self.holders[hits], minlength=at).astype(np.int64)[:at] if at else np.zeros(0, np.int64)


def _sum_overlaps(percent: int):
    """Sum partial overlaps over fragments and test each pair; emits the links of a task's sets as a spanning forest of them."""

    def run(batches):
        for table in whole_groups(batches, ("key",), limit=4 << 20):
            key, n = table.column("key").to_numpy(), table.column("n").to_numpy()
            lists = [table.column(c).combine_chunks() for c in ("others", "sizes", "overlaps")]
            per_row = np.diff(lists[0].offsets.to_numpy())
            others, sizes, overlaps = (x.flatten().to_numpy() for x in lists)
            a, n_a = np.repeat(key, per_row), np.repeat(n, per_row)
            order = np.lexsort((others, a))
            a, n_a, b, n_b, k = a[order], n_a[order], others[order], sizes[order].astype(np.int64), overlaps[order].astype(np.int64)
            runs = starts_of_runs(a, b)
            if len(runs) < 2:
                continue
            total, at = np.add.reduceat(k, runs[:-1]), runs[:-1]
            linked = 100 * total >= percent * (n_a[at] + n_b[at] - total)
            a, b = a[at][linked], b[at][linked]
            nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            forest = Forest(len(nodes))
            keep = [forest.join(x, y) for x, y in zip(place[: len(a)].tolist(), place[len(a) :].tolist())]
            keep = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return run


def jaccard_components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id - the smallest doc_id reachable by links, itself included.

    Documents are linked when 100 * intersection >= percent * union of their sets. Null and empty texts and texts
    of white space have the empty set and are linked with nothing; their component is their own id. Rows that repeat
    a doc_id are documents of their own with that id. A null id is linked as others are but counts in no component's least.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    plain = doc_columns(docs)
    frequent = frequent_grams(docs, size)
    told = scratch.write(plain.mapInArrow(tidy(_describe(size, percent, frequent)), "doc_id long, n long, key long, prefix array<long>, buckets binary"), "sets")
    entries = told.where("prefix IS NOT NULL").select(F.explode("prefix").alias("gram"), "key", "n")
    shared = entries.repartition(F.col("gram")).sortWithinPartitions("gram").mapInArrow(tidy(_share_gram(percent)), "group long, key long")
    groups = scratch.write(shared.dropDuplicates(["group", "key"]), "groups")
    del entries, shared
    collect_garbage(spark)
    sizes = told.where("buckets IS NOT NULL").select("key", "n", "buckets").dropDuplicates(["key"])
    loose = groups.join(sizes, "key").select("group", "key", "n", "buckets").repartition(F.col("group")).sortWithinPartitions("group", "key")
    coarse = connected_components(loose.mapInArrow(tidy(_loosely(percent)), "a long, b long"))
    firsts = told.where("key IS NOT NULL").groupBy("key").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("doc_id"))
    coarse = scratch.write(coarse, "coarse")
    scratch.drop(groups)
    leads = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node")).getField("node") for k in range(PIVOTS)]
    crowds = scratch.write(coarse.groupBy("component").agg(F.count("*").alias("sets"), F.array_distinct(F.array(*leads)).alias("pivots")), "crowds")
    wanted = firsts.join(coarse, F.col("key") == F.col("node")).join(crowds, "component").select("doc_id", "component", "key", "sets")
    del loose, sizes
    collect_garbage(spark)
    # texts meet their keys by a hash of the latter: no sort of texts, and the same plan at every size
    cut = identified(docs).select("doc_id", "text").where("text IS NOT NULL").join(wanted.hint("shuffle_hash"), "doc_id").select("text", "component", "key", "sets")
    parts = scratch.write(cut.mapInArrow(tidy(_fragments(size, frequent)), "component long, sets long, fragment int, key long, n long, grams binary"), "parts")
    del cut, wanted
    blocks = F.ceil(F.col("sets") / F.lit(BLOCK)).cast("long")
    big = parts.where(F.col("sets") > CROWD)
    pivots = crowds.where(F.col("sets") > CROWD).select("component", F.posexplode("pivots").alias("pivot", "key"))
    mine = big.select("component", "fragment", F.pmod("key", blocks).alias("block"), F.lit(-1).alias("pivot"), "key", "n", "grams")
    theirs = big.join(pivots, ["component", "key"]).select("component", "fragment", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "pivot", "key", "n", "grams")
    met = mine.unionByName(theirs).repartition(*_PLACE).sortWithinPartitions(*_PLACE).mapInArrow(tidy(_pivot_overlaps), _PIVOTED)
    sums = met.groupBy("component", "key", "n").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(PIVOTS)), *(F.max(f"p{k}").alias(f"p{k}") for k in range(PIVOTS)))
    labelled = scratch.write(sums.mapInArrow(tidy(_labels(percent)), "component long, key long, mask long, far binary"), "labelled")
    del mine, theirs, met, sums
    roots = labelled.groupBy("component").agg(F.collect_set("mask").alias("masks")).mapInArrow(tidy(_roots), "component long, roots array<int>, closed boolean")
    told_of = labelled.join(scratch.write(roots, "roots"), "component").join(crowds.select("component", "pivots"), "component")
    lowest = F.expr("CASE " + " ".join(f"WHEN mask & {1 << k} <> 0 THEN {k}" for k in range(PIVOTS)) + " ELSE -1 END").cast("int")
    told_of = told_of.withColumn("low", lowest)
    star = told_of.where("low >= 0").select(F.col("key").alias("a"), F.col("pivots")[F.col("low")].alias("b"))
    between = told_of.where("low >= 0").select("component", "low", "mask", "pivots").distinct().select(F.col("pivots")[F.col("low")].alias("a"), F.explode("pivots").alias("b"), F.array_position("pivots", F.col("b")).alias("k"), "mask").where("mask >> cast(k - 1 as int) & 1 = 1").select("a", "b").distinct()
    labels = told_of.where("NOT closed").select("component", "key", "far", F.when(F.col("low") >= 0, F.col("roots")[F.col("low")]).otherwise(-1).alias("label"))
    small = parts.where(F.col("sets") <= CROWD).select("component", "fragment", F.lit(-1).cast("long").alias("block"), F.lit(True).alias("own"), "key", "n", F.lit(-1).alias("label"), F.lit(None).cast("binary").alias("far"), "grams")
    # each block meets each other one, and itself, in a place of its own, so no task holds more than two blocks
    mine, other = F.pmod("key", blocks), F.col("other")
    open_sets = big.join(labels, ["component", "key"]).select("*", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    open_sets = open_sets.select("component", "fragment", F.when(mine == other, -1 - mine).otherwise(F.least(mine, other) * blocks + F.greatest(mine, other)).alias("block"), (other <= mine).alias("own"), "key", "n", "label", "far", "grams")
    compared = small.unionByName(open_sets).repartition(*_PLACE).sortWithinPartitions(*_PLACE, "own", "key").mapInArrow(tidy(_partial_overlaps(percent)), "key long, n long, others array<long>, sizes array<int>, overlaps array<int>")
    summed = compared.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(tidy(_sum_overlaps(percent)), "a long, b long")
    links = scratch.write(summed.unionByName(star).unionByName(between), "links")
    scratch.drop(parts)
    del compared, summed, small, open_sets, big
    collect_garbage(spark)
    linked = connected_components(links)
    scratch.drop(links, coarse)
    rows = told.select("doc_id", F.col("n").alias("n_shingles"), "key").join(linked, F.col("key") == F.col("node"), "left")
    rows = rows.select("doc_id", "n_shingles", F.coalesce("component", "key").alias("class"))
    least = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "class", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The first document of each component, all columns as they were; rows that repeat an id stay or go together.

    Rows without an id stay, as do null and empty texts; an empty table gives an empty one.
    """
    first = jaccard_components(docs, size, percent).where("doc_id IS NOT NULL AND component_id < doc_id").select(F.col("doc_id").alias("_copy")).distinct()
    # a row travels as one column, so that no name clashes
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return rows.join(first, F.col("_row.doc_id").cast("long") == F.col("_copy"), "left_anti").select("_row.*")
