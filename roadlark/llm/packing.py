"""Best-fit packing of token sequences by a grouping genetic algorithm on distributed islands.

Pieces are dealt into provinces of a bounded size. Several islands work on each province, in tasks of their own: each
holds a population of whole packings of the province's pieces. Crossover injects well-filled bins of one parent
into another, takes out the bins that then hold a piece twice, and best-fits the displaced pieces. After each round an
island's elite migrates to the next island of its ring, through a table. After the last round of an epoch the
province's best packing counts: its well-filled bins are settled, and the pieces of the others are dealt into new
provinces. Pieces of full length are sequences as they are and never travel.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, doc_columns, tidy
from .tokens import VOCABULARY, pieces_for, vocabulary_path

CAPACITY = 2048
END_ID = 0
#: Pieces of a province; an island's memory and time are bounded by this, not by the input.
PROVINCE = 2500
#: Islands in a ring, packings on each, and rounds between which elites migrate.
ISLANDS, POPULATION, ROUNDS = 3, 4, 3
#: Pieces that children of a round place in all: as many children as that makes for the pieces of a province.
EFFORT = 250_000
#: Free tokens up to which a bin is settled, by epoch; the last epoch settles all.
SLACK = (4, 8, 16, CAPACITY)


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian 32-bit): each document's ids and then END_ID, longer ones cut
    into pieces of the capacity of which the first may be shorter. A null or empty text is END_ID alone.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        pieces = pieces_for(vocabulary_path(vocabulary))
        for batch in chunks(batches, limit=4 << 20):
            rows: list[list] = [[], [], [], [], []]
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = pieces.ids(value.as_py() or "").astype("<u4").tobytes() + end
                total = len(ids) // 4
                start, k = 0, 0
                while start < total:
                    stop = start + ((total - 1) % capacity + 1 if k == 0 else capacity)
                    for column, x in zip(rows, (doc_id, k, start, stop - start, ids[4 * start : 4 * stop])):
                        column.append(x)
                    start, k = stop, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "piece", "start", "length", "ids"])

    return doc_columns(docs).mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids binary")


class Bin(list):
    """Indexes of pieces; `filled` is the sum of their lengths, once it has been asked for."""

    __slots__ = ("filled",)


Bins = list[Bin]


def _copy(b: Bin) -> Bin:
    out = Bin(b)
    out.filled = b.filled
    return out


class Island:
    """A population of packings of `lengths`; bins are lists of indexes. One island of a ring."""

    def __init__(self, lengths: list[int], capacity: int, seed: int):
        self.lengths, self.capacity, self.rng = lengths, capacity, random.Random(seed)
        self.floor = -(-sum(lengths) // capacity)

    def fill(self, b: Bin) -> int:
        try:
            return b.filled
        except AttributeError:
            b.filled = sum(map(self.lengths.__getitem__, b))
            return b.filled

    def best_fit(self, items: list[int], bins: Bins) -> Bins:
        """Put items, in their order, where the least room is left over. `open_at[r]`: bins with room r; bit r of mask: any."""
        open_at: dict[int, list[int]] = {}
        mask = 0
        for k, b in enumerate(bins):
            room = self.capacity - self.fill(b)
            if room:
                open_at.setdefault(room, []).append(k)
                mask |= 1 << room
        for i in items:
            need = self.lengths[i]
            rest = mask >> need
            if rest:
                room = need + (rest & -rest).bit_length() - 1
                k = open_at[room].pop()
                if not open_at[room]:
                    mask &= ~(1 << room)
                bins[k].append(i)
                bins[k].filled += need
                room -= need
            else:
                k, room = len(bins), self.capacity - need
                new = Bin((i,))
                new.filled = need
                bins.append(new)
            if room:
                open_at.setdefault(room, []).append(k)
                mask |= 1 << room
        return bins

    def fitness(self, bins: Bins) -> float:
        """Fewer bins first; of as many, the one with fuller bins and emptier leftovers."""
        return sum((x / self.capacity) ** 2 for x in map(self.fill, bins)) / max(1, len(bins))

    def newcomer(self, noise: float) -> Bins:
        order = sorted(range(len(self.lengths)), key=lambda i: -self.lengths[i] * (1 + noise * self.rng.random()))
        return self.best_fit(order, [])

    def cross(self, one: Bins, other: Bins) -> Bins:
        """Inject the best-filled bins of `other` into `one`."""
        gifts = sorted(other, key=lambda b: (self.fill(b), self.rng.random()), reverse=True)
        gifts = [b for b in gifts[: max(1, int(len(gifts) * self.rng.uniform(0.2, 0.7)))] if self.rng.random() < 0.9] or gifts[:1]
        taken = {i for b in gifts for i in b}
        kept, displaced = [_copy(b) for b in gifts], []
        for b in one:
            if taken.isdisjoint(b):
                self.fill(b)
                kept.append(_copy(b))
            else:
                displaced += [i for i in b if i not in taken]
        return self._refit(kept, displaced)

    def mutate(self, bins: Bins) -> Bins:
        """Dissolve the emptiest bins and some others."""
        order = sorted(bins, key=self.fill)
        n = self.rng.randint(1, max(1, len(order) // 12))
        gone = order[:n] + self.rng.sample(order[n:], min(len(order) - n, self.rng.randint(1, max(2, n))))
        ids = set(map(id, gone))
        return self._refit([_copy(b) for b in bins if id(b) not in ids], [i for b in gone for i in b])

    def _refit(self, kept: Bins, displaced: list[int]) -> Bins:
        noise = self.rng.choice((0.0, 0.1, 0.5))  # long pieces first, more or less
        displaced.sort(key=lambda i: -self.lengths[i] * (1 + noise * self.rng.random()))
        return self.best_fit(displaced, kept)

    def score(self, bins: Bins) -> tuple[int, float]:
        return -len(bins), self.fitness(bins)

    def settled(self, bins: Bins) -> bool:
        """No packing can have fewer bins."""
        return len(bins) <= max(1, self.floor) or not self.lengths

    def people(self, number: int = 0, population: int = POPULATION) -> list[Bins]:
        """The first population of the island of that number in its ring; plain best-fit decreasing is on the first one."""
        if not self.lengths:
            return [[]]
        best = self.newcomer(0.0)
        return [best] if self.settled(best) else [best if number == p == 0 else self.newcomer(0.15 * (number + p)) for p in range(population)]

    def evolve(self, people: list[Bins], children: int | None = None) -> list[Bins]:
        """The population after a round, best first; stops where no packing can have fewer bins."""
        ranked = sorted(((self.score(p), p) for p in people), key=lambda x: x[0], reverse=True)
        for _ in range(children or max(1, EFFORT // max(1, len(self.lengths)))):
            one = ranked[0][1]
            if self.settled(one):
                break
            other = self.rng.choice(ranked[1:])[1] if len(ranked) > 1 else one
            child = self.cross(other, one) if other is not one and self.rng.random() < 0.6 else self.mutate(one if self.rng.random() < 0.5 else other)
            score = self.score(child)
            if score > ranked[-1][0] and all(child != p for _, p in ranked):
                ranked[-1:] = [(score, child)] if len(ranked) >= POPULATION else [ranked[-1], (score, child)]
                ranked.sort(key=lambda x: x[0], reverse=True)
        return [p for _, p in ranked]


def pack_ring(lengths: list[int], capacity: int, seed: int = 0, islands: int = ISLANDS, rounds: int = ROUNDS, children: int | None = None) -> Bins:
    """The best packing that one ring of islands finds, all in this process."""
    ring = [Island(lengths, capacity, seed * 31 + k) for k in range(islands)]
    people = [x.people(k) for k, x in enumerate(ring)]
    for _ in range(rounds):
        people = [x.evolve(p, children) for x, p in zip(ring, people)]
        elites = [p[0] for p in people]
        people = [[*p, elites[k - 1]] for k, p in enumerate(people)]
    return max((b for p in people for b in p), key=ring[0].score)


def _written(people: list[Bins], n: int) -> bytes:
    """Packings as the number of each piece's bin."""
    out = np.zeros((len(people), n), "<i4")
    for row, bins in zip(out, people):
        for k, b in enumerate(bins):
            row[b] = k
    return out.tobytes()


def _read(blob: bytes, n: int) -> list[Bins]:
    people = []
    for row in np.frombuffer(blob, "<i4").reshape(-1, n) if n else []:
        bins: Bins = [Bin() for _ in range(int(row.max()) + 1)]
        for i, k in enumerate(row.tolist()):
            bins[k].append(i)
        people.append(bins)
    return people


_STATE = "province long, island int, lengths array<long>, people binary, bins long, fitness double"


def _round(capacity: int, epoch: int, number: int):
    """One round of each island (province, island, lengths, people, elite): a first population, or the last one and an immigrant."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for province, island, lengths, people, elite in zip(*(c.to_pylist() for c in batch.columns)):
                own = Island(lengths, capacity, ((province * 8 + epoch) * 64 + island) * 64 + number)
                now = own.evolve(own.people(island) if people is None else _read(people, len(lengths)) + _read(elite, len(lengths)))
                for column, x in zip(out, (province, island, lengths, _written(now, len(lengths)), len(now[0]), own.fitness(now[0]))):
                    column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["province", "island", "lengths", "people", "bins", "fitness"])

    return run


def _places(capacity: int, slack: int, epoch: int):
    """Where each piece of a province is in its best packing: (uid, length, sequence_id, offset, settled)."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for province, uids, lengths, people in zip(*(c.to_pylist() for c in batch.columns)):
                for n, b in enumerate(_read(people, len(lengths))[0]):
                    done, at = capacity - sum(lengths[i] for i in b) <= slack, 0
                    for i in b:
                        for column, x in zip(out, (uids[i], lengths[i], (epoch + 1 << 56) + (province << 16) + n, at, done)):
                            column.append(x)
                        at += lengths[i]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["uid", "length", "sequence_id", "offset", "settled"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, province: int = PROVINCE, slack: tuple[int, ...] = SLACK) -> DataFrame:
    """All columns of pieces (`length` among them) and sequence_id, offset; own columns of these two names give way.

    Every row is placed just once; offsets in a sequence run from 0 without gaps. Repeated rows, and rows with null or
    repeated ids, are pieces of their own. An empty table gives an empty one. Lengths are within 1 and the capacity.
    """
    scratch = Scratch(pieces.sparkSession, "pack")
    plain = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    numbered = pieces.select(F.struct(*[F.col(f"`{c}`") for c in plain]).alias("row"), F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("uid"))
    table = scratch.write(numbered, "pieces")
    placed = [table.where(F.col("length") >= capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = table.where(F.col("length") < capacity).select("uid", "length")
    for epoch, most in enumerate(slack):
        count = rest.count()
        if not count:
            break
        n = max(1, round(count / province))
        dealt = rest.groupBy(F.pmod(F.xxhash64("uid", F.lit(epoch)), F.lit(n)).alias("province")).agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("own"))
        dealt = scratch.write(dealt.select("province", F.col("own.uid").alias("uids"), F.col("own.length").alias("lengths")), f"provinces{epoch}")
        state = dealt.select("province", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths", F.lit(None).cast("binary").alias("people"), F.lit(None).cast("binary").alias("elite"))
        tasks = min(10_000, n * ISLANDS)
        rounds: list[DataFrame] = []
        floor = F.greatest(F.lit(1), F.ceil(F.aggregate("lengths", F.lit(0).cast("long"), lambda x, y: x + y) / capacity))
        for k in range(ROUNDS):
            now = scratch.write(state.repartition(tasks, "province", "island").mapInArrow(tidy(_round(capacity, epoch, k)), _STATE), f"round{epoch}-{k}")
            rounds.append(now)
            # provinces go on until one of their packings can't have fewer bins
            going = now.groupBy("province").agg(F.min(F.col("bins") - floor).alias("over")).where("over > 0").select("province")
            tasks = min(10_000, going.count() * ISLANDS)
            if not tasks:
                break
            # the elite of each island goes to the next one in the ring
            guests = now.select("province", ((F.col("island") + 1) % ISLANDS).alias("island"), F.substring("people", F.lit(1), (F.size("lengths") * 4).cast("int")).alias("elite"))
            state = now.join(going, "province").join(guests, ["province", "island"]).select("province", "island", "lengths", "people", "elite")
        every = reduce(DataFrame.unionByName, rounds)
        best = every.groupBy("province").agg(F.max_by("people", F.struct(-F.col("bins"), "fitness")).alias("people"))
        told = dealt.join(best, "province").select("province", "uids", "lengths", "people").mapInArrow(tidy(_places(capacity, most, epoch)), "uid long, length long, sequence_id long, offset long, settled boolean")
        told = scratch.write(told, f"epoch{epoch}")
        placed.append(told.where("settled").select("uid", "sequence_id", "offset"))
        rest = told.where("NOT settled").select("uid", "length")
    where = placed[0]
    for x in placed[1:]:
        where = where.unionByName(x)
    return table.select("row", "uid").join(where, "uid").select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: the whole way without the ids travelling."""
    pieces = tokenized_pieces(docs, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(pieces, capacity)
