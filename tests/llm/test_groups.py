"""Operators that hold texts against each other, against brute force."""

from __future__ import annotations

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from roadlark.llm import common, components, decontam, jaccard, lines, suffixes
from roadlark.llm.common import NO_ID, identified, lower_words_of

from .conftest import SCHEMA, edited, sentence


def groups(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    pairs = {"random": [(rng.randrange(200), rng.randrange(200)) for _ in range(130)], "path": [(k, k + 1) for k in range(120)], "star": [(0, k) for k in range(1, 150)] + [(0, 3), (7, 7), (190, 190)], "none": []}[shape]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = groups(200, pairs)
    assert got == {n: want[n] for p in pairs for n in p}


def test_components_leave_nulls_out(spark):
    got = components.connected_components(spark.createDataFrame([(1, None), (None, 2), (3, 4)], "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in got) == [(3, 3), (4, 3)]


# Lines


def own_words(line):
    """Normal words by plain string functions, not by the operator's."""
    return [w for w in (x.lower().strip(lines.EDGE.decode()) for x in line.split()) if w]


def slow_lines(corpus):
    """Lines to take away, by the definition alone: all pairs of distinct lines by edit similarity, without blocks or bits."""
    first, gone = {}, set()
    for i, t in sorted(corpus, key=lambda x: x[0]):
        for n, line in enumerate((t or "").split("\n")):
            words = tuple(own_words(line))
            if words and first.setdefault(words, (i, n)) != (i, n):
                gone.add((i, n))
    told = list(first)
    pairs = [(b, a) for a in range(len(told)) for b in range(a) if lines.similar(list(told[a]), list(told[b]))]
    members = defaultdict(list)
    for k, g in enumerate(groups(len(told), pairs)):
        members[g].append(first[told[k]])
    for m in members.values():
        gone.update(sorted(m)[1:])
    return gone


def test_lines(docs, corpus, crowded, nothing):
    gone = slow_lines(corpus)
    assert gone
    out = lines.dedup_lines(crowded)
    assert set(crowded.columns) <= set(out.columns)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(corpus)
    for i, t in corpus:
        own = (t or "").split("\n")
        want = None if t is None else "\n".join(x for n, x in enumerate(own) if (i, n) not in gone)
        assert got[i].text == want
        assert (got[i].n_lines, got[i].n_removed) == (len(own) if t else 0, sum((i, n) in gone for n in range(len(own))))
        assert got[i]["line"] == "own line"
    assert lines.dedup_lines(nothing).count() == 0


def test_short_lines_texts_of_one_id_and_null_ids(spark):
    """Equal lines go at any length; texts that share an id stay apart; rows without an id come last; own counts give way."""
    rng = random.Random(4)
    a, b, c = (sentence(rng, 12) for _ in range(3))
    rows = [(1, f"yes\n{a}"), (2, f"{b}\n..."), (2, f"{c}\n{a}\n..."), (2, f"{c}\n{a}\n..."), (None, f"YES.\n{b}\nonly here now"), (3, "\n\n"), (4, None)]
    docs = spark.createDataFrame([(*r, "own", "own") for r in rows], "doc_id long, text string, n_lines string, _gone string")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed, r["_gone"]) for r in lines.dedup_lines(docs).collect()), key=str)
    want = [(1, f"yes\n{a}", 2, 0), (2, f"{b}\n...", 2, 0), (2, f"{c}\n...", 3, 1), (2, f"{c}\n...", 3, 1), (None, "only here now", 3, 2), (3, "\n\n", 3, 0), (4, None, 0, 0)]
    assert got == sorted(((*w, "own") for w in want), key=str)


@pytest.mark.parametrize("hashed", [1 << 18, 5])
def test_words_by_bytes(monkeypatch, hashed):
    """Words, sizes, texts and lines of random texts by plain string functions; equal words have equal hashes and no others."""
    monkeypatch.setattr(common, "HASHED", hashed)
    rng = random.Random(41)
    parts = ["a", "b", "ab", "é", "漢", ".", "%%", "-", " ", "  ", "\n", "\t", "\x0b", "\x85", "\u00a0", "a.b"]
    for _ in range(200):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 6))]
        array = lines.pa.array([*texts, "x"], lines.pa.string()).slice(0, len(texts))
        for edge in (b"", lines.EDGE):
            got, want = lines.Words(array, edge, by_line=True), []
            n = 0
            for t, text in enumerate(texts):
                for line in [] if text is None else text.encode().split(b"\n"):
                    want += [(w.strip(edge) if edge else w, t, n) for w in line.split() if not edge or w.strip(edge)]
                    n += 1
            assert got.text.tolist() == [t for _, t, _ in want] and got.line.tolist() == [k for _, _, k in want]
            assert got.sizes.tolist() == [len(w) for w, _, _ in want] and len(got.line_lengths) == n
            hashes = dict(zip((w for w, _, _ in want), got.hashes.tolist()))
            assert len(set(hashes.values())) == len(hashes) and all(hashes[w] == h for (w, _, _), h in zip(want, got.hashes.tolist()))


def spoiled(rng, words, share):
    """Words with a share of edits: substitutions, deletions and insertions, within the bound of the longer of both."""
    out = list(words)
    for _ in range(int(share * len(words) + 1e-9)):
        kind, k = rng.choice("ssdi"), rng.randrange(len(out))
        if kind == "d" and len(out) > 4:
            out.pop(k)
        else:
            out[k : k + (kind != "i")] = [sentence(rng, 1)]
    return out


@pytest.mark.parametrize("n", [5, 8, 9, 10, 20, 40, 80, 200])
@pytest.mark.parametrize("share", [0.1, 0.2])
def test_recall_of_similar_lines(spark, n, share):
    """Against all pairs by edit similarity alone, at the bound and below it, words said again too; nothing else is taken."""
    rng = random.Random(n)
    rows = []
    for k in range(60):
        line = sentence(rng, n).split() if k % 4 else sentence(rng, n - n // 4).split()
        line += line[: n - len(line)]
        rows += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(spoiled(rng, line, share)))]
    told = [own_words(t) for _, t in rows]
    pairs = [(a, b) for b in range(len(told)) for a in range(b) if lines.similar(told[a], told[b])]
    want = {i for i, k in enumerate(groups(len(told), pairs)) if i != k}
    got = {r.doc_id for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
    if share * n >= 1:
        assert len(want) >= 40


def short_words(rng, n, letters):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(*letters))) for _ in range(n)]


@pytest.mark.parametrize("letters", [(1, 2), (2, 3), (2, 4), (3, 4), (1, 4)])
def test_recall_of_lines_of_short_words(spark, letters):
    """Codes, numbers and abbreviations: with a fifth of the words replaced, at random places and evenly spaced."""
    rng = random.Random(letters[0] * 10 + letters[1])
    rows, kinds = [], {}
    for k in range(160):
        n, even = (10, 20, 40, 80)[k % 4], k // 4 % 2
        line = short_words(rng, n, letters)
        other = list(line)
        for at in range(2, n, 5) if even else rng.sample(range(n), n // 5):
            while other[at] == line[at]:
                other[at] = short_words(rng, 1, letters)[0]
        rows += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(other))]
        kinds[2 * k + 1] = n, even
    got = {r.doc_id for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()}
    assert got <= set(kinds)
    for kind in set(kinds.values()):
        assert sum(i in got for i, x in kinds.items() if x == kind) >= 0.9 * 20, kind


def test_halves_lose_no_pair():
    """Lines with one edit at most always have a block in common."""
    rng = random.Random(7)
    usual = [sentence(rng, 1) for _ in range(5)]
    for n in (4, 5, 6, 7, 8, 9):
        told = [[rng.choice(usual) for _ in range(n)] for _ in range(40)]
        told += [x for y in told for x in [list(y)] for k in [rng.randrange(n)] for _ in [x.__setitem__(slice(k, k + rng.choice((0, 1))), [sentence(rng, 1)] * rng.choice((0, 1)))]]
        known = lines.normal_hashes(lines.pa.array([" ".join(x) for x in told]))
        found, count = lines.blocks(known.hashes, known.sizes, known.line_lengths)
        own = [set(x.tolist()) for x in np.split(found, np.cumsum(count)[:-1])]
        for b in range(len(told)):
            for a in range(b):
                if max(len(told[a]), len(told[b])) < 10 and told[a] != told[b] and lines.similar(told[a], told[b]):
                    assert own[a] & own[b], (told[a], told[b])


def test_repeated_rows_keep_their_lines(repeated, corpus):
    gone = slow_lines(corpus)
    rows = lines.dedup_lines(repeated).collect()
    assert len(rows) == 2 * len(corpus) + 1
    for r in rows:
        assert r.n_removed == (0 if r.doc_id is None else sum(i == r.doc_id for i, _ in gone))


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        most = rng.randint(0, 9)
        assert lines.edit_distance(a, b, most) == min(slow_distance(a, b), most + 1)


def test_simhash_planes_agree_with_sums():
    rng = np.random.default_rng(5)
    sizes = np.array([1, 2, 3, 9, 64, 700, 5])
    words = rng.integers(0, 1 << 63, sizes.sum()).astype(np.uint64)
    signs = lines.simhash(words, sizes)
    at = 0
    for k, n in enumerate(sizes):
        bits = np.unpackbits(lines._wide(words[at : at + n]).view(np.uint8), axis=1, bitorder="little").sum(0)
        at += n
        assert np.unpackbits(signs[k].copy().view(np.uint8), bitorder="little").tolist() == (2 * bits > n).astype(int).tolist()


def test_radius_holds_similar_lines():
    rng = random.Random(31)
    for n in (5, 10, 20, 40, 150):
        held = 0
        for _ in range(200):
            one = sentence(rng, n).split()
            two = spoiled(rng, one, 0.2)
            most = decontam.allowed_edits(max(len(one), len(two)))
            known = lines.normal_hashes(lines.pa.array([" ".join(one), " ".join(two)]))
            owner, kinds = lines.by_line(known.line, known.hashes)
            size = np.bincount(owner)
            sim = lines.simhash(kinds, size)
            apart = np.bitwise_count(sim[0] ^ sim[1]).sum()
            held += apart <= lines.radius(np.array([most]), size[:1], size[1:])[0]
        assert held >= 198


# Suffixes


def slow_repeats(corpus, length):
    seen, out = set(), {}
    for i, t in sorted(corpus, key=lambda x: x[0]):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = True
            seen.add(window)
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[i] = (bytes(np.frombuffer(data, np.uint8)[~gone]), list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist())))
    return out


def test_repeats(docs, corpus, crowded, nothing, monkeypatch):
    want = slow_repeats(corpus, suffixes.LENGTH)
    got = {r.doc_id: r for r in suffixes.remove_repeats(crowded).collect()}
    assert len(got) == len(corpus)
    for i, (kept, spans) in want.items():
        assert bytes(got[i].kept) == kept, i
        assert [(s.start, s.end) for s in got[i].spans] == spans
        assert got[i].n_removed == got[i].n_bytes - len(kept)
    assert suffixes.remove_repeats(nothing).count() == 0


def test_repeats_of_repeated_rows(repeated, corpus):
    want = slow_repeats(corpus, suffixes.LENGTH)
    rows = suffixes.remove_repeats(repeated).collect()
    assert len(rows) == 2 * len(corpus) + 1
    for r in rows:
        assert r.doc_id is None or bytes(r.kept) == want[r.doc_id][0]


def test_repeats_of_texts_that_share_an_id_and_of_rows_without_one(spark):
    rng = random.Random(19)
    a, b, c = (sentence(rng, 40) for _ in range(3))
    rows = [(1, a), (2, b), (2, "front " + a + " behind"), (None, b + " more"), (None, c), (3, c), (2, b)]
    got = sorted((str(r.doc_id), bytes(r.kept).decode(), len(r.spans)) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    own = [("1", a, 0), ("2", b, 0), ("2", b, 0), ("2", "front  behind", 1), ("3", c, 0), ("None", " more", 1), ("None", "", 1)]
    assert [(i, n) for i, _, n in got] == [(i, n) for i, _, n in sorted(own)]
    assert {k for i, k, n in got if not n} == {a, b, c} and any(k.startswith("front ") and len(k) < 20 for _, k, n in got if n)


@pytest.mark.parametrize("n", [2000])
def test_repeats_of_many_rows_without_an_id_and_under_one(spark, n):
    """Each row has one of 40 passages: all of them are left once, whatever the rows' ids."""
    rng = random.Random(29)
    passages = [sentence(rng, 30) for _ in range(40)]
    rows = [(i, f"{sentence(rng, 2)} {rng.choice(passages)} {sentence(rng, rng.randint(1, 12))}") for i in [None] * n + [5] * n + list(range(20))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = [((r.doc_id, r.tag), r.text) for r in identified(table).collect()]
    want = Counter((None if i == NO_ID else i, kept, len(spans)) for (i, _), (kept, spans) in slow_repeats(known, suffixes.LENGTH).items())
    assert Counter((r.doc_id, bytes(r.kept), len(r.spans)) for r in suffixes.remove_repeats(table).collect()) == want


def test_links_of_texts_that_share_an_id_and_of_rows_without_one(spark):
    rng = random.Random(23)
    a, b = sentence(rng, 60), sentence(rng, 60)
    rows = [(5, a), (5, b), (7, a + " tail"), (9, b + " tail"), (None, a), (None, sentence(rng, 30))]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (7, 5), (9, 5), (None, 5), (None, None)], key=str)


def test_stretches_of_long_texts():
    rng = random.Random(8)
    text = sentence(rng, 400).encode()
    keep = suffixes.STRETCH
    suffixes.STRETCH = 500
    try:
        parts = [p for part in suffixes._parts([((1, 0), text)], 100) for p in part]
    finally:
        suffixes.STRETCH = keep
    windows = [at + k for _, at, t in parts for k in range(len(t) - 99)]
    assert sorted(windows) == list(range(len(text) - 99)) and all(text[at : at + len(t)] == t for _, at, t in parts)


def test_suffix_sort():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 2, 2000).astype(np.uint8)
    order = suffixes.SuffixOrder(data, 20)
    starts, ends = np.arange(1900), np.array([1, 2, 5, 100, 101, 900, 1900])
    got = order.sort(starts, ends)
    classes = order.classes(got, ends)
    a = 0
    for e in ends.tolist():
        assert got[a:e].tolist() == sorted(range(a, e), key=lambda p: (bytes(data[p : p + 20]), p))
        for k in range(a + 1, e):
            same = bytes(data[got[k] : got[k] + 20]) == bytes(data[got[k - 1] : got[k - 1] + 20])
            assert (classes[k] == classes[k - 1]) == same
        a = e


def test_sort_of_one_large_group():
    """A passage in 40,000 documents, each with a byte of its own: the cost of a window does not grow with its group."""
    rng = np.random.default_rng(2)
    n, width = 40_000, 168
    data = np.tile(rng.integers(97, 123, width).astype(np.uint8), (n, 1))
    data[np.arange(n), rng.integers(0, width, n)] = rng.integers(0, 256, n)
    windows, began = np.arange(n) * width + 30, time.process_time()
    got = suffixes.SuffixOrder(data.reshape(-1), 100).sort(windows, np.array([n]))
    assert time.process_time() - began < 2
    assert got.tolist() == sorted(windows.tolist(), key=lambda p: (data.reshape(-1)[p : p + 100].tobytes(), p))


def test_collisions_are_seen(monkeypatch):
    """With a hash that holds all stretches for equal the bytes alone decide the classes."""
    data = np.frombuffer(b"abcdabceabcd", np.uint8)
    order = suffixes.SuffixOrder(data, 4)
    monkeypatch.setattr(order.hashes, "of", lambda start, count: np.zeros(len(start), np.uint64))
    assert order.classes(np.array([0, 8, 4]), np.array([3])).tolist() == [0, 0, 1]


# Jaccard


def slow_sets(corpus):
    out = {}
    for i, t in corpus:
        words = lower_words_of(t)
        out[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()
    return out


def slow_jaccard(corpus):
    sets = slow_sets(corpus)
    ids = sorted(sets)
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if sets[ids[a]] and 100 * len(sets[ids[a]] & sets[ids[b]]) >= 80 * len(sets[ids[a]] | sets[ids[b]])]
    found = groups(len(ids), pairs)
    return {i: (len(sets[i]), ids[found[k]]) for k, i in enumerate(ids)}


def test_jaccard(docs, corpus, crowded, nothing):
    want = slow_jaccard(corpus)
    assert len({c for _, c in want.values()}) < len(want)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(crowded).collect()}
    assert got == want
    kept = jaccard.keep_one(crowded)
    assert kept.columns == crowded.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}
    assert jaccard.jaccard_components(nothing).count() == 0


@pytest.mark.parametrize(("block", "crowd"), [(16_000, 32), (7, 1 << 40), (7, 3), (16_000, 2)])
def test_jaccard_of_chains_and_crowds(spark, monkeypatch, block, crowd):
    """Chains of near copies, a large near group without a common original, and frequent passages in all texts."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    rng = random.Random(21)
    rows, passage = [], sentence(rng, 40)
    text = sentence(rng, 120).split(" ")
    for k in range(25):  # each like the one before, the last unlike the first
        text = list(text)
        for p in range(2):
            text[(5 * k + p) % 120] = sentence(rng, 1)
        rows.append((k, " ".join(text)))
    origin = sentence(rng, 150)
    rows += [(100 + k, edited(rng, origin, 0.025)) for k in range(40)]
    rows += [(200 + k, sentence(rng, 30) + " " + passage + " " + sentence(rng, 10)) for k in range(40)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == slow_jaccard(rows)


def test_jaccard_of_repeated_rows(repeated, corpus):
    want = slow_jaccard(corpus)
    rows = jaccard.jaccard_components(repeated).collect()
    assert len(rows) == 2 * len(corpus) + 1
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in rows if r.doc_id is not None)


def test_pairs_of_near_copies_are_not_written_out():
    """Near copies that pivots have linked give no pair; others only those that distances to pivots allow."""
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.permutation(400)[:380]], rng.integers(0, 1 << 63, 5).astype(np.uint64)])) for _ in range(300)]
    jac = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    far = [np.array([1 - jac(x, sets[k]) for k in range(jaccard.PIVOTS)], "<f4").tobytes() for x in sets]
    one = np.zeros(300, np.int64)
    assert list(jaccard.pairs_to_count(sets, [True] * 300, one, far, 0.2)) == []
    one[[7, 250]] = -1
    told = {(at, int(w)): int(c) for at, with_whom, counts in jaccard.pairs_to_count(sets, [True] * 300, one, far, 0.20001) for w, c in zip(with_whom, counts)}
    assert all(7 in p or 250 in p for p in told)
    for a in range(300):
        for b in range(a):
            if (one[a] < 0 or one[b] < 0) and jac(sets[a], sets[b]) >= 0.8:
                assert told[a, b] == len(np.intersect1d(sets[a], sets[b]))


def test_fragment_sizes_bound_overlaps():
    rng = np.random.default_rng(9)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 1 << 63, rng.integers(1, 60)).astype(np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([b[:3], a[: rng.integers(0, len(a) + 1)]]))
        union = len(np.union1d(a, b))
        if 100 * len(np.intersect1d(a, b)) >= 80 * union:
            assert jaccard.may_link(jaccard.bucket_sizes(a), len(a), jaccard.bucket_sizes(b)[None], np.array([len(b)]), 80)[0]


@pytest.mark.parametrize("m", [1, 2, 5, 9, 40])
def test_overlaps(m):
    rng = np.random.default_rng(m)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(m)]
    asked = [bool(rng.integers(0, 4)) for _ in sets]
    got = list(jaccard.overlaps_with_earlier(sets, asked))
    assert [at for at, _ in got] == [k for k in range(m) if asked[k]]
    for at, counts in got:
        assert counts.tolist() == [len(np.intersect1d(sets[at], sets[j])) for j in range(at)]


# Benchmark


def test_contamination(spark):
    rng = random.Random(6)
    items = [(k, sentence(rng, rng.randint(12, 50))) for k in range(40)] + [(90, "a b c"), (91, None), (92, "")]
    rows, planted = [], set()
    for k in range(40):
        words = items[k][1].split(" ")
        edits = int(0.1 * len(words))
        for p in rng.sample(range(len(words)), edits):
            words[p] = sentence(rng, 1)
        rows.append((k, sentence(rng, 50) + "\n" + " ".join(words).upper() + ". " + sentence(rng, 30)))
        planted.add((k, k))
    rows += [(100 + k, sentence(rng, 120)) for k in range(40)] + [(500, None), (501, ""), (502, items[3][1] + " " + items[3][1])]
    planted.add((502, 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_contamination(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted
    texts = dict(rows)
    for r in got:
        stretch = decontam.item_words(texts[r.doc_id])[r.start_word : r.end_word]
        item = decontam.item_words(items[r.item_id][1])
        assert slow_distance(item, stretch) == r.edits and abs(r.similarity - (1 - r.edits / len(item))) < 1e-12
    again = decontam.find_contamination(docs, bench, block_items=7).collect()
    assert {(r.doc_id, r.item_id) for r in again} == planted
    assert {r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()} == {i for i, _ in rows} - {i for i, _ in planted}
    assert decontam.find_contamination(docs, bench.limit(0)).count() == 0
    assert decontam.find_contamination(docs.limit(0), bench).count() == 0
    assert decontam.find_contamination(docs.unionByName(docs), bench).count() == 2 * len(planted)


def test_all_documents_against_all_items():
    """Every (document, item) pair by plain edit distance over all stretches; what is found is all there is."""
    rng = random.Random(16)
    usual = [sentence(rng, 1) for _ in range(25)]
    line = lambda n: [rng.choice(usual) for _ in range(n)]
    items = [line(rng.choice((5, 6, 9, 10, 14, 20, 23))) for _ in range(25)]
    texts = []
    for k in range(60):
        words = line(rng.randint(0, 25))
        if k % 2:
            planted = list(rng.choice(items))
            for _ in range(rng.randint(0, int(0.3 * len(planted)))):
                planted[rng.randrange(len(planted)) :][:1] = [rng.choice(usual)]
                p = rng.randrange(len(planted))
                planted[p : p + rng.randint(0, 1)] = line(rng.randint(0, 1))
            at = rng.randint(0, len(words))
            words[at:at] = planted
        texts.append(" ".join(words))
    index = decontam.ItemIndex([(k, " ".join(x)) for k, x in enumerate(items)])
    got = {(r, i): e for r, i, _, _, e in decontam.search_documents(texts, index)}
    want = {}
    for r, t in enumerate(texts):
        words = t.split()
        for i, item in enumerate(items):
            row = [0] * (len(words) + 1)
            for a, x in enumerate(item):
                new = [a + 1]
                for b, y in enumerate(words):
                    new.append(min(row[b] + (x != y), row[b + 1] + 1, new[b] + 1))
                row = new
            if min(row) <= decontam.allowed_edits(len(item)):
                want[r, i] = min(row)
    assert len(want) >= 25 and set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(got[k] == want[k] for k in got)


@pytest.mark.parametrize("n", [5, 9, 10, 14, 20, 60, 200, 500])
def test_recall_at_the_bound(n):
    rng = random.Random(13)
    items = [(k, sentence(rng, n)) for k in range(60)]
    index = decontam.ItemIndex(items)
    texts = []
    for _, t in items:
        words = t.split(" ")
        for _ in range(decontam.allowed_edits(len(words))):
            p = rng.randrange(len(words))
            kind = rng.random()
            if kind < 0.6:
                words[p] = sentence(rng, 1)
            elif kind < 0.8:
                words.insert(p, sentence(rng, 1))
            else:
                del words[p]
        texts.append(sentence(rng, 20) + " " + " ".join(words) + " " + sentence(rng, 20))
    found = {(r, i) for r, i, *_ in decontam.search_documents(texts, index)}
    assert sum((k, k) in found for k in range(60)) >= 0.95 * 60


def test_many_items_take_little_memory():
    """An index of 4,096 items is small."""
    import tracemalloc

    rng = random.Random(20)
    items = [(k, sentence(rng, 30)) for k in range(decontam.BLOCK_ITEMS)]
    tracemalloc.start()
    decontam.ItemIndex(items)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 300 << 20


@pytest.mark.parametrize(("n", "subs", "dels", "least"), [(20, 0, 1, 0.98), (20, 2, 2, 0.95), (40, 4, 4, 0.95), (100, 10, 10, 0.95)])
def test_recall_where_a_document_ends(n, subs, dels, least):
    """Passages that end a document, and whole documents with fewer words than their item, are found as others are."""
    rng = random.Random(14)
    items = [(k, sentence(rng, n)) for k in range(150)]
    index = decontam.ItemIndex(items)
    for before in (40, 0):
        texts = []
        for _, t in items:
            words = t.split(" ")
            for p in rng.sample(range(n), subs):
                words[p] = sentence(rng, 1)
            for _ in range(dels):
                del words[rng.randrange(len(words))]
            texts.append((sentence(rng, before) + " " if before else "") + " ".join(words))
        found = {(r, i) for r, i, *_ in decontam.search_documents(texts, index)}
        assert sum((k, k) in found for k in range(150)) >= least * 150


def test_rows_are_dropped_by_their_own_text(spark):
    """Null and repeated ids, clashing names: a row goes for its own text, whatever other rows have."""
    rng = random.Random(15)
    item, clean = sentence(rng, 20), sentence(rng, 60)
    rows = [(None, "before " + item), (None, clean), (7, item), (7, clean), (8, None), (9, "")]
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, _row string")
    bench = spark.createDataFrame([(1, item), (2, sentence(rng, 30))], "item_id long, text string")
    out = decontam.drop_contaminated(docs, bench)
    assert out.schema == docs.schema
    assert {tuple(r) for r in out.collect()} == {(*r, "own") for r in rows if not (r[1] and item in r[1])}
    assert {tuple(r) for r in decontam.drop_contaminated(docs, bench.limit(0)).collect()} == {(*r, "own") for r in rows}


def test_edit_search():
    rng = random.Random(3)
    for _ in range(600):
        a = [rng.choice("abc") for _ in range(rng.randint(1, 8))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        d, s, e = decontam.best_stretch(a, b)
        assert d == min(slow_distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert d == len(a) or slow_distance(a, b[s:e]) == d


def test_schema_is_shared():
    assert SCHEMA.startswith("doc_id long")


def test_indexes_are_built_once_for_much_text(spark, monkeypatch):
    """More blocks of items than a worker holds: each index is built once for a load of text, not once for each batch."""
    rng = random.Random(31)
    items = [(k, sentence(rng, 12)) for k in range(13)]
    texts = [f"{sentence(rng, 20)} {rng.choice(items)[1]} {sentence(rng, 5)}" for _ in range(60)]
    batches = [decontam.pa.RecordBatch.from_arrays([decontam.pa.array(texts[k : k + 3])], names=["text"]) for k in range(0, 60, 3)]
    built = []

    class Counted(decontam.ItemIndex):
        def __init__(self, *args):
            built.append(1)
            super().__init__(*args)

    monkeypatch.setattr(decontam, "ItemIndex", Counted)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    told = lambda blocks: [sorted(x[:2] for x in found) for _, found in blocks.searched(iter(batches), "text", 1 << 20)]
    one = told(decontam.ItemBlocks(benchmark, 0.8, 5, 100))
    assert len(built) == 1 and sum(map(len, one)) >= 60
    built.clear()
    blocks = decontam.ItemBlocks(benchmark, 0.8, 5, 2)
    assert told(blocks) == one and blocks.count == 7 and len(built) == 7
    monkeypatch.setattr(decontam, "TEXT_HELD", sum(b.nbytes for b in batches) // 4)
    built.clear()
    assert told(decontam.ItemBlocks(benchmark, 0.8, 5, 2)) == one and len(built) <= 7 + 4 * (7 - decontam.HELD)
