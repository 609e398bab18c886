"""Exact token counts at every prefix of a text, by dynamic programming over its pieces.

A byte-level BPE never merges across pre-tokens, so the count of a prefix is the count of the pieces before it plus
that of a prefix of one piece. Within a pre-token one pass over its bytes finds the counts of all its prefixes: the
encoding of a prefix is that of a shorter prefix and one token more, and it is the one token that stays whole beside
the shorter prefix's last token. So prefix i takes one more than prefix j for the token [j, i) that fits there,
and no prefix is ever encoded. Sums at piece ends and tables within pieces answer questions of length, truncation
and budget by look-up. A run of white space and the pre-token behind it make one piece, as how the run splits
depends on what follows; no other cut does.

The pieces that texts share are counted once per worker.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, tidy

VOCABULARY = "byte_bpe_50k.json"
#: Pieces remembered by a worker before it starts anew; bounds its memory.
REMEMBERED = 500_000
LONGEST_REMEMBERED = 64


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """A byte-level BPE vocabulary, with memory by pre-token.

    `path` is a .json file of the `tokenizers` library; its special strings and ids hold. The merging is done by
    tiktoken on the same vocabulary as ranks, in the file of the same name beside it, which gives the same ids
    several times as fast; tests hold the two against each other.
    """

    def __init__(self, path: str):
        import base64
        import json

        import public_tokenizers
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.special = {t["content"]: t["id"] for t in added}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.plain = regex.compile(public_tokenizers.PATTERN).findall
        self.ranks = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.single = self.ranks._core_bpe.encode_single_piece
        self.bytes_of = ranks
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        #: Prefix of a pre-token -> its tokens, and the last of them.
        self.states: dict[bytes, tuple[int, bytes]] = {b"": (0, b"")}
        self.known: dict[str, int] = {}
        self.prefixes: dict[str, tuple[int, ...]] = {}

    def count(self, text: str) -> int:
        """Tokens of a stretch without special strings."""
        return len(self.ranks.encode_ordinary(text))

    def ids(self, text: str) -> np.ndarray:
        """All ids of a text, special strings as single ids."""
        parts = [np.array([self.special[x]], np.uint32) if special else np.asarray(self.ranks.encode_to_numpy(x, disallowed_special=()), np.uint32) for x, special in self.segments(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """Stretches of text and special strings in turn; the library treats the latter as single tokens."""
        if self.split_special is None or not any(s in text for s in self.special):
            return [(text, False)] if text else []
        return [(x, x in self.special) for x in self.split_special.split(text) if x]

    def counts(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for p in set(pieces).difference(known):
            known[p] = self.last_count(p.encode("utf-8", "surrogatepass"))
        out = list(map(known.__getitem__, pieces))
        if max(map(len, pieces), default=0) > LONGEST_REMEMBERED:
            for p in pieces:
                if len(p) > LONGEST_REMEMBERED:
                    known.pop(p, None)
        return out

    def cut(self, text: str) -> tuple[list[str], list[int]]:
        """Pre-tokens and special strings of a text, and the tokens of each."""
        pieces: list[str] = []
        counts: list[int] = []
        for part, special in self.segments(text):
            plain = [part] if special else self.plain(part)
            pieces += plain
            counts += [1] if special else self.counts(plain)
        return pieces, counts

    def stays(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens side by side are encoded as they are; an empty one on the left asks for the right one alone."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            want = [self.bytes_of[t] for t in (left, right) if t]
            self.pairs[left, right] = known = self.single(left + right) == want
        return known

    def table(self, data: bytes) -> list[int]:
        """Entry i: tokens of the first i bytes of a pre-token. last[i] is the last token of that prefix."""
        ranks, longest = self.bytes_of, self.longest
        counts, last = [0] * (len(data) + 1), [b""] * (len(data) + 1)
        for i in range(1, len(data) + 1):
            for j in range(max(0, i - longest), i):
                token = data[j:i]
                if token in ranks and self.stays(last[j], token):
                    counts[i], last[i] = counts[j] + 1, token
                    break
            else:
                raise ValueError("no token fits: the vocabulary lacks single bytes")
        return counts

    def last_count(self, data: bytes) -> int:
        """The table's last entry; tables of pre-tokens that begin alike share what they have in common."""
        if len(data) > LONGEST_REMEMBERED:
            return self.table(data)[-1]
        states, ranks, longest = self.states, self.bytes_of, self.longest
        if len(states) > REMEMBERED:
            states.clear()
            states[b""] = 0, b""
        k = len(data)
        while data[:k] not in states:
            k -= 1
        for i in range(k + 1, len(data) + 1):
            for j in range(max(0, i - longest), i):
                token = data[j:i]
                if token in ranks:
                    n, last = states[data[:j]]
                    if self.stays(last, token):
                        states[data[:i]] = n + 1, token
                        break
            else:
                raise ValueError("no token fits: the vocabulary lacks single bytes")
        return states[data][0]

    def chars(self, piece: str) -> list[int]:
        """The same at each character."""
        counts = self.table(piece.encode("utf-8", "surrogatepass"))
        if len(counts) == len(piece) + 1:
            return counts
        return [counts[k] for k in accumulate((len(c.encode("utf-8", "surrogatepass")) for c in piece), initial=0)]

    def piece_prefixes(self, piece: str) -> tuple[int, ...]:
        """Entry k: tokens of the first k characters of a piece - white space and the pre-token behind it - taken as a whole text."""
        got = self.prefixes.get(piece)
        if got is None:
            *blanks, behind = self.plain(piece)
            white = "".join(blanks)
            if not white and behind.startswith("'") and len(behind) <= 3:  # a contraction: its prefixes are cut elsewhere
                got = tuple(self.count(piece[:k]) for k in range(len(piece) + 1))
            elif not white:
                got = tuple(self.chars(behind))
            else:
                # white space alone is one pre-token; with something behind it, it is cut as it is in the piece
                run = white + behind[0] if behind[0] == " " or behind.isspace() else white
                before = sum(len(self.single(b.encode("utf-8", "surrogatepass"))) for b in blanks)
                told = self.chars(run)
                inner = self.count_contraction(behind) or self.chars(behind)
                got = tuple(told) + tuple(before + n for n in inner[len(run) - len(white) + 1 :])
            if len(piece) <= LONGEST_REMEMBERED:
                if len(self.prefixes) > REMEMBERED // 10:
                    self.prefixes.clear()
                self.prefixes[piece] = got
        return got

    def count_contraction(self, behind: str) -> list[int] | None:
        return [self.count(behind[:k]) for k in range(len(behind) + 1)] if behind.startswith("'") and len(behind) <= 3 else None


class PrefixCounts:
    """Token counts of all prefixes of one text: stored sums at piece ends, a remembered table inside a piece."""

    def __init__(self, pieces: Pieces, text: str):
        self.pieces, self.text = pieces, text
        self.parts: list[tuple[str, bool]] = []
        for part, special in pieces.segments(text):
            self.parts += [(part, True)] if special else [(x, False) for x in held_together(pieces.plain(part))]
        self.ends = [0, *accumulate(len(p) for p, _ in self.parts)]
        self.sums = [0, *accumulate(1 if special else pieces.piece_prefixes(p)[-1] for p, special in self.parts)]

    def __len__(self) -> int:
        return self.sums[-1]

    def at(self, chars: int) -> int:
        """Tokens of text[:chars]. A cut inside a special string leaves ordinary text, which may lengthen the piece before it but none before that."""
        k = bisect_right(self.ends, chars) - 1
        if k >= len(self.parts) or self.ends[k] == chars:
            return self.sums[k]
        piece, special = self.parts[k]
        if not special:
            return self.sums[k] + self.pieces.piece_prefixes(piece)[chars - self.ends[k]]
        start = k - 1 if k and not self.parts[k - 1][1] else k
        cut = self.text[self.ends[start] : chars]
        return self.sums[start] + self.pieces.count(cut)

    def table(self) -> list[int]:
        """Entry k: tokens of the first k characters."""
        out = [0]
        for k, (p, special) in enumerate(self.parts):
            out += [self.at(self.ends[k] + c) for c in range(1, len(p) + 1)] if special else [self.sums[k] + n for n in self.pieces.piece_prefixes(p)[1:]]
        return out

    def longest_within(self, budget: int) -> int:
        """The most characters whose prefix has at most `budget` tokens."""
        k = bisect_right(self.sums, budget) - 1
        if k >= len(self.parts):
            return len(self.text)
        return max(c for c in range(self.ends[k], self.ends[k + 1]) if self.at(c) <= budget)


def held_together(plain: list[str]) -> list[str]:
    """Join each run of white space with the pre-token behind it."""
    out: list[str] = []
    held = ""
    for p in plain:
        if p.isspace():
            held += p
        else:
            out.append(held + p)
            held = ""
    if held:
        out.append(held)
    return out


_open: dict[str, Pieces] = {}


def pieces_for(path: str) -> Pieces:
    if path not in _open:
        _open[path] = Pieces(path)
    return _open[path]


def cut_within(pieces: Pieces, parts: list[str], sums: np.ndarray, budget: int) -> int:
    """The most characters whose prefix has at most `budget` tokens, from sums at the ends of pre-tokens.

    Sums never fall, so it ends in the first pre-token that goes beyond the budget, or in the white space before it.
    """
    k = int(np.searchsorted(sums, budget, side="right"))
    if k == len(parts):
        return sum(map(len, parts))
    if parts[k] in pieces.special:
        return _before(parts, k)
    a = k
    while a and parts[a - 1].isspace():
        a -= 1
    b = k + 1
    while b < len(parts) and parts[b - 1].isspace() and parts[b] not in pieces.special:
        b += 1
    before, base = _before(parts, a), int(sums[a - 1]) if a else 0
    told = pieces.piece_prefixes("".join(parts[a:b]))
    return before + max(c for c, n in enumerate(told) if base + n <= budget)


def _before(parts: list[str], k: int) -> int:
    return sum(map(len, parts[:k]))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, budgets: tuple[int, ...] = (512,), tables: bool = False, cuts: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens; for each budget `over`, and with cuts=True `cuts`, the most characters
    from the start that fit it (in front of a special string that does not fit, nothing of it); with tables=True also
    `prefixes`: entry k is the tokens of the first k characters.

    Null and empty texts have 0 bytes, 0 tokens and one prefix. Special strings in a text count as the
    library's default has them. Texts are taken whole, whatever their length.
    """
    names = ["doc_id", "n_bytes", "n_tokens", *(("cuts",) if cuts else ()), *(("prefixes",) if tables else ())]

    def run(batches):
        pieces = pieces_for(vocabulary_path(vocabulary))
        ints = pa.list_(pa.int64())
        for batch in batches:
            sizes, counts, places, prefixes = [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                parts, each = pieces.cut(text)
                sums = np.cumsum(np.array(each, np.int64))  # the table at each pre-token's end
                counts.append(int(sums[-1]) if len(sums) else 0)
                if cuts:
                    places.append([cut_within(pieces, parts, sums, b) for b in budgets])
                if tables:
                    prefixes.append(PrefixCounts(pieces, text).table())
            more = [pa.array(x, ints) for x, asked in ((places, cuts), (prefixes, tables)) if asked]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), *more], names=names)

    schema = "doc_id long, n_bytes long, n_tokens long" + (", cuts array<long>" if cuts else "") + (", prefixes array<long>" if tables else "")
    out = doc_columns(docs).mapInArrow(tidy(run), schema)
    return out.withColumn("over", F.transform(F.array(*map(F.lit, budgets)), lambda b: F.col("n_tokens") > b))
