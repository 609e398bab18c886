"""Secret scans: three plain patterns, and a guess-cost test of values in credential context.

A value behind a credential word is kept when guessing it would be dear. Its cost is the cheapest
way to write it as a row of segments - known words, dates, repeats, keyboard walks, sequences,
or plain brute force - found by dynamic programming over its characters. Known are words that guessers try first,
then the most frequent words of the documents themselves, then those of the token vocabulary, each by its rank.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, doc_columns, tidy
from .tokens import vocabulary_path

KINDS = ("assign", "access", "hex", "guess")

#: The three base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words of credential context beyond those of ASSIGN, and what may stand between them and a value.
CONTEXT_WORDS = ("pwd", "passphrase", "credential", "credentials", "auth", "bearer", "private_key", "access_key", "client_key", "signing_key", "pin", "pass", *ASSIGN_WORDS)
CONTEXT = re.compile(r"""(?<![A-Za-z0-9])(?:[a-z0-9]{1,20}[_-]){0,3}(?:""" + "|".join(sorted(CONTEXT_WORDS, key=len, reverse=True)) + r""")["']?[\x20\t]*(?:[:=]|=>|\x20is\x20)[\x20\t]*(["']?)([^\s"'<>]{6,})""", re.I | re.A)
#: log10 of the guesses from which on a value counts as a secret.
LEAST_COST = 8.0

#: Words that guessers try first, by rough rank.
COMMON_WORDS = """password admin letmein welcome monkey dragon master qwerty login princess football shadow sunshine
iloveyou trustno secret hello freedom whatever superman batman michael jordan hunter ranger soccer baseball summer
winter spring autumn love angel flower test guest root user example changeme default system server database token
access private public account company office money computer internet google pass word key api dev prod staging
local home work family friend happy lucky star blue green black white orange purple silver golden the and for you
this that none null true false todo xxx your my is""".split()
RANK = {w: k + 1 for k, w in enumerate(COMMON_WORDS)}
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LEET = str.maketrans("431!05$7@", "aeiiossta")


def _neighbours() -> dict[str, set[str]]:
    """Keys next to each other on the rows, each row half a key to the right of the one above."""
    at = {ch: (r, c + 0.5 * r) for r, row in enumerate(KEY_ROWS) for c, ch in enumerate(row)}
    return {a: {b for b, (r2, c2) in at.items() if b != a and abs(r1 - r2) <= 1 and abs(c1 - c2) <= 1} for a, (r1, c1) in at.items()}


NEAR = _neighbours()
#: Fewest and most letters of a word that is known from documents, and how many such words are: what is broadcast is bounded.
LEAST_LETTERS, MOST_LETTERS, MOST_WORDS = 3, 32, 20_000


@lru_cache(maxsize=1)
def vocabulary_words() -> tuple[str, ...]:
    """Words of the token vocabulary in lower case by rank: tokens that begin a word and are four letters or more alone."""
    path = vocabulary_path().removesuffix(".json") + ".tiktoken"
    with open(path, "rb") as f:
        tokens = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    words = (token[1:].decode("utf-8", "ignore").lower() for _, token in tokens if token[:1] == b" ")
    return tuple(dict.fromkeys(w for w in words if len(w) > LEAST_LETTERS and w.isalpha()))


def ranks_of(words: tuple[str, ...] = ()) -> dict[str, int]:
    """Word -> rank: common words first, then `words`, the documents' own by frequency, then the token vocabulary's."""
    out = dict(RANK)
    for w in (*words, *vocabulary_words()):
        out.setdefault(w, len(out) + 1)
    return out


@lru_cache(maxsize=4)
def _ranks(words: tuple[str, ...]) -> dict[str, int]:
    return ranks_of(words)


def frequent_words(docs: DataFrame, most: int = MOST_WORDS) -> tuple[str, ...]:
    """The `most` most frequent words of letters a-z of all documents, counted in whole; of equal counts the first by alphabet."""

    def run(batches):
        for batch in chunks(batches, limit=8 << 20):
            words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column(1), ""))).flatten()
            told = pc.value_counts(words)
            word, n = told.field(0), told.field(1)
            letters = pc.match_substring_regex(word, f"^[a-z]{{{LEAST_LETTERS},{MOST_LETTERS}}}$")
            yield pa.RecordBatch.from_arrays([word.filter(letters).cast(pa.string()), n.filter(letters)], names=["word", "n"])

    counts = doc_columns(docs).mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return tuple(r[0] for r in counts.orderBy(F.desc("n"), "word").limit(most).select("word").collect())


#: No segment but runs is longer: words, dates, units said twice.
LONGEST_SEGMENT = 32
#: Units said twice are compared one by one up to this length, longer ones by where equal stretches begin.
LONGEST_UNIT = 16
YEARS = range(1900, 2051)


def _class_size(piece: str) -> int:
    size = 0
    for probe, n in ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10)):
        if any(map(probe, piece)):
            size += n
    return size + (33 if any(not c.isalnum() for c in piece) else 0) or 26


def _is_date(digits: str) -> bool:
    if len(digits) == 4 and int(digits) in YEARS:
        return True
    if len(digits) in (6, 8):
        for y, m, d in ((slice(0, -4), slice(-4, -2), slice(-2, None)), (slice(4, None), slice(0, 2), slice(2, 4)), (slice(4, None), slice(2, 4), slice(0, 2))):
            if 1 <= int(digits[m]) <= 12 and 1 <= int(digits[d]) <= 31 and (len(digits) == 6 or int(digits[y]) in YEARS):
                return True
    return False


def guess_cost(value: str, enough: float = math.inf, words: tuple[str, ...] = ()) -> float:
    """log10 of the guesses of the cheapest segmentation. best[i] covers value[:i]; a segment adds its own log10.

    A cost of `enough` or more may be given too low, but not below `enough`.
    """
    return (_remembered_cost if len(value) <= LONGEST_REMEMBERED else _cost)(value, enough, words)


class _Runs:
    """The least of best[j] + first + c log10(i - j) over all places j where a run that ends at i may be cut, without a look at each.

    Of two places the later is better at first, but falls behind for good as the run grows. So a stack holds the
    places that are still to be best, each with the end from which on the one below it is.
    """

    def __init__(self, kind: str, per_char: float):
        self.first = run_cost(kind, 1, per_char)
        self.c = run_cost(kind, 10, per_char) - self.first
        self.places: list[int] = []
        self.ends: list[float] = []
        self.begin = -1

    def _overtaken(self, one: int, other: int, best: list[float]) -> float:
        """The end from which on a cut at `one` is as cheap as a later one at `other`."""
        more = best[other] - best[one]
        if more <= 0:
            return math.inf
        ratio = 10 ** min(more / self.c, 300)
        return (ratio * other - one) / (ratio - 1) if ratio > 1 else math.inf

    def least(self, i: int, begin: int, best: list[float]) -> float:
        """For the run from `begin` to i; ends are asked for one after another."""
        if begin != self.begin:
            self.places, self.ends, self.begin = [], [], begin
        if i - 3 < begin:
            return math.inf
        places, ends, new = self.places, self.ends, i - 3
        while places:
            end = self._overtaken(places[-1], new, best)
            if end < ends[-1]:
                break
            places.pop()  # overtaken by the one below before it would be best again
            ends.pop()
        if not places or end > i:
            places.append(new)
            ends.append(end if len(places) > 1 else math.inf)
        while len(places) > 1 and ends[-1] <= i:
            places.pop()
            ends.pop()
        return best[places[-1]] + self.first + self.c * math.log10(i - places[-1])


class _LongUnits:
    """Units beyond LONGEST_UNIT that are said twice, in values of any length. `units` are lengths that may be: equal stretches begin so
    far apart. While the end moves on, each knows for how many characters the value has been what it was a unit before."""

    def __init__(self, low: str):
        n, size = len(low), LONGEST_UNIT + 1
        at: dict[str, list[int]] = {}
        for k in range(n - size + 1 if n >= 2 * size else 0):
            at.setdefault(low[k : k + size], []).append(k)
        several = [np.array(places) for places in at.values() if len(places) > 1]
        if sum(len(p) ** 2 for p in several) > 64 * n:
            units = np.arange(size, n // 2 + 1)  # more pairs of places than lengths
        else:
            units = np.unique(np.concatenate([(p[None, :] - p[:, None]).ravel() for p in several])) if several else np.zeros(0, np.int64)
        self.units = units[(units >= size) & (2 * units <= n)]
        self.runs, self.low = np.zeros(len(self.units), np.int64), np.array([ord(c) for c in low], np.int32) if len(self.units) else None
        self.best = np.zeros(n + 1) if len(self.units) else None

    def least(self, i: int) -> float:
        """The least cost of what stands before a second saying that ends at i; called for each i in turn."""
        there = self.units[: int(np.searchsorted(self.units, i - 1, side="right"))]
        runs = self.runs[: len(there)]
        runs += 1
        runs[self.low[i - 1] != self.low[i - 1 - there]] = 0
        said = there[runs >= there]
        return float(self.best[i - said].min()) if len(said) else math.inf


def _cost(value: str, enough: float, words: tuple[str, ...]) -> float:
    n = len(value)
    ranks = _ranks(words)
    above = 0  # positions up to i that cost enough already
    low = value.lower()
    if len(low) != n:  # a letter whose lower case is two
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    per_char = math.log10(_class_size(value))
    best = [0.0] + [math.inf] * n
    long = _LongUnits(low)
    runs = [_Runs(kind, per_char) for kind in ("same", "walk", "step")]
    # runs that end at i: as far back as each character continues what was before it
    same = [0] * (n + 1)
    walk = [0] * (n + 1)
    step = [0] * (n + 1)
    for i in range(1, n + 1):
        prev, here = (low[i - 2], low[i - 1]) if i > 1 else ("", low[0])
        same[i] = same[i - 1] + 1 if prev == here else 1
        walk[i] = walk[i - 1] + 1 if here in NEAR.get(prev, ()) else 1
        delta = ord(here) - ord(prev) if prev else 0
        before = ord(prev) - ord(low[i - 3]) if i > 2 else delta
        step[i] = (step[i - 1] + 1 if delta == before and abs(delta) == 1 else 2) if abs(delta) == 1 else 1
        cost = best[i - 1] + per_char  # one more character by brute force
        for length in range(3, min(LONGEST_SEGMENT, i) + 1):
            rank = ranks.get(low[i - length : i]) or ranks.get(plain[i - length : i])
            if rank:
                cost = min(cost, best[i - length] + word_cost(value[i - length : i], rank, low[i - length : i] in ranks))
        for length in (4, 6, 8):
            if length <= i and value[i - length : i].isascii() and value[i - length : i].isdigit() and _is_date(value[i - length : i]):
                cost = min(cost, best[i - length] + date_cost(length))
        for longest, run in ((same[i], runs[0]), (walk[i], runs[1]), (step[i], runs[2])):
            cost = min(cost, run.least(i, i - longest, best))
        for unit in range(2, min(LONGEST_UNIT, i // 2) + 1):
            if low[i - unit : i] == low[i - 2 * unit : i - unit]:
                cost = min(cost, best[i - unit] + UNIT_COST)
        if len(long.units):
            cost = min(cost, long.least(i) + UNIT_COST)
            long.best[i] = cost
        best[i] = cost
        above = above + 1 if cost >= enough else 0
        # every way on starts from one of these places, as no segment that goes on beyond i began before them
        if not len(long.units) and above > max(LONGEST_SEGMENT, same[i], walk[i], step[i]):
            return min(best[i + 1 - above : i + 1])
    return best[n]


def word_cost(piece: str, rank: int, as_it_is: bool) -> float:
    """log10 of guesses of a word: its rank, times ways to write it with capitals, times two where letters stand as digits."""
    letters = 1 if piece.islower() or not piece.isalpha() else 2 if piece.istitle() or piece.isupper() else 8
    return math.log10(rank * letters * (1 if as_it_is else 2) + 1)


def date_cost(length: int) -> float:
    return math.log10(150 if length == 4 else 55_000)


def run_cost(kind: str, run: int, per_char: float) -> float:
    """A repeated character: which, and how often; a keyboard walk: where from, which way at each turn; a sequence: where from and how long."""
    first = {"same": per_char, "walk": math.log10(40 * 4), "step": math.log10(40)}[kind]
    return first + math.log10(run) * (2 if first > per_char else 1)


UNIT_COST = math.log10(3)
LONGEST_REMEMBERED = 256
_remembered_cost = lru_cache(maxsize=20_000)(_cost)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three patterns, leftmost and non-overlapping for each kind by itself."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if _has_long_hex(text):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return out


_HEX_TABLE = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_LONG_HEX = b"\x01" * LEAST_HEX


def _has_long_hex(text: str) -> bool:
    return _LONG_HEX in text.encode("utf-8", "surrogatepass").translate(_HEX_TABLE)


def guessed_spans(text: str, base: list[tuple[int, int, str]], least: float = LEAST_COST, words: tuple[str, ...] = ()) -> list[tuple[int, int, str]]:
    """Values in credential context that cost at least 10^least guesses and that no base span touches."""
    low = text.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        value = m.group(2).rstrip(".,;:!?)]}")
        start, end = m.start(2), m.start(2) + len(value)
        if len(value) < 6 or any(s < end and start < e for s, e, _ in base):
            continue
        if guess_cost(value, least, words) >= least:
            out.append((start, end, "guess"))
    return out


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in in_order(spans))


def find_secrets(docs: DataFrame, least: float = LEAST_COST) -> DataFrame:
    """One row per row of docs: doc_id, base and found as arrays of (start, end, kind), and n_assign, n_access,
    n_hex, base_sha256, spans as text. Offsets are code points, ends exclusive.

    A null or empty text has no spans, and base_sha256 is that of the empty string. Words are ranked by all documents first.
    """
    words = frequent_words(docs)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"]

    def run(batches):
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            shas, texts = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = guessed_spans(text, base, least, words)
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s[2] == kind for s in base) if k < 3 else len(more))
                shas.append(hashlib.sha256(written(base).encode()).hexdigest())
                texts.append(written(base + more))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(texts, pa.string())], names=names)

    return doc_columns(docs).mapInArrow(tidy(run), "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")
