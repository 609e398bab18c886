"""Quality rules as a bitmask ledger.

`evaluate` runs every rule once on every document and stores the measurements and one long of
failure bits. Policies are versioned masks over those bits: applying one, comparing several, or
asking what a rule alone rejects (`ablations`) reads the ledger and never the text again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, tidy, words_of

SYMBOLS = "#*$%&|<>"
MARKS = "!?"
BLANKS = " \t\n\x0b\x0c\r"

#: Rule name -> condition under which a document fails it. Bit k of `fail_bits` is the k-th rule.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "marks": "10 * n_marks > 3 * n_words",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
STANDARD = Policy("standard-1", tuple(RULES))
POLICIES = (BASE, STANDARD)

NAMES = ("n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text, first finds included."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 2_000_000:  # keys of three words would not fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The values of NAMES for one text; null and empty texts have zeros."""
    if not text:
        return (0,) * len(NAMES)
    words = words_of(text)
    chars = len(text) - sum(map(text.count, BLANKS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), sum(map(text.count, MARKS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def _measure_batches(text_of):
    def run(batches):
        for batch in batches:
            rows = [measure(t.as_py()) for t in text_of(batch)]
            table = np.array(rows, np.int64).reshape(len(rows), len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, k]) for k in range(len(NAMES)))], names=["row", *NAMES])

    return run


def fail_bits() -> Column:
    return F.expr(" + ".join(f"CASE WHEN {rule} THEN {BIT[name]}L ELSE 0L END" for name, rule in RULES.items()))


def _measured(rows: DataFrame, text_of) -> DataFrame:
    """Measurements beside the first column of rows; text_of finds the texts in a batch."""
    schema = f"row {rows.schema[0].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in NAMES)
    return rows.mapInArrow(tidy(_measure_batches(text_of)), schema).withColumn("fail_bits", fail_bits())


def evaluate(docs: DataFrame) -> DataFrame:
    """The ledger: doc_id, the measurements, fail_bits. A null or empty text has no words and fails few_words.

    Each row is measured for itself: repeated doc_ids keep a row each; other columns are ignored.
    """
    return _measured(doc_columns(docs), lambda batch: batch.column(1)).withColumnRenamed("row", "doc_id")


def passes(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0


def apply_policy(ledger: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The ledger with the policy's version and whether it keeps each row. Reads the bits alone; a row without bits is not kept or lost but null."""
    return ledger.withColumn("policy", F.lit(policy.version)).withColumn("kept", passes(policy))


def ablations(ledger: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Per policy and rule: n_kept, n_failed (by the rule), n_only (by it and no other rule of the policy), n_kept_without.

    One aggregation by distinct bit patterns (2^rules at most), then bit arithmetic on those.
    """
    patterns = ledger.groupBy("fail_bits").agg(F.count("*").alias("n"))
    grid = F.array(*[F.struct(F.lit(p.version).alias("policy"), F.lit(r).alias("rule"), F.lit(p.mask).alias("mask"), F.lit(BIT[r]).alias("bit")) for p in policies for r in p.rules])
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    only = total(hit == F.col("bit"))
    return patterns.select("fail_bits", "n", F.inline(grid)).groupBy("policy", "rule").agg(total(hit == 0).alias("n_kept"), total(hit.bitwiseAND(F.col("bit")) != 0).alias("n_failed"), only.alias("n_only"), (total(hit == 0) + only).alias("n_kept_without"))


def filter_documents(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The documents that a policy keeps, with all their columns as they were.

    Each row is judged by its own text: a null or empty one has no words; ids may be null or repeated; an empty table stays empty.
    """
    at = docs.columns.index("text")
    whole = docs.select(F.struct(*[(F.col(f"`{c}`").cast("string") if k == at else F.col(f"`{c}`")).alias(c) for k, c in enumerate(docs.columns)]).alias("row"))
    return _measured(whole, lambda batch: batch.column(0).field(at)).where(passes(policy)).select("row.*")
