from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use within; a table may have them as well.
CLASHING = ("row", "key", "n", "line", "component", "fail_bits", "kept", "_row", "_text", "n_words", "ids", "length", "sequence_id", "gram", "chunk", "blob", "spans", "_copy", "_bad", "island", "uid", "tag", "province", "_gone", "_gone_id", "n_lines", "n_removed", "first", "marks", "size", "word")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def edited(rng: random.Random, text: str, share: float) -> str:
    words = text.split(" ")
    for k in rng.sample(range(len(words)), int(share * len(words))):
        words[k] = sentence(rng, 1)
    return " ".join(words)


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """(doc_id, text): clean texts, exact and near copies, shared passages, repeats, junk, odd cases."""
    rng = random.Random(11)
    base = [sentence(rng, rng.randint(60, 160)) for _ in range(30)]
    shared = sentence(rng, 60)
    texts = list(base)
    texts += [base[0]] * 4 + [base[1], base[1]]
    texts += [edited(rng, base[2], 0.02) for _ in range(5)] + [edited(rng, base[3], 0.1) for _ in range(4)]
    texts += [sentence(rng, 40) + "\n" + shared + "\n" + sentence(rng, 20) for _ in range(6)]
    texts += ["again again again again " * 40, "a" * 3000, "x y z", "x y z", "X  y\tz", "one", "", " \n\t ", "%%% " * 80]
    texts += ["\n".join(base[k][:200] for k in range(12)), sentence(rng, 3000), "é漢字 " * 60, "line one of five words\n" * 8]
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)]
    return [*rows, (1000, None), (1001, None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in corpus]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def crowded(docs):
    """The same with many more columns."""
    from pyspark.sql import functions as F

    out = docs
    for c in CLASHING:
        out = out.withColumn(c, F.lit(f"own {c}"))
    return out


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def repeated(docs):
    """Every row twice, and a row without an id."""
    return docs.unionByName(docs).unionByName(docs.sparkSession.createDataFrame([(None, "some text without an id that is long enough to be looked at", None, None, None)], SCHEMA))
