from __future__ import annotations

import random

import pytest

from corollary.session import ship_package

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, line string, n int, block int, id string"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


def words(rng: random.Random, n: int, vocabulary: int = 300) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_rows() -> list[tuple]:
    """Documents with nulls in every column, empty, blank and very long texts, repeated rows and near copies."""
    rng = random.Random(7)
    base = " ".join(words(rng, 80))
    texts = [
        base, base, base.replace("w1", "w2", 1), None, "", " \n\t ", "one", "one two", "\n".join([base, "same line here now ok", "same line here now ok"]),
        " ".join(words(rng, 30_000, 5000)), "x" * 50_000, "line\nline\nline", "héllo wörld ✓ 日本語", "A B a b", "word " * 200,
        'my token = "ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e" ok', "AKIA" + "Z9" * 8, "password=abc token: abcdefgh",
    ] + [" ".join(words(rng, 60)) for _ in range(20)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), 0.5, "yes", "l", 1, 2, "i") for i, t in enumerate(texts)]
    rows += rows[:2]
    rows += [(None, base, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 4 != 0), 0) for i in range(36)] + [(1, 0, 0), (None, 1, 0), (3, None, 0), (999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
