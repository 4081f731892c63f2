import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, _id long, component string, size string, copies int, score double, row string, part string, label int"
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu", "nu", "xi", "omi", "pi", "rho", "sigma", "tau", "phi"]


def row(doc_id, text, source="s"):
    return (doc_id, text, None, source, None, "x", 7, "c", "9", 3, 0.5, "r", "p", 1)


def words(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty, blank, short and very long texts, ties, repeated rows; and near and partial copies."""
    base, long_ = words(1, 300), words(2, 30_000)
    changed = base.split()
    changed[150] = "other"
    rows = [row(1, base), row(2, base, None), row(3, " ".join(changed), "t"), row(4, base.upper(), "t"), row(5, None, "u"), row(6, "", None), row(7, " \t\n ", "u"), row(8, "one two", "s"), row(9, "one\ttwo", "v"), row(10, long_, "v"), row(11, "x" * 70_000, "w")]
    rows += [row(12, words(3, 80) + " " + " ".join(base.split()[20:120]) + " " + words(4, 60)), row(13, "\n".join(words(5, 200).split())), row(14, "\n".join(words(5, 200).split()) + " tail", "t")]
    rows += [row(20 + i, words(100 + i, 5 + 7 * i), f"s{i % 3}") for i in range(30)]
    rows += [row(60, "same row"), row(60, "same row"), (None,) * 14, (None, base, *(None,) * 12)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
