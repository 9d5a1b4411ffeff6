import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, component string, start string"


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "and", "rho", "sigma", "tau", "Ünïcode", "kappa", "x1", "mu"]) + str(rng.randrange(30)) for _ in range(n))


def corpus():
    """Every awkward case: nulls, blanks, long texts, copies, near copies, shared passages, periodic texts, ties, repeated rows."""
    rng = random.Random(5)
    passage, texts = prose(rng, 60), [None, "", "  \t\n", "one", "Two words", "a b c d", "A B C D", "x " * 300, "ab" * 400, "\x00nul\x0bvt\x1cfs\x85nel　wide " * 20]
    texts += [prose(rng, rng.randrange(1, 120)) for _ in range(40)]
    base = prose(rng, 200)
    texts += [base] * 5 + [base.replace("alpha1 ", f"changed{i} ", 1) + f" tail{i}" for i in range(8)]
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 20)}" for _ in range(6)] + [f"{passage}\n{passage}"]
    texts += [prose(rng, 20_000)] + ["\U0001f600" * 120, "\U0001f600" * 130]
    rows = [(i, t, "en", f"s{i % 5}" if i % 7 else None, None, "clash", "clash", "clash") for i, t in enumerate(texts)]
    return rows + rows[10:14] + [(None, texts[60], "de", "s1", 1, "c", "c", "c"), (None, texts[20], "de", "s1", 1, "c", "c", "c"), (3, prose(rng, 80), None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
