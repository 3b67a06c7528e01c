import random

import pytest

VOCAB = [f"w{i:03d}" for i in range(160)]


def sentence(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): nulls, empties, short and long texts, exact copies, near copies, shared passages, odd white space."""
    rng = random.Random(5)
    rows: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "one  two\n"), (5, "ONE TWO"), (6, "ein Wort bleibt eins")]
    base = sentence(rng, 150)
    rows += [(10 + i, base) for i in range(4)]
    for i in range(8):
        words = base.split()
        for _ in range(i // 2):
            words[rng.randrange(len(words))] = "edit" + str(rng.randrange(10**6))
        rows.append((20 + i, " ".join(words)))
    passage = sentence(rng, 60)
    rows += [(40 + i, f"{sentence(rng, 20 + i)} {passage}\n{sentence(rng, 10)}") for i in range(6)]
    rows += [(60, "a b c " * 60), (61, sentence(rng, 34)), (62, sentence(rng, 35)), (63, " ".join(["same"] * 80)), (64, sentence(rng, 9000)), (65, "Ünïcödé çà et là 日本語 😀 " * 12)]
    rows += [(100 + i, sentence(rng, rng.randrange(1, 300))) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with further columns whose names clash with those the operators make."""
    return spark.createDataFrame([(d, t, "x", 1, 2.0) for d, t in corpus], "doc_id long, text string, tok string, n long, row_id double").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def vocabularies():
    return pytest.importorskip("public_tokenizers")
