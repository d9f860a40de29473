import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Null, empty, blank, very long, repeated and tied rows."""
    rng = random.Random(5)
    passage = sentence(rng, 60)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    long = sentence(rng, 30_000, 5000)
    texts = [None, "", "   \n\t", "one", "Two words", base, base, base.upper(), " ".join(near), long,
             f"{sentence(rng, 30)} {passage} {sentence(rng, 20)}", f"{passage} {sentence(rng, 50)}",
             "same " * 90, "x" * 20_000, "é ü\x1c\x85 ß  \t\n 12,5% 'tis don't", "日本語 テキスト 😀", "!!! ... ---", passage]
    rows = [(i, t, "en" if i % 3 else None, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, base, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
