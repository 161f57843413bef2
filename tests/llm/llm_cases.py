import random

import pytest

WORDS = "the of and to in that is was for it with as his on be at by had not are but from or have".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null, empty, blank, repeated, very long texts; null and repeated ids; clashing extra columns."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, "!!! ??? 123"), (6, base), (7, base), (7, base),
        (8, base.upper()), (None, base + " tail"), (9, "x" * 30_000), (10, "ab " * 8_000),
        (11, "Straße İstanbul ΣΑΣ ñandú 日本語 \U0001F600 é"), (12, sentence(rng, 3000)), (13, "\x1c\x1d a\x1fb \x85"),
    ]
    names = "doc_id long, text string, lang string, score double, fp long, words string, quality_score string"
    return spark.createDataFrame([(d, t, "en", 0.5, 1, "w", "q") for d, t in rows], names).repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
