import random

import pytest

CLASHING = "doc_id long, text string, lang string, id long, th long, line int, fp long, found string, n_lines int, kept string, h long, a long, component string"


def clashing(rows):
    """Rows (doc_id, text) or (doc_id, text, lang) with extra columns whose names the operators use inside."""
    return [(r[0], r[1], r[2] if len(r) > 2 else None, 1, 2, 3, 4, "x", 5, "y", 6, 7, "z") for r in rows]


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows):
        return spark.createDataFrame(clashing(rows), CLASHING).repartition(3)

    return make


@pytest.fixture(scope="session")
def vocabulary():
    """A few hundred invented words."""
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghilmnoprstuvé") for _ in range(rng.randint(1, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long and repeated texts."""
    return [None, "", " ", "\n\n\n", "a", "é" * 3, "x" * 120_000, "the same\n" * 4000, "twice the same row", "twice the same row"]
