import random

import pytest
from llm_frames import frame, words


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(3)
    long = words(rng, 30_000)
    rows = [
        (1, None, None, None),
        (2, ""),
        (3, " \n\t "),
        (4, "one"),
        (5, "Größe ÉTÉ naïve 漢字 words here and there"),
        (6, long, "en", "t"),
        (6, long, "en", "t"),
        (7, "MIT License mit license", "de", None),
        (None, "a row without an id"),
        (None, None),
        (8, "1234 !!! 567"),
        (9, "\\### x </turn> \\\\"),
    ]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
