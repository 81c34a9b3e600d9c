import datetime
import random

import pytest

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu".split()


def prose(n: int, seed: int) -> str:
    """Invented text of ``n`` words."""
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(200)) for _ in range(n))


EXTRA = "score double, predicted int, node long, h long, p int, _id long, _text string, _copy long, label int, path2 string, day date"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns whose names operators use."""
    day = datetime.date(2026, 1, 1)
    extra = (0.5, 1, 1, 1, 1, 1, "x", 1, 1, "y", day)
    none = (None,) * len(extra)
    long_text = prose(60_000, 1)
    rows = [
        (1, prose(80, 2), "en", "src0", 10, *extra),
        (1, prose(80, 2), "en", "src0", 10, *extra),
        (2, prose(80, 2), "en", "src0", 10, *none),
        (3, None, "en", "src0", None, *extra),
        (4, "", None, None, 0, *extra),
        (None, prose(90, 3), "en", "src0", 5, *extra),
        (None, None, None, None, None, *none),
        (7, long_text, "en", "src1", 1, *extra),
        (8, long_text + " end", "en", "src1", 1, *extra),
        (9, " \n\t ", "de", "src2", 4, *extra),
        (10, "one two", "de", "src2", 7, *extra),
        (11, "x" * 300_000, "de", "src2", 7, *extra),
    ]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 12)] + [(None, 1, 1), (2, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
