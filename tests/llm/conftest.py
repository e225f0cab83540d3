import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    """Invented words, the same for the same seed."""
    import random

    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, odd characters and nothing at all."""
    base = words(120, 1)
    passage = words(60, 2)
    near = list(base)
    near[50] = "changed"
    return [
        (5, " ".join(base)),
        (2, " ".join(base)),
        (9, " ".join(near)),
        (7, " ".join(words(30, 3) + passage + words(30, 4))),
        (8, " ".join(passage) + "\t\n" + " ".join(words(40, 5))),
        (1, None),
        (3, ""),
        (4, "  \n "),
        (6, "one two three"),
        (10, "One  TWO\tthree"),
        (11, " ".join(words(9000, 6))),
        (12, "la la la la la la la la la la la la la la la la la la la la"),
        (13, "naïve Straße 東京 " + " ".join(passage[:20])),
        (14, " ".join(words(12, 7))),
        (15, "***"),
    ]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in corpus], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
