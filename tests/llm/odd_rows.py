import random

import pytest

SCHEMA = "doc_id long, text string, lang string, key_a string, id int, body string, batch int, n long, a long"


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows, copies; extra columns with clashing names."""
    rng = random.Random(11)
    base = prose(rng, 80)
    words = base.split(" ")
    near = " ".join(words[:60] + ["changed"] + words[61:])
    long = "\n".join(prose(rng, 40) for _ in range(900))
    texts = [
        (1, base), (2, near), (3, base), (3, base), (4, None), (5, ""), (6, " \t\n "), (None, base), (None, None), (None, "lonely words here"),
        (7, long), (8, long + " x"), (9, "A B c"), (10, "a b C"), (11, "É ü 中文 🙂 it's <|endoftext|> don't"), (12, "a" * 5000), (12, "other text, same id"),
        (13, "\n\n"), (14, "line one\nLINE ONE \n\nline two\r\n"), (15, base.upper()),
    ]
    texts += [(100 + k, f"Common line.\n{prose(rng, 12)}\n common LINE.") for k in range(12)]
    texts += [(200 + k, prose(rng, rng.randint(0, 30))) for k in range(20)]
    return [(i, t, "en" if k % 3 else None, "clash", 7, "clash", k, k, k) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
