import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "size long, shard int, v string, key long, `rank` int, block int, n int, label string, kept string, h long")


def doc(doc_id, text, source="a", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text), 1, 2, "v", 3, 4, 5, 6, "l", "k", 7)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and
    ids, and extra columns whose names operators use inside."""
    rows = [doc(1, prose(1, 60)), doc(1, prose(1, 60)), doc(2, prose(1, 60), None), doc(3, None), doc(None, prose(2, 30)),
            doc(None, None, None, None), doc(4, ""), doc(5, ""), doc(6, " \n\t "), doc(7, prose(3, 30000), "b"),
            doc(8, "one"), doc(9, "é ß 中文 ١٢ 🙂"), doc(1, "other text under a known id"), doc(10, prose(4, 130), "c"),
            (None,) * 15]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.collect()]
