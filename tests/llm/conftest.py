import random

import pytest

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, score double, node bigint, key bigint, "
          "row bigint, tie bigint, label int, features string, places string, class_id bigint, rate double, __rate double, __kept int, __source string, __rows int, __id string, rows int, "
          "first_id int, plain string")


def sentence(draw, words=9):
    return " ".join("".join(draw.choice("aeioulmnrst") for _ in range(draw.randint(2, 7))) for _ in range(words)).capitalize() + "."


def prose(seed, sentences=30):
    draw = random.Random(seed)
    return "\n".join(" ".join(sentence(draw) for _ in range(3)) for _ in range(sentences // 3))


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, schema=SCHEMA):
        wide = schema.count(",") + 1
        return spark.createDataFrame([tuple(r) + (None,) * (wide - len(r)) for r in rows], schema)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and long texts, repeated rows and ids, clashing column names."""
    long = prose(1, 3_000)
    rows = [(1, prose(2), "en", "a", 10, 0.5, 7), (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\n\r\v\f ", "de", None),
            (None, prose(3), None, None), (None, None), (5, long, "en", "a"), (6, prose(2), "en", "a"), (7, prose(4), "fr", "c"),
            (7, prose(4), "fr", "c"), (7, prose(5), "fr", "c"), (8, "one two", "en", "a"), (9, "Ünïcödé \U0001f600 ß x", "xx", "z"), (None, prose(3))]
    return docs_of(rows)


@pytest.fixture(scope="session")
def none(docs_of):
    return docs_of([])


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, 0) for i in range(20, 60)] + [(20, None, 0), (None, 1, 0), (21, 1, 1), (21, 1, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def judged(docs_of):
    """Forty documents; those with an even id shout, like every bad one of `labels`."""
    return docs_of([(i, prose(i) if i % 2 else prose(i).upper().replace(" ", "!! ")) for i in range(20, 60)])
