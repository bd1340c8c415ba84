import pytest

#: The rows that every operator has to stand: nulls, empty and long texts, repeated rows.
ODD = [(1, None), (2, ""), (3, "x"), (None, "no id here"), (4, " \n\t "), (5, "same text here twice"), (5, "same text here twice"), (6, "long words " * 20_000), (7, "é" * 5000), (8, "!!! 123 ###"), (9, "\x1c\x85  odd")]


@pytest.fixture()
def odd(spark):
    """documents with odd rows, and extra columns whose names operators use for results."""
    return spark.createDataFrame([(i, t, 7, "mine", 1.5) for i, t in ODD], "doc_id long, text string, n_tokens int, found_ string, score double")


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, n_tokens int, found_ string, score double")
