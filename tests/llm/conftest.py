import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """A documents table with nulls, empty and very long texts, ties, repeated rows and extra columns of clashing names."""
    rows = [(1, "The cat sat on the mat. Released under the MIT License.", "en"), (2, "the cat  sat\ton the mat", "en"), (3, None, "en"),
            (4, "", None), (5, "!!! ... 123", "fr"), (6, "The cat sat on the mat. Released under the MIT License.", "en"),
            (None, "le chat est sur le tapis", "fr"), (None, "le chat est sur le tapis", "fr"), (7, "x" * 70_000, None),
            (8, "word " * 30_000, "en"), (9, "É<|endoftext|>ü  \n 'S", None), (2, "the cat  sat\ton the mat", "en"), (None, None, None)]
    rows += [(100 + i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(60)), "en" if i % 3 else "fr") for i in range(40)]
    rows += [(200 + i, " ".join(f"w{j % 97}" for j in range(60 + (i == 3))), "en") for i in range(5)]
    made = [(i, t, lang, "src", len(t or ""), 1, "k", 2.0, None) for i, t, lang in rows]
    return spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint, fp int, kept string, "
                                       "score double, piece int").repartition(3)


@pytest.fixture
def empty(docs):
    return docs.where("false")
