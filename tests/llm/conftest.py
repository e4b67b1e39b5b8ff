import pytest

DOCS = "text string, lang string, doc_id long, rid long, size long, source string"


@pytest.fixture
def docs(spark):
    """documents from (doc_id, text) pairs, with columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(t, None, i, 7, -1, "src") for i, t in rows], DOCS)

    return make


#: Null, empty, very long, tied and repeated texts.
EDGES = [(1, None), (2, ""), (3, "Same words here"), (4, "sAME words here"), (4, "sAME words here"), (5, "é ÉA   word"), (6, "É éa   word"), (7, "long " * 60_000), (8, "long " * 60_000), (None, "no id"), (9, "tail")]


@pytest.fixture
def edges(docs):
    return docs(EDGES)
