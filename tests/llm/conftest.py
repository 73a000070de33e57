import pytest

DOCS = "doc_id long, text string"


@pytest.fixture
def docs(spark):
    def make(texts, ids=None):
        return spark.createDataFrame([(i, t) for i, t in zip(ids or range(len(texts)), texts)], DOCS)

    return make
