import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    def make(rows, schema=DOCS):
        return spark.createDataFrame(rows, schema)

    return make
