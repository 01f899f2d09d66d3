import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Rows to a frame of the given schema, in several partitions."""

    def build(rows, schema, parts=3):
        frame = spark.createDataFrame(rows, schema)
        return frame.repartition(parts) if rows else frame

    return build


@pytest.fixture(scope="session")
def documents(make):
    """Texts to documents numbered from 0."""

    def build(texts):
        return make([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCUMENTS)

    return build
