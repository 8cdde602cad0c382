import pytest


@pytest.fixture
def docs(spark):
    """Builds documents from (doc_id, text, lang, source) rows; the rest of a row may be left out."""

    def build(rows, extra=None):
        full = [tuple(r) + (None,) * (4 - len(r)) for r in rows]
        frame = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string")
        return frame.selectExpr("*", *extra) if extra else frame

    return build
