import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text[, lang, source]) tuples, with a column whose names clash with the operators' own."""
    def make(rows):
        full = [(r + (None,) * (4 - len(r)))[:4] + (7,) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, key int")
        return df.repartition(3)

    return make
