import pytest

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, row STRING, id STRING, block STRING, component STRING, __id_ STRING"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, langs=None):
        rows = [(i, t, (langs or {}).get(i), f"s{i % 3}", len(t or ""), *["x"] * 5) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return make
