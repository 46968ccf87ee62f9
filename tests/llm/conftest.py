import pytest

from tests.llm import cases


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with extra columns whose names clash with what the operators add."""
    docs = cases.frame(spark, cases.odd_rows()).repartition(3)
    from pyspark.sql import functions as F
    clash = {c: F.lit("mine") for c in ("score", "size", "taken", "kept", "h", "n_words", "ids", "entities", "secrets", "bucket", "_doc", "cut", "chunk", "n_lines", "set", "failed_bits")}
    return docs.withColumns(clash).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return cases.frame(spark, [])
