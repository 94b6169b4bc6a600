"""Every query of the package against its SQL, and all queries on empty tables."""

import pytest

from factorlab.llm.oracles import ORACLES
from factorlab.llm.queries import QUERIES
from tests.compare import TABLES, connect, difference
from tests.llm.rows import SMALL


def test_names():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) == 13


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark):
    assert difference(QUERIES[name](spark, SMALL), connect(SMALL), ORACLES[name]) is None


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in set(TABLES) & {"documents", "benchmark", "labels", "pages", "embeddings"}:
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(name, spark, empty):
    assert QUERIES[name](spark, empty).count() == 0


def test_pipeline_on_empty_tables(spark, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).count() == 0
