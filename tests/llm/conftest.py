import pytest

from tests.llm import fixtures


@pytest.fixture(scope="session")
def awkward(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("awkward") / "t"
    return fixtures.write(spark, path, fixtures.documents(spark))


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("nothing") / "t"
    empty = lambda schema: spark.createDataFrame([], schema)
    return fixtures.write(spark, path, empty(fixtures.DOCUMENTS), empty("doc_id long, quality int, toxic int"), empty("vec_id long, embedding array<float>, label int"))


@pytest.fixture(scope="session")
def rows(spark, awkward):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{awkward}/documents.parquet").collect()]
