import shutil

import pytest


@pytest.fixture
def table(spark):
    """Rows as a DataFrame, dealt over several partitions."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


@pytest.fixture(scope="session", autouse=True)
def scratch(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    spark.sparkContext.setCheckpointDir(folder)
    yield folder
    shutil.rmtree(folder, ignore_errors=True)
