import tempfile

import pytest


@pytest.fixture(autouse=True, scope="session")
def checkpoint_folder(spark):
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
