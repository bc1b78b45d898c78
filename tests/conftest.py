import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("SPARK_DRIVER_MEMORY", "6g")
    from tagloom.session import local_session

    session = local_session(8, "tagloom-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files(spark):
    """Files table from ``(version, path, content)`` rows (project ``p``)."""
    from tagloom.sources.trees import files_from_text

    def make(rows, project="p"):
        df = spark.createDataFrame(
            [(project, *r) for r in rows], "project string, version string, path string, content string"
        )
        return files_from_text(df)

    return make


@pytest.fixture(scope="session")
def blobs(files):
    from tagloom.operators.blobs import build_blobs

    def make(path, content):
        return build_blobs(files([("v1", path, content)]))

    return make
