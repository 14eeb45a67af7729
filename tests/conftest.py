import pytest

from postkiln.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    local = tmp_path_factory.mktemp("spark")
    SparkSession.builder.config("spark.ui.enabled", "false").config("spark.local.dir", str(local / "local")).config("spark.checkpoint.dir", str(local / "shared")).config("spark.sql.warehouse.dir", str(local / "wh"))
    session = build_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
