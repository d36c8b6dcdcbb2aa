import os
import tempfile

import pytest
from pyspark.sql import SparkSession


def local_session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .appName("layerkit")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", "/tmp/layerkit-warehouse")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="layerkit-tests-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pytest_sessionstart(session):
    """Columns in parametrised tests need a running session."""
    local_session()


@pytest.fixture(scope="session")
def spark():
    return local_session()
