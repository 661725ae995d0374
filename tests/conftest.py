import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]").appName("vectorloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


MATRIX = "row_id BIGINT, row_pos BIGINT, label STRING, features ARRAY<DOUBLE>"


@pytest.fixture
def make_matrix(spark):
    def make(rows, partitions=3):
        """rows: (label, features) in order."""
        data = [(i, i, label, [float(v) for v in f]) for i, (label, f) in enumerate(rows)]
        return spark.createDataFrame(data, MATRIX).repartition(partitions)

    return make
