import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from quernstone.session import SETTINGS

    session = (
        SparkSession.builder.master("local[4]")
        .config(map=SETTINGS)
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def engine(spark, tmp_path):
    from quernstone.engine import Engine

    return Engine(spark, tmp_path / "root")


@pytest.fixture
def api(engine):
    from quernstone.api import Api

    return Api(engine)
