import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    root = str(Path(__file__).resolve().parent.parent)
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.executorEnv.PYTHONPATH", root).getOrCreate()
    )
    s.sparkContext.environment["PYTHONPATH"] = root
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
