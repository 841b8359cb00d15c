import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def edge(spark):
    return lambda *rows: spark.createDataFrame([(*r, *("CALLS", "exact")[len(r) - 2 :])[:4] for r in rows], "source_id string, target_id string, rel_type string, confidence string")


@pytest.fixture
def symbol(spark):
    return lambda *rows: spark.createDataFrame([(r[0], "function", r[0], r[0], r[1] if len(r) > 1 else "src/a.py", "python") for r in rows], "symbol_id string, kind string, name string, qualified_name string, file_path string, language string")
