import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from barloom.llm.shipping import ship  # noqa: E402

from tests_llm_help import SF  # noqa: E402


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    return ship(spark)


@pytest.fixture(scope="session")
def load(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
