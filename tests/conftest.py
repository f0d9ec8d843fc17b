import os
import pathlib
import sys

import pytest

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # before numpy is imported

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from panelspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
