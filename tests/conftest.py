import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from docscreen.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, memory="8g")


@pytest.fixture(scope="session")
def sf():
    return SMALL


@pytest.fixture
def evaluate(spark):
    """Value of a column expression for one text."""
    def run(expression, **columns):
        names = ", ".join(f"{n} string" for n in columns)
        return spark.createDataFrame([tuple(columns.values())], names).select(
            expression.alias("x")).first().x

    return run
