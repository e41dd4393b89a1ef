import pytest

from fleetlane.llm import common


@pytest.fixture(scope="session")
def llm(spark):
    return common.prepare(spark)
