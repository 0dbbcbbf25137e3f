import pytest

from tracewright.llm import common


@pytest.fixture(scope="session", autouse=True)
def clean(spark):
    yield
    common.clear(spark)
