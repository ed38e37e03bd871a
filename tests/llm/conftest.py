import pytest

from sparkscope.llm import common


@pytest.fixture(scope="module", autouse=True)
def released(spark):
    yield
    common.release(spark)
