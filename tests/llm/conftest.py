import pytest

from crossbar.llm.common import prepare


@pytest.fixture(autouse=True)
def _workers(spark):
    prepare(spark)
