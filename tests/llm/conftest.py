import pytest


@pytest.fixture(scope="session", autouse=True)
def clean(spark):
    yield
    from ionforge.llm.common import cleanup

    cleanup(spark)
