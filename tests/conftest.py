import pytest
from compare import local_session

from lodestar.session import tune


@pytest.fixture(scope="session")
def spark():
    return tune(local_session())


@pytest.fixture(scope="session")
def t(spark):
    from lodestar.plans.registry import Tables
    return Tables(spark, "/root/testdata/sf0.001")
