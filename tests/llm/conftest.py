"""Small tables with every awkward case."""

import pytest
from llm_helpers import AWKWARD
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with null ids, texts and columns, empty, blank and long texts, repeated rows, extra columns."""
    rows = [(*r, 7, "extra", 1.5) for r in AWKWARD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, block int, node string, score double")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.filter(F.lit(False))
