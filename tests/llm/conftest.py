import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_rows import SCHEMA, prose, row  # noqa: E402


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def edge_rows():
    """Nulls in any column, empty and very long texts, repeated rows, marks only."""
    long = prose(1, 30_000)
    return [row(1, None), row(2, ""), row(3, " \n\t "), row(4, long), row(5, "### 12 !!"), row(None, prose(2, 80)), row(6, prose(3, 80), None, None), row(6, prose(3, 80), None, None), row(7, prose(4, 60)), row(8, "été \U0001f389 x" * 3)]
