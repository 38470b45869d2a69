import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session", autouse=True)
def no_scratch_left(spark):
    """Scratch folders and tables go before the session ends."""
    yield
    from panelgauge.llm import common

    common.drop_scratch()
    assert not common._SCRATCH
