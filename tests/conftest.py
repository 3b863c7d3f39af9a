import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from skewmatch.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("*", 8, app="skewmatch-tests")


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def entities(spark, texts, start=0):
    """A small entity table ``(id, text)`` with ids from ``start``."""
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "id long, text string")
