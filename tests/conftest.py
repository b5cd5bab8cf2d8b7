import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rivulant.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", app="tests")
    yield session
    session.stop()


@pytest.fixture
def corpus_of(spark):
    """Texts by path as a corpus."""

    def make(**texts):
        return spark.createDataFrame(list(texts.items()), "path string, source string")

    return make
