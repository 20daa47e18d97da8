import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from paneltide.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("paneltide-tests")
    yield session
    session.stop()


@pytest.fixture
def split_plans(spark):
    """Force the split plans by declaring that a task holds seven rows."""
    spark.conf.set("spark.paneltide.maxTaskRows", "7")
    yield
    spark.conf.unset("spark.paneltide.maxTaskRows")
