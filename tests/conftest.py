import sys
from datetime import date, datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from medlattice.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def root():
    """The smallest test tables."""
    path = "/root/testdata/sf0.001"
    if not Path(path).exists():
        pytest.skip("no test tables here")
    return path


def ts(text):
    return datetime.fromisoformat(text)


def day(text):
    return None if text is None else date.fromisoformat(text)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
