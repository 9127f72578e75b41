import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from skein.session import local_session

    session = local_session("tests", "4", partitions=4, memory="3g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """The rows of a DataFrame as a sorted list of tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)


DATA = os.environ.get("SKEIN_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture
def data():
    if not Path(DATA).exists():
        pytest.skip("no data tables here")
    return DATA
