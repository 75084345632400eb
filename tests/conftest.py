import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))


@pytest.fixture(scope="session")
def spark():
    from emberwatch.session import local_session

    session = local_session(8)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
