import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from matchspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=4, memory="6g", app="tests")


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
