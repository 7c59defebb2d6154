import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from compare import DATA, duck, session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    import __spark_entry__  # noqa: F401 - makes task functions travel with the job
    from tillflow import prepare
    return prepare(session())


@pytest.fixture(scope="session")
def folder():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def con(folder):
    return duck(folder)
