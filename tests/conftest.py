import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)

import pytest  # noqa: E402

from gazeloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", 8, **{"spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
