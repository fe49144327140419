import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from plantscope.session import build_session

    return build_session(cores="4", shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
