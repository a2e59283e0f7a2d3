import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ledgerlens.session import local_session
    s = local_session(4, app="ledgerlens-tests", shuffle_partitions=4,
                      checkpoint=str(tmp_path_factory.mktemp("ckpt")))
    yield s


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL
