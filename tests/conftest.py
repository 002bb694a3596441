import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from crawlframe.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="crawlframe-tests",
                      checkpoint_dir=str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()
