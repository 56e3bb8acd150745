import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from compare import session

    made = session()
    made.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return made
