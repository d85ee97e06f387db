import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from weft.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = session("local[4]", 4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
