import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from moorline.session import local_session

    s = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "2", "spark.default.parallelism": "2"})
    yield s
    s.stop()
