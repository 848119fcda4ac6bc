import sys
import tempfile
from functools import cache
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lodechain.session import local_session


@cache
def session():
    return local_session(4, **{"spark.driver.memory": "3g", "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="warehouse-")})


@pytest.fixture
def spark():
    return session()
