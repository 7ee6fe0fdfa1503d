import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from larkfield.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    scratch = tmp_path_factory.mktemp("scratch")
    session = local_session("4", "tests", spark__checkpoint__dir=str(scratch / "shared"),
                            spark__sql__warehouse__dir=str(scratch / "warehouse"))
    yield session
    session.stop()
