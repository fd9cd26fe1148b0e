import pytest

from loomwork.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("loomwork-tests", cores=8)
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()
