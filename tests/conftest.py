import pytest

from tickloom.session import expose_package, get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    expose_package(session)
    yield session
    session.stop()
