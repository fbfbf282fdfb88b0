import pytest

from tracemill.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
           "spark.ui.showConsoleProgress": "false",
           # Compiling each plan takes longer than running it on a few rows.
           "spark.sql.codegen.wholeStage": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
