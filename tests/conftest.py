"""One session for all tests."""

import faulthandler
import os
import signal
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

#: Seconds a test may take.
LIMIT = int(os.environ.get("TEST_SECONDS", "240"))


@pytest.hookimpl(wrapper=True)
def pytest_runtest_call(item):
    """A test that takes longer than LIMIT fails, with the stack where it stood, and the next one runs."""

    def late(*_):
        faulthandler.dump_traceback()
        raise TimeoutError(f"{item.name} took more than {LIMIT} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(LIMIT)
    try:
        return (yield)
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
