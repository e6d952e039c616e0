import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quire.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", app="quire-tests", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-tests-"))
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate one Column rule on literal texts."""
    from pyspark.sql import functions as F

    def run(rule, *texts):
        names = "abcdef"[: len(texts)]
        df = spark.createDataFrame([texts], ", ".join(f"{n} string" for n in names))
        return df.select(rule(*[F.col(n) for n in names]).alias("v")).first()["v"]

    return run
