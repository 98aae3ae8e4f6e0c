import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lexspan.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("checkpoints"))
    session = build_session("tests", "local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "4g",
                                                       "spark.checkpoint.dir": folder})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate an expression over texts and return the results in order."""

    def run(texts, expression, kind="string"):
        rows = [(i, text) for i, text in enumerate(texts)]
        df = spark.createDataFrame(rows, f"i int, t {kind}").select("i", expression("t").alias("x"))
        return [row.x for row in sorted(df.collect(), key=lambda row: row.i)]

    return run
