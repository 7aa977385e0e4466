import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quizlens.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("work")),
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def column(spark):
    """Evaluate a column function over a list of argument tuples."""
    def evaluate(fn, rows, schema):
        names = [part.split()[0] for part in schema.split(",")]
        df = spark.createDataFrame([tuple([i, *row]) for i, row in enumerate(rows)], f"i int, {schema}")
        out = df.select("i", fn(*[df[n] for n in names]).alias("out")).collect()
        return [row["out"] for row in sorted(out)]

    return evaluate
