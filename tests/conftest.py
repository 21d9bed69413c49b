import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corpus_spark.session import build_session  # noqa: E402

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    path = DATA / "sf0.001"
    if not path.exists():
        pytest.skip("driver tables are not here")
    return str(path)


@pytest.fixture
def apply(spark):
    """Values of a Column function over a list of texts, in order."""

    def run(function, values):
        rows = spark.createDataFrame(list(enumerate(values)), "i int, text string")
        return [row.out for row in rows.select("i", function(rows.text).alias("out")).orderBy("i").collect()]

    return run
