import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tapewatch.session import build_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def bars(spark):
    """A function from closes per symbol to daily bars."""
    import datetime as dt

    def make(closes: dict[str, list[float]], volumes=None, start=dt.datetime(2024, 1, 1), step=dt.timedelta(days=1)):
        rows = []
        for symbol, values in closes.items():
            for i, c in enumerate(values):
                v = (volumes or {}).get(symbol, [100] * len(values))[i]
                rows.append((symbol, start + i * step, float(c), float(c) * 1.01, float(c) * 0.99, float(c), int(v), 0))
        return spark.createDataFrame(
            rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume long, seq long")

    return make
