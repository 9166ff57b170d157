import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ridgelog.schema import LOG_SCHEMA  # noqa: E402
from ridgelog.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        master="local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.sql.maxMetadataStringLength": "5000",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def as_of():
    return datetime(2024, 1, 31)


@pytest.fixture
def make_logs(spark):
    """Logs from partial records; missing text is '' and missing attributes are empty."""

    def make(records):
        rows = []
        for i, r in enumerate(records):
            defaults = {"id": f"log-{i:03d}", "timestamp": datetime(2024, 1, 15, 10, 30, i % 60), "attributes": {}}
            merged = {**{f: "" for f in LOG_SCHEMA.fieldNames()}, **defaults, **r}
            rows.append(tuple(merged[f] for f in LOG_SCHEMA.fieldNames()))
        return spark.createDataFrame(rows, LOG_SCHEMA)

    return make


@pytest.fixture
def make_lines(spark):
    def make(lines):
        return spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "n int, value string")

    return make
