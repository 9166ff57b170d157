"""Streams in a session that names no state store of its own, as a cluster's sessions do."""

import pytest

from ridgelog.catalog import all_oracles, all_queries
from ridgelog.session import STATE_STORE
from tools.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
DEFAULT = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


@pytest.fixture
def default_store(spark):
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, DEFAULT)
    yield DEFAULT
    spark.conf.set(STATE_STORE, before)


@pytest.mark.parametrize("name", ["stream_alerts", "stream_anomalies", "stream_error_statistics"])
def test_state_machines_run_on_any_session(spark, default_store, name):
    assert compare(all_queries()[name](spark, SF_DIR), connect(SF_DIR), all_oracles()[name]) == ""
    assert spark.conf.get(STATE_STORE) == default_store
