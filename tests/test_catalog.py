"""A cross-section of the registered queries against their SQL counterparts (all: tools/check.py)."""

import __spark_entry__ as entry
import pytest

from ridgelog.catalog import all_oracles, all_queries
from tools.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = (
    "filter_and_or log_search tail_filter spec_query merge_partials shard_counts trace_timeline trace_sessions error_tags_documents "
    "error_statistics histogram_statistics sliding_rate alert_cooldown parse_lines parse_documents decode_syslog transform_rows "
    "compaction export_csv_documents stream_traces stream_ingest late_ingest publish_merge weekly_compaction drop_expired_weekly "
    "read_json_files ingest_rejects hostile_status_codes hostile_syslog default_alerts stream_alerts stream_error_statistics"
).split()


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, connection, name):
    assert compare(all_queries()[name](spark, SF_DIR), connection, all_oracles()[name]) == ""


def test_entry_points(spark):
    assert set(all_oracles()) == set(all_queries()) <= set(entry.queries())
    assert set(all_oracles()) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
