"""Results do not depend on the session time zone (event times are NTZ)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL, rows

NAMES = ["message_id", "session_epochs", "session_timeout", "request_response", "session_turns", "stream_session_timeout"]


@pytest.mark.parametrize("name", NAMES)
def test_same_result_in_another_zone(spark, name):
    q = E.queries()[name]
    utc = rows(q(spark, SF_SMALL))
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        other = rows(q(spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert utc == other
