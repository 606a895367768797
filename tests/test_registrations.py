"""The queries of alerts against their SQL, where users sign up more than once and some of their values are 0."""

from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest

from kelpline.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Users 1 to 8 sign up at 0 and at 50, users 9 to 12 at 0 alone, users 13 to 16 at 0.004 and at 7.5; users 1 to 4 have an alert already."""
    rows = [(u, "signup", v) for u in range(1, 9) for v in (0.0, 50.0)] + [(u, "signup", 0.0) for u in range(9, 13)] + [(u, "signup", v) for u in range(13, 17) for v in (0.004, 7.5)] + [(u, "view", 1.0) for u in range(1, 5)]
    folder = str(tmp_path_factory.mktemp("events"))
    frame = pd.DataFrame([(i, datetime(2024, 1, 1) + timedelta(minutes=i), *r, "{}") for i, r in enumerate(rows)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    frame.astype({"ts": "datetime64[us]"}).to_parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["alert_batch", "alert_watch"])
def test_least_targets_of_0(spark, events, name):
    got = QUERIES[name](spark, events)
    want = duckdb.connect().sql(ORACLES[name].replace("FROM events", f"FROM '{events}/events.parquet'"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
