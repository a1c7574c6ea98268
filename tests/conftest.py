import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from carelattice.session import local_session  # noqa: E402

EVENT_SCHEMA = ("patient_id string, event_id string, seq bigint, source_id string, source_type string, kind string, "
                "label string, value string, unit string, observed_at timestamp, status string")
SOURCE_SCHEMA = "patient_id string, source_id string, source_type string, title string, captured_at timestamp, raw_text string"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "2", "spark.driver.memory": "6g"})
    yield session
    session.stop()


@pytest.fixture()
def make_events(spark):
    def build(*rows, patient="p1"):
        data = []
        for i, r in enumerate(rows):
            r = dict(r)
            data.append((r.get("patient", patient), r.get("id", f"e{i}"), i, r.get("source", "src_a"),
                         r.get("source_type", "voice"), r["kind"], r["label"], r.get("value"), r.get("unit"),
                         r.get("at", dt.datetime(2026, 1, 1)), r.get("status")))
        return spark.createDataFrame(data, EVENT_SCHEMA)
    return build


@pytest.fixture()
def make_sources(spark):
    def build(*rows):
        return spark.createDataFrame(
            [(p, s, t, f"Source {s}", dt.datetime(2026, 1, 1), text) for p, s, t, text in rows], SOURCE_SCHEMA)
    return build
