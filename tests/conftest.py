import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from faretide.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[*]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("OFF")
    return session


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)


OBS = (
    "dataset string, hotel_name string, price double, observed_at timestamp, seq long, "
    "dates string, duration string, departure_airport string, url string, offer_url string, image_url string"
)


@pytest.fixture(scope="session")
def make_obs(spark):
    """Observations from dicts; seq defaults to the list position."""

    def make(rows):
        names = [c.split()[0] for c in OBS.split(", ")]
        filled = [
            tuple(
                {"dataset": "d", "seq": i, "observed_at": at("2025-01-01T00:00:00"), **r}.get(n) for n in names
            )
            for i, r in enumerate(rows)
        ]
        return spark.createDataFrame(filled, OBS)

    return make


def as_set(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
