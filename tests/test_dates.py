from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from trainlake.functions import dates


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-01-05T10:20:30Z", datetime(2024, 1, 5, 10, 20, 30)),
        ("2024-01-05T10:20:30+02:00", datetime(2024, 1, 5, 8, 20, 30)),
        ("2024-01-05 10:20:30.5", datetime(2024, 1, 5, 10, 20, 30, 500000)),
        ("2024-01-05", datetime(2024, 1, 5)),
        ("2024", None), ("2024-13-05", None), ("yesterday", None), ("", None), (None, None),
    ],
)
def test_iso_dates(one, text, expected):
    assert one(dates.parse_iso(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize(
    "day, monday",
    [("2024-01-28", date(2024, 1, 22)), ("2024-01-22", date(2024, 1, 22)), ("2024-01-24", date(2024, 1, 22)),
     ("2024-01-01", date(2024, 1, 1)), ("2023-12-31", date(2023, 12, 25))],
)
def test_week_starts_on_monday(one, day, monday):
    assert one(dates.week_start(dates.day_literal(day))) == monday


def test_next_week(one):
    days = one(dates.next_week_dates(dates.day_literal("2024-01-28")))
    assert days == [date(2024, 1, 29), date(2024, 1, 30), date(2024, 1, 31), date(2024, 2, 1), date(2024, 2, 2),
                    date(2024, 2, 3), date(2024, 2, 4)]


def test_countdown_stops_at_zero(one):
    left = lambda day: one(dates.days_left(dates.day_literal(day), "2024-01-20"))
    assert (left("2024-01-18"), left("2024-01-20"), left("2024-03-01")) == (2, 0, 0)
    assert one(dates.training_day(dates.day_literal("2024-01-18"), "2024-01-20")) == -2


def test_training_weeks(one):
    week = lambda day: one(dates.training_week(dates.day_literal(day), "2024-01-01"))
    assert [week(d) for d in ("2024-01-01", "2024-01-07", "2024-01-08", "2024-02-12")] == [1, 1, 2, 7]


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "UTC"])
def test_iso_dates_do_not_depend_on_the_session(spark, one, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2024-01-05T10:20:30Z", "2024-11-03T01:30:00-05:00", "2024-11-03 01:30:00", "1969-12-31T23:59:59.5Z", "2024-01-05"]
        found = one(*[dates.parse_iso(F.lit(t)) for t in texts])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found == (
        datetime(2024, 1, 5, 10, 20, 30), datetime(2024, 11, 3, 6, 30), datetime(2024, 11, 3, 1, 30),
        datetime(1969, 12, 31, 23, 59, 59, 500000), datetime(2024, 1, 5),
    )
