from datetime import datetime

import pytest
from helpers import by_id, rows

from trainlake import schemas as S
from trainlake.operators import ingest


def raw(spark, *items):
    return spark.createDataFrame([tuple(i.get(n) for n in S.RAW_WORKOUT.fieldNames()) for i in items], S.RAW_WORKOUT)


def test_normalise(spark):
    table = raw(
        spark,
        {"id": "1", "athlete_id": 7, "date": "2024-01-05T10:00:00Z", "distance": 5000, "time": 13509.0},
        {"id": "2", "athlete_id": 7, "date": "2024-01-05T10:00:00Z", "distance": 0, "time": 600.0},
        {"id": "3", "athlete_id": 7, "date": "?", "distance": None, "time": 0.0},
        {"id": "4", "athlete_id": 7, "date": "2024-01-05", "distance": 500, "time": None},
    )
    found = by_id(ingest.normalise(table))
    assert set(found) == {"1", "2", "3"}
    first = found["1"]
    # 1350.9 s: the stored duration is cut, the split uses all of it.
    assert (first.duration_sec, first.workout_date) == (1350, datetime(2024, 1, 5, 10))
    assert first.avg_split_sec == pytest.approx(135.09, abs=1e-4)
    assert found["2"].avg_split_sec is None and found["2"].duration_sec == 60
    assert found["3"].avg_split_sec is None and found["3"].workout_date is None
    assert [r.id for r in ingest.rejected_workouts(table).collect()] == ["4"]


def test_intervals_keep_their_position_and_unit(spark):
    table = raw(
        spark,
        {"id": "9", "time": 100.0, "intervals": [(500, 120.0, 20), (0, 60.0, 18), (None, None, None)]},
        {"id": "8", "time": 100.0, "intervals": []},
        {"id": "7", "time": 100.0},
    )
    found = by_id(ingest.flatten_intervals(table), "interval_id")
    assert set(found) == {"9_0", "9_1", "9_2"}
    assert (found["9_0"].split_sec, found["9_0"].work_duration_sec, found["9_0"].spm) == (120.0, 120.0, 20)
    assert found["9_1"].split_sec is None and found["9_1"].rest_duration_sec is None
    scaled = by_id(ingest.flatten_intervals(table, interval_time_unit=0.1), "interval_id")
    assert scaled["9_0"].work_duration_sec == pytest.approx(12.0)


def test_incremental_window(spark):
    table = raw(
        spark,
        {"id": "old", "date": "2024-01-06T23:59:59Z"}, {"id": "edge", "date": "2024-01-07T00:00:00Z"},
        {"id": "new", "date": "2024-01-20"}, {"id": "bad", "date": "n/a"}, {"id": "none"},
    )
    marks = spark.createDataFrame(
        [("logbook", datetime(2024, 1, 10)), ("other", datetime(2024, 1, 30))], S.SYNC_STATE
    )
    kept = lambda *a, **k: {r.id for r in ingest.incremental(table, marks, *a, **k).collect()}
    assert kept("logbook") == {"edge", "new"}
    assert kept("logbook", replay_days=4) == {"old", "edge", "new"}
    assert kept("first time") == {"old", "edge", "new", "bad", "none"}


def test_sync_lookup_always_has_one_row(spark):
    marks = spark.createDataFrame([("a", datetime(2024, 1, 10))], S.SYNC_STATE)
    assert rows(ingest.last_sync(marks, "a")) == [(datetime(2024, 1, 10),)]
    assert rows(ingest.last_sync(marks, "b")) == [(None,)]
