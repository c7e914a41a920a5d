from datetime import date, datetime

from helpers import by_id, rows

from trainlake import schemas as S
from trainlake.operators import upsert

OLD, NEW = datetime(2024, 1, 1), datetime(2024, 2, 1)


def test_last_of_a_batch_wins(spark):
    stored = spark.createDataFrame(
        [("a", 1, OLD, 500, 100, 100.0, OLD, OLD), ("b", 1, OLD, 600, 100, 100.0, OLD, OLD)], S.SESSIONS
    )
    batch = spark.createDataFrame(
        [("a", 1, OLD, 700, 100, 90.0, 1), ("a", 1, OLD, 800, 100, 80.0, 2), ("c", 2, OLD, 900, 100, 70.0, 3)],
        S.struct("workout_id STRING, athlete_id BIGINT, workout_date TIMESTAMP_NTZ, distance_m INT, duration_sec INT,"
                 " avg_split_sec FLOAT, ordinal INT"),
    )
    found = by_id(upsert.upsert_sessions(stored, batch, NEW))
    assert {k: r.distance_m for k, r in found.items()} == {"a": 800, "b": 600, "c": 900}
    assert found["a"].created_at == NEW and found["b"].created_at == OLD and found["c"].updated_at == NEW
    again = upsert.upsert_sessions(upsert.upsert_sessions(stored, batch, NEW), batch, NEW)
    assert rows(again) == rows(upsert.upsert_sessions(stored, batch, NEW))


def test_empty_batch_changes_nothing(spark):
    stored = spark.createDataFrame([("a", 1, OLD, 500, 100, 100.0, OLD, OLD)], S.SESSIONS)
    batch = stored.drop("created_at", "updated_at").selectExpr("*", "1 AS ordinal").limit(0)
    assert rows(upsert.upsert_sessions(stored, batch, NEW)) == rows(stored)


def test_shorter_repeat_leaves_the_tail(spark):
    stored = spark.createDataFrame(
        [(f"w_{i}", "w", i, 60.0, None, 250, 120.0, 20, OLD) for i in range(3)], S.INTERVALS
    )
    batch = stored.where("interval_index < 2").drop("created_at").selectExpr("* EXCEPT (spm)", "25 AS spm", "1 AS ordinal")
    found = by_id(upsert.upsert_intervals(stored, batch, NEW), "interval_id")
    assert {k: (r.spm, r.created_at) for k, r in found.items()} == {
        "w_0": (25, NEW), "w_1": (25, NEW), "w_2": (20, OLD)
    }


def test_recovery_keeps_the_first_creation_time(spark):
    row = lambda day, stress, created: (1, date(2024, 1, day), 70, "LOW", 60, 50, stress, None, created)
    stored = spark.createDataFrame([row(1, 10, OLD), row(2, 20, OLD)], S.RECOVERY_DAILY)
    batch = spark.createDataFrame([row(2, 21, None), row(3, 30, None)], S.RECOVERY_DAILY).selectExpr(
        "* EXCEPT (created_at)", "1 AS ordinal"
    )
    found = {r.record_date.day: (r.stress, r.created_at) for r in upsert.upsert_recovery(stored, batch, NEW).collect()}
    assert found == {1: (10, OLD), 2: (21, OLD), 3: (30, NEW)}


def test_sync_marks(spark):
    stored = spark.createDataFrame([("a", OLD), ("b", OLD)], S.SYNC_STATE)
    marks = spark.createDataFrame([("b", NEW), ("c", OLD), ("c", NEW)], S.SYNC_STATE)
    assert rows(upsert.mark_synced(stored, marks), ["source_name", "last_sync_ts"]) == [("a", OLD), ("b", NEW), ("c", NEW)]
