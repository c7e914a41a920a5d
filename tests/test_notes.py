from datetime import datetime

import pytest
from helpers import by_id, day, rows, sessions
from pyspark.sql import functions as F

from trainlake import schemas as S
from trainlake.operators import metrics, notes

RAW = "athlete_id BIGINT, created_at TIMESTAMP_NTZ, session_date STRING, author STRING, tip_text STRING, tag STRING, session_type STRING"


def tips(spark, *items):
    base = {"athlete_id": 1, "author": "coach", "tip_text": "Row easy."}
    table = [tuple({**base, **i}.get(n) for n in S.struct(RAW).fieldNames()) for i in items]
    return notes.new_tips(spark.createDataFrame(table, S.struct(RAW)))


def at(hour):
    return datetime(2024, 1, 5, hour)


@pytest.mark.parametrize(
    "tag, kind, taper",
    [("recovery", None, True), (None, "recovery", True), ("performance", None, False), (None, None, False), ("hard", "", False)],
)
def test_taper(spark, tag, kind, taper):
    row = tips(spark, {"created_at": at(8), "tag": tag, "session_type": kind}).first()
    assert row.expect_taper is taper and row.session_type == (kind or None)


def test_author_defaults_to_the_coach(spark):
    assert tips(spark, {"created_at": at(8), "author": None}).first().author == "coach"


def test_newest_first_and_capped(spark):
    table = tips(spark, *[{"created_at": at(i), "tip_text": f"tip {i}"} for i in range(12)])
    newest = lambda *a: [r.tip_text for r in notes.recent_tips(table, *a).orderBy("rank").collect()]
    assert newest(3) == ["tip 11", "tip 10", "tip 9"]
    assert len(newest()) == len(newest(0)) == 10


def test_taper_flag_in_its_states(spark):
    table = tips(
        spark,
        {"athlete_id": 1, "created_at": at(8), "tag": "recovery"}, {"athlete_id": 1, "created_at": at(9), "tag": "hard"},
        {"athlete_id": 2, "created_at": at(8), "tag": "hard"}, {"athlete_id": 2, "created_at": at(9), "session_type": "recovery"},
        {"athlete_id": 2, "created_at": at(10), "author": "athlete"},
        {"athlete_id": 3, "created_at": at(8), "author": "athlete", "tag": "recovery"},
    )
    assert rows(notes.taper_flags(table)) == [(1, False), (2, True)]


def test_context_block(spark):
    table = tips(
        spark,
        {"created_at": at(9), "tag": "recovery", "tip_text": "Second"}, {"created_at": at(8), "author": "athlete", "tip_text": "First"},
        {"created_at": at(7), "tip_text": "Too old"},
    )
    assert notes.context_blocks(table, 2).first().context_block == (
        "[2024-01-05 08:00] Athlete: First\n"
        "[2024-01-05 09:00] Coach [recovery] [TAPER EXPECTED — recovery row]: Second"
    )


def test_tips_meet_the_last_session_of_their_day(spark):
    m = metrics.daily_metrics(sessions(spark, [(1, "a", day(0, 8), 2000, 600, 150.0), (1, "b", day(0, 18), 4500, 1500, 168.6)]))
    table = tips(
        spark,
        {"created_at": at(1), "tip_text": "x", "session_date": "2024-01-01 08:00:00"},
        {"created_at": at(2), "tip_text": "y", "session_date": "2024-01-02"}, {"created_at": at(3), "tip_text": "z"},
        {"athlete_id": 2, "created_at": at(4), "tip_text": "w", "session_date": "2024-01-01"},
    )
    found = by_id(notes.tip_sessions(table, m), "tip_text")
    assert {k: r.session_label for k, r in found.items()} == {
        "x": "4,500 m · 2:48.6", "y": "2024-01-02", "z": "coaching tip", "w": "2024-01-01"
    }


def test_ids_are_unique(spark):
    table = tips(spark, *[{"created_at": at(8), "tip_text": f"tip {i}"} for i in range(50)])
    assert table.select("tip_id").distinct().count() == 50
    assert table.where(F.col("tip_id").startswith("tip_20240105080000000000_")).count() == 50
