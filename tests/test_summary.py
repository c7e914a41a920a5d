from datetime import date

import pytest
from helpers import by_id, day, rows, sessions
from pyspark.sql import functions as F

from trainlake.operators import metrics, summary


def table(spark):
    return sessions(
        spark,
        [(1, "a", day(0), 2000, 600, 136.2), (1, "b", day(3), 5000, 1351, 135.0), (1, "c", day(9), 800, 200, 120.0),
         (2, "d", day(1), 400, 200, 250.0), (3, "e", day(2), 1000, 400, 150.0), (3, "f", day(4), 1000, 400, 150.0)],
    )


def test_latest_and_personal_best(spark):
    m = metrics.daily_metrics(table(spark))
    latest = by_id(summary.latest_session(m), "athlete_id")
    assert {k: r.workout_id for k, r in latest.items()} == {1: "c", 3: "f"}
    best = by_id(summary.personal_best(table(spark)), "athlete_id")
    assert best[1].personal_best == "2:15.0/500m (135.0s) on Jan 04"  # 800 m is too short
    assert best[3].best_date == day(2) and 2 not in best


def test_session_summary(spark):
    s = table(spark).where("workout_id < 'c'")
    row = summary.session_summary(metrics.newest_metrics(s), s).first()
    assert (row.split_formatted, row.prev_split_formatted) == ("2:15.0/500m", "2:16.2/500m")
    assert (row.split_raw_sec, row.delta_sec, row.duration_min) == (135.0, -1.2, 22.5)
    assert row.delta_direction == "FASTER (improved)" and row.trend.startswith("improving")
    assert "split_raw_sec" not in summary.without_raw_splits(summary.session_summary(m := metrics.newest_metrics(s), s)).columns
    first = summary.session_summary(metrics.newest_metrics(s.where("workout_id = 'a'")), s).first()
    assert (first.prev_split_formatted, first.delta_sec, first.delta_direction, first.trend) == ("—", None, None, None)
    assert m is not None


def test_no_personal_best(spark):
    s = sessions(spark, [(1, "a", day(0), 800, 240, 150.0)])
    assert summary.session_summary(metrics.newest_metrics(s), s).first().personal_best_split == "N/A"
    assert summary.brief_summary(metrics.newest_metrics(s)).first().trend is None


def week_table(spark):
    rows_ = [(1, f"x{i}", day(i), 2150, 603, 150.0 + i) for i in range(3)]  # Monday to Wednesday
    rows_ += [(1, "y", day(13, 23), 4300, 900, 149.0)]  # Sunday of the next week
    rows_ += [(1, "z", day(28), 4300, 900, 149.0)]
    return metrics.daily_metrics(sessions(spark, rows_))


def test_weekly_summary(spark):
    found = {r.week_start: r for r in summary.weekly_summary(week_table(spark)).collect()}
    assert set(found) == {date(2024, 1, 1), date(2024, 1, 8), date(2024, 1, 29)}
    first = found[date(2024, 1, 1)]
    assert (first.sessions_completed, first.total_volume_m, first.total_volume_km) == (3, 6450, round(6450 / 1000, 1))
    assert (first.total_duration_min, first.avg_split_sec, first.avg_split_formatted) == (round(1809 / 60, 1), 151.0, "2:31.0/500m")
    assert (first.fatigue_days, first.flagged_rows) == (0, 3)


def test_week_over_week_needs_the_week_before(spark):
    found = {r.week_start: r for r in summary.week_over_week(summary.weekly_summary(week_table(spark))).collect()}
    second = found[date(2024, 1, 8)]
    assert (second.prev_sessions, second.sessions_change, second.sessions_better, second.sessions_text) == (3.0, -2.0, False, "↓2.0")
    assert (second.split_change, second.split_better, second.split_text) == (-2.0, True, "↓2.0s")
    for start in (date(2024, 1, 1), date(2024, 1, 29)):  # no week before, or a gap
        assert found[start].prev_sessions is None and found[start].volume_text is None


@pytest.mark.parametrize("now, then", [(0.0, 5.0), (5.0, 0.0), (5.0, 5.005), (None, 5.0)])
def test_blank_changes(spark, now, then):
    weekly = spark.createDataFrame(
        [(1, date(2024, 1, 1), then, 1, 150.0, 30.0), (1, date(2024, 1, 8), now, 1, 150.0, 30.0)],
        "athlete_id long, week_start date, total_volume_km double, sessions_completed long, avg_split_sec double,"
        " total_duration_min double",
    )
    row = summary.week_over_week(weekly).where("week_start = '2024-01-08'").first()
    assert row.volume_change is None and row.volume_better is None and row.volume_text is None


def test_iso_weeks_keep_their_year(spark):
    s = sessions(spark, [(1, "a", day(-2), 1000, 300, 150.0), (1, "b", day(0), 500, 150, 150.0), (1, "c", day(364), 700, 200, 150.0)])
    assert rows(summary.iso_week_volume(s), ["iso_year", "iso_week", "distance_m"]) == [
        (2023, 52, 1000), (2024, 1, 500), (2025, 1, 700)
    ]


def test_calendar_shows_the_last_session_of_a_day(spark):
    s = sessions(
        spark,
        [(1, "a", day(1, 8), 1000, 300, 150.0), (1, "b", day(1, 18), 2500, 700, 150.0), (1, "c", day(8), 9000, 900, 150.0),
         (2, "d", day(20), 700, 200, 150.0)],
    )
    found = summary.week_calendar(s, "2024-01-03").orderBy("athlete_id", "day").collect()
    assert [r.km for r in found[:7]] == [0, 2.5, 0, 0, 0, 0, 0] and [r.km for r in found[7:]] == [0] * 7
    assert (found[1].day_text, found[1].km_text, found[0].km_text) == ("2 Jan", "2.5km", "")


def test_week_rows_fill_gaps(spark):
    m = metrics.daily_metrics(sessions(spark, [(1, "a", day(0), 1000, None, 150.0), (1, "b", day(2, 23), 1000, 60, 150.0), (1, "c", day(3), 1000, 60, 150.0)]))
    found = summary.week_rows(m, "2024-01-01", "2024-01-03").collect()
    assert [(r.workout_id, r.duration_sec, r.weekly_load_min) for r in found] == [("a", 0.0, 0.0), ("b", 60.0, 1.0)]


def test_goals_and_phases(spark):
    goals = spark.createDataFrame([("a", 536, 495), ("b", 134, 1000), ("c", 0, 5)], "label string, current int, target int")
    assert rows(summary.goal_progress(goals), ["label", "progress_pct"]) == [("a", 100), ("b", 13), ("c", 0)]
    s = sessions(spark, [(1, "a", day(0), 1, 1, 1.0), (1, "b", day(41), 1, 1, 1.0), (1, "c", day(42), 1, 1, 1.0), (1, "d", day(209), 1, 1, 1.0), (1, "e", day(210), 1, 1, 1.0), (1, "f", day(-1), 1, 1, 1.0)])
    found = by_id(summary.training_phases(s, "2024-01-01"))
    assert [found[k].phase for k in "abcdef"] == ["Base Aerobic", "Base Aerobic", "Aerobic Threshold", "Competition", None, None]


def test_staleness(spark):
    latest = sessions(spark, [(i, "a", day(5), 1, 1, 1.0) for i in range(1, 6)]).select("athlete_id", "workout_date")
    summaries = spark.createDataFrame(
        [(1, "2024-01-06 08:00:00"), (2, "2024-01-06 07:59:59"), (3, "soon"), (4, "2024-02-01")],
        "athlete_id long, summary_date string",
    )
    assert rows(summary.stale_summaries(latest, summaries), ["athlete_id", "is_stale"]) == [
        (1, False), (2, True), (3, True), (4, False), (5, True)
    ]


def test_display_attributes_of_unknown_values(spark):
    m = spark.createDataFrame([(1, "a", "caution", "race"), (1, "b", "?", None)], "athlete_id long, workout_id string, fatigue_flag string, session_type string")
    found = by_id(summary.display_attributes(m))
    assert (found["a"].fatigue_marker, found["a"].session_colour) == ("🟡", "#ef4444")
    assert (found["b"].fatigue_colour, found["b"].fatigue_marker, found["b"].session_colour) == (0x00E5B4, "🟢", "#7a8ba8")


@pytest.mark.parametrize("taper, delta, tag", [(True, -1.0, "recovery"), (False, -1.0, "performance"), (False, 0.5, "caution"), (None, None, "caution")])
def test_tag_of_generated_notes(one, taper, delta, tag):
    assert one(summary.generated_note_tag(F.lit(taper).cast("boolean"), F.lit(delta).cast("double"))) == tag
