import statistics

import pytest
from helpers import by_id, day, rows, sessions

from trainlake.operators import metrics


def test_first_session_has_no_history(spark):
    row = metrics.daily_metrics(sessions(spark, [(1, "a", day(0), 2000, 600, 150.0)])).first()
    assert row.prev_split is None and row.delta is None and row.consistency is None
    assert (row.rolling_avg_split, row.weekly_load_min, row.fatigue_flag) == (150.0, 10.0, "normal")


def test_frames(spark):
    splits = [150.0, 149.0, 152.5, 151.0, 148.0, 155.0, 147.0, 149.5, 150.5]
    table = sessions(spark, [(1, str(i), day(i), 2000, 600 + i, s) for i, s in enumerate(splits)])
    found = by_id(metrics.daily_metrics(table))
    for i, split in enumerate(splits):
        row = found[str(i)]
        assert row.prev_split == (splits[i - 1] if i else None)
        assert row.rolling_avg_split == pytest.approx(statistics.mean(splits[max(0, i - 1): i + 1]))
        if i:
            assert row.delta == split - splits[i - 1]
            assert row.consistency == pytest.approx(statistics.stdev(splits[max(0, i - 3): i + 1]))
        assert row.weekly_load_min == pytest.approx(sum(600 + j for j in range(max(0, i - 6), i + 1)) / 60)


def test_frames_skip_ineligible_sessions(spark):
    table = sessions(
        spark,
        [(1, "a", day(0), 2000, 600, 150.0), (1, "short", day(1), 499, 100, 100.0), (1, "slow", day(2), 2000, 900, 300.5),
         (1, "none", day(3), 2000, 900, None), (1, "b", day(4), 500, 120, 300.0)],
    )
    found = by_id(metrics.daily_metrics(table))
    assert set(found) == {"a", "b"}
    assert found["b"].prev_split == 150.0


def test_athletes_are_apart_and_ties_ordered(spark):
    table = sessions(
        spark,
        [(1, "b", day(0), 2000, 600, 150.0), (1, "a", day(0), 2000, 600, 140.0), (2, "c", day(1), 2000, 600, 160.0)],
    )
    found = by_id(metrics.daily_metrics(table))
    assert found["a"].prev_split is None and found["b"].prev_split == 140.0 and found["c"].prev_split is None


@pytest.mark.parametrize(
    "split, kind", [(140.0, "race"), (140.5, "threshold"), (145.0, "threshold"), (145.5, "steady")]
)
def test_session_types(spark, split, kind):
    table = sessions(spark, [(1, "a", day(0), 2000, 600, split)])
    assert metrics.daily_metrics(table).first().session_type == kind


@pytest.mark.parametrize(
    "delta, minutes, flag",
    [(2.5, 31, "fatigue"), (2.0, 31, "caution"), (2.5, 30, "caution"), (1.0, 31, "normal"), (1.5, 1, "caution"), (-5.0, 50, "normal")],
)
def test_fatigue(spark, delta, minutes, flag):
    table = sessions(
        spark, [(1, "a", day(0), 2000, minutes * 60, 150.0), (1, "b", day(1), 2000, minutes * 60, 150.0 + delta)]
    )
    assert by_id(metrics.daily_metrics(table))["b"].fatigue_flag == flag


def test_empty_input(spark):
    assert metrics.daily_metrics(sessions(spark, [])).collect() == []
    assert metrics.row_count(sessions(spark, [])).first().n_rows == 0


def test_newest_metrics_are_those_of_the_newest_session(spark):
    table = sessions(
        spark,
        [(a, f"{a}-{i}", day(i), 400 + 300 * (i % 4), 600 + i, 140.0 + (i * 7) % 11) for a in range(3) for i in range(12)],
    )
    everything = metrics.daily_metrics(table)
    newest = {a: max((r for r in everything.collect() if r.athlete_id == a), key=lambda r: r.workout_date) for a in range(3)}
    for row in metrics.newest_metrics(table).select(*everything.columns).collect():
        assert tuple(row) == tuple(newest[row.athlete_id])


@pytest.mark.parametrize("limit", [1, 3, 7, 40])
def test_splitting_a_run_of_equal_sessions(spark, limit):
    """All sessions are copies of one: only the first has no history."""
    df = sessions(spark, [(1, "same", day(0), 2000, 600, 150.0)] * 60)
    found = metrics.daily_metrics(df, limit).collect()
    assert len(found) == 60 and sorted(r.weekly_load_min for r in found)[:8] == [10.0 * min(i + 1, 7) for i in range(8)]
    assert sum(r.prev_split is None for r in found) == 1


@pytest.mark.parametrize("limit", [1, 3, 7, 40])
def test_splitting_hot_athletes_changes_nothing(spark, limit):
    """One athlete holds most rows, many of them at the very same time."""
    table = [(1, f"{i:04}", day(i // 40), 400 + i % 300, 600 + i % 7, 140.0 + (i * 37) % 23) for i in range(200)]
    table += [(2, f"x{i}", day(i), 2000, 600, 150.0 + i) for i in range(9)] + [(3, "y", day(0), 2000, 600, 150.0)]
    table += [(None, f"z{i}", day(i), 2000, 600, 150.0 + i) for i in range(9)]
    df = sessions(spark, table)
    assert rows(metrics.daily_metrics(df, limit)) == rows(metrics.daily_metrics(df))
