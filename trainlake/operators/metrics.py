"""The derived table of per-athlete session metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trainlake import schemas as S
from trainlake.operators.skew import DEFAULT_MAX_ROWS, best_rows, earliest_first, over_recent_history

SESSION_ORDER = ["workout_date", "workout_id"]


def is_eligible() -> Column:
    return (F.col("distance_m") >= S.MIN_DISTANCE_M) & (F.col("avg_split_sec") <= S.MAX_SPLIT_SEC)


def eligible_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions that count for the metrics. Always before the windows: frames skip the others."""
    return sessions.where(is_eligible())


def session_type(
    split: Column, race: float = S.RACE_MAX_SPLIT_SEC, threshold: float = S.THRESHOLD_MAX_SPLIT_SEC
) -> Column:
    return F.when(split <= race, "race").when(split <= threshold, "threshold").otherwise("steady")


def fatigue_flag(delta: Column, load_min: Column) -> Column:
    return (
        F.when((delta > S.FATIGUE_DELTA_SEC) & (load_min > S.FATIGUE_LOAD_MIN), "fatigue")
        .when(delta > S.CAUTION_DELTA_SEC, "caution")
        .otherwise("normal")
    )


def _history_columns(rows: DataFrame, window: WindowSpec) -> DataFrame:
    split = F.col("avg_split_sec")
    last = lambda n: window.rowsBetween(1 - n, 0)
    return rows.select(
        "*",
        F.lag(split).over(window).alias("prev_split"),
        F.avg(split).over(last(S.ROLLING_SESSIONS)).alias("rolling_avg_split"),
        F.stddev_samp(split).over(last(S.SPREAD_SESSIONS)).alias("consistency"),
        (F.sum("duration_sec").over(last(S.LOAD_SESSIONS)).cast("double") / 60).alias("weekly_load_min"),
    )


def daily_metrics(sessions: DataFrame, max_rows_per_athlete: int = DEFAULT_MAX_ROWS) -> DataFrame:
    """Previous split, change, rolling mean, spread, load, session type and fatigue flag per session.

    One shuffle by athlete and one sort serve all windows. Athletes with more sessions than
    ``max_rows_per_athlete`` are cut into ordered segments (see ``skew``).
    """
    history = over_recent_history(
        _metric_inputs(sessions), "athlete_id", SESSION_ORDER, S.LOAD_SESSIONS - 1, _history_columns,
        max_rows_per_athlete,
    )
    return _classified(history)


def newest_metrics(sessions: DataFrame) -> DataFrame:
    """``daily_metrics`` of the newest session of each athlete only.

    It depends on the newest seven sessions, so every input partition is cut to seven rows per athlete
    before the shuffle and no athlete is ever large.
    """
    newest_first = [F.desc_nulls_last(name) for name in SESSION_ORDER]
    recent = best_rows(_metric_inputs(sessions), "athlete_id", newest_first, S.LOAD_SESSIONS)
    in_order = Window.partitionBy("athlete_id").orderBy(*earliest_first(SESSION_ORDER))
    return _classified(_history_columns(recent, in_order).where(F.col("rank") == 1))


def _metric_inputs(sessions: DataFrame) -> DataFrame:
    return eligible_sessions(sessions).select(
        "athlete_id", "workout_id", "workout_date", "avg_split_sec", "duration_sec", "distance_m"
    )


def _classified(history: DataFrame) -> DataFrame:
    with_delta = history.withColumn("delta", F.col("avg_split_sec") - F.col("prev_split"))
    return with_delta.select(
        "athlete_id", "workout_id", "workout_date", "avg_split_sec", "duration_sec", "distance_m",
        "prev_split", "delta", "rolling_avg_split", "consistency", "weekly_load_min",
        session_type(F.col("avg_split_sec")).alias("session_type"),
        fatigue_flag(F.col("delta"), F.col("weekly_load_min")).alias("fatigue_flag"),
    )


def row_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("n_rows"))
