"""Per-athlete and per-week summaries of the session metrics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainlake import schemas as S
from trainlake.functions import dates, text
from trainlake.operators.metrics import SESSION_ORDER


# ---- One row per athlete ------------------------------------------------------------------------
def latest_session(metrics: DataFrame) -> DataFrame:
    """The newest row of each athlete of a table that is stored. Straight from the sessions,
    ``metrics.newest_metrics`` gives the same with much less work."""
    others = [c for c in metrics.columns if c != "athlete_id"]
    newest = F.max_by(F.struct(*others), F.struct(*SESSION_ORDER)).alias("newest")
    return (
        metrics.where(F.col("avg_split_sec").isNotNull())
        .groupBy("athlete_id")
        .agg(newest)
        .select("athlete_id", "newest.*")
    )


def fastest_session(sessions: DataFrame, min_distance_m: int = S.PERSONAL_BEST_MIN_DISTANCE_M) -> DataFrame:
    """The fastest session over at least ``min_distance_m``; the earliest of equal ones."""
    others = [c for c in sessions.columns if c != "athlete_id"]
    fastest = F.min_by(F.struct(*others), F.struct("avg_split_sec", *SESSION_ORDER)).alias("fastest")
    return (
        sessions.where(F.col("avg_split_sec").isNotNull() & (F.col("distance_m") >= min_distance_m))
        .groupBy("athlete_id")
        .agg(fastest)
        .select("athlete_id", "fastest.*")
    )


def personal_best(sessions: DataFrame) -> DataFrame:
    best = F.col("avg_split_sec")
    return fastest_session(sessions).select(
        "athlete_id",
        best.alias("best_split_sec"),
        F.col("workout_date").alias("best_date"),
        F.concat(
            text.format_split(best), F.lit(" ("), text.one_digit(best), F.lit("s) on "),
            F.date_format("workout_date", "MMM dd"),
        ).alias("personal_best"),
    )


def session_summary(latest: DataFrame, sessions: DataFrame) -> DataFrame:
    """The newest session (one metrics row per athlete) with the formatted fields and the personal best."""
    best = personal_best(sessions).select("athlete_id", "personal_best")
    delta = F.col("delta")
    return latest.join(best, "athlete_id", "left").select(
        "athlete_id",
        F.col("workout_date").alias("session_time"),
        text.format_split(F.col("avg_split_sec")).alias("split_formatted"),
        text.round_tenths(F.col("avg_split_sec")).alias("split_raw_sec"),
        text.format_split(F.col("prev_split")).alias("prev_split_formatted"),
        text.round_tenths(delta).alias("delta_sec"),
        text.direction(delta).alias("delta_direction"),
        text.format_split(F.col("rolling_avg_split")).alias("rolling_split_formatted"),
        text.round_tenths(F.col("duration_sec") / F.lit(60.0)).alias("duration_min"),
        "distance_m",
        F.col("fatigue_flag").alias("fatigue"),
        text.round_tenths(F.col("weekly_load_min")).alias("weekly_load_min"),
        "session_type",
        text.trend(delta).alias("trend"),
        F.coalesce("personal_best", F.lit("N/A")).alias("personal_best_split"),
        text.round_hundredths(F.col("consistency")).alias("consistency_stddev"),
    )


def without_raw_splits(summary: DataFrame) -> DataFrame:
    """The summary as it goes into a prompt: raw seconds are left out."""
    return summary.drop("split_raw_sec")


def brief_summary(latest: DataFrame) -> DataFrame:
    return latest.select(
        "athlete_id",
        F.col("workout_date").alias("session_time"),
        text.round_tenths(F.col("avg_split_sec")).alias("split"),
        F.col("delta").cast("double").alias("delta"),
        text.round_tenths(F.col("rolling_avg_split")).alias("rolling_split"),
        text.round_tenths(F.col("duration_sec") / F.lit(60.0)).alias("duration_min"),
        "distance_m",
        text.round_tenths(F.col("weekly_load_min")).alias("weekly_load_min"),
        "fatigue_flag",
        "session_type",
        text.short_trend(F.col("delta")).alias("trend"),
    )


def generated_note_tag(taper_active: Column, delta: Column) -> Column:
    """Tag of an automatic note: a planned recovery row, a faster session, or neither."""
    return F.when(taper_active, "recovery").when(delta < 0, "performance").otherwise("caution")


def stale_summaries(latest: DataFrame, summaries: DataFrame) -> DataFrame:
    """``latest`` (athlete_id, workout_date) against ``summaries`` (athlete_id, summary_date text):
    stale when the summary has no readable date or an older one than the newest session."""
    covered = dates.parse_iso(F.col("summary_date"))
    newest = F.col("workout_date")
    stale = newest.isNotNull() & (covered.isNull() | (covered < newest))
    return latest.join(summaries, "athlete_id", "left").select(
        "athlete_id", newest.alias("latest_session"), covered.alias("summary_time"), stale.alias("is_stale")
    )


# ---- Weeks --------------------------------------------------------------------------------------
def week_rows(metrics: DataFrame, first: date | str, last: date | str) -> DataFrame:
    """Sessions of a date range, in time order, with the gaps filled."""
    day = F.col("workout_date").cast("date")
    in_range = day.between(dates.day_literal(first), dates.day_literal(last))
    return (
        metrics.where(in_range & F.col("avg_split_sec").isNotNull())
        .select(
            "athlete_id",
            "workout_id",
            "workout_date",
            F.col("avg_split_sec").cast("double").alias("avg_split_sec"),
            "distance_m",
            F.coalesce(F.col("duration_sec").cast("double"), F.lit(0.0)).alias("duration_sec"),
            F.coalesce("session_type", F.lit("steady")).alias("session_type"),
            "fatigue_flag",
            F.coalesce("weekly_load_min", F.lit(0.0)).alias("weekly_load_min"),
        )
        .orderBy(*SESSION_ORDER)
    )


def weekly_summary(metrics: DataFrame) -> DataFrame:
    """Totals per athlete and week that has sessions. ``flagged_rows`` counts every row with a flag text,
    ``fatigue_days`` only those flagged as fatigue."""
    split = F.avg(F.col("avg_split_sec").cast("double"))
    metres = F.sum(F.col("distance_m").cast("bigint"))
    flag = F.col("fatigue_flag")
    return (
        metrics.where(F.col("avg_split_sec").isNotNull())
        .groupBy("athlete_id", dates.week_start(F.col("workout_date")).alias("week_start"))
        .agg(
            F.count(F.lit(1)).alias("sessions_completed"),
            metres.alias("total_volume_m"),
            (F.sum(F.col("duration_sec").cast("bigint")) / F.lit(60.0)).alias("minutes"),
            split.alias("mean_split"),
            F.count_if(flag == "fatigue").alias("fatigue_days"),
            F.count_if(flag != "").alias("flagged_rows"),
        )
        .select(
            "athlete_id",
            "week_start",
            "sessions_completed",
            "total_volume_m",
            text.round_tenths(F.col("total_volume_m") / F.lit(1000.0)).alias("total_volume_km"),
            text.round_tenths(F.col("minutes")).alias("total_duration_min"),
            text.round_tenths(F.col("mean_split")).alias("avg_split_sec"),
            text.format_split(F.col("mean_split")).alias("avg_split_formatted"),
            "fatigue_days",
            "flagged_rows",
        )
    )


_WEEK_VALUES = {  # value -> (short name, unit, lower is better)
    "total_volume_km": ("volume", " km", False),
    "sessions_completed": ("sessions", "", False),
    "avg_split_sec": ("split", "s", True),
    "total_duration_min": ("duration", " min", False),
}


def week_over_week(weekly: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Each week beside the one seven days before it, with the columns ``more`` of the week. A change is blank when either value is missing or
    zero, or when it is below 0.01. The weekly table is small, so ``lag`` needs no second aggregation."""
    by_week = Window.partitionBy("athlete_id").orderBy("week_start")
    before = F.lag(F.struct("week_start", *_WEEK_VALUES)).over(by_week)
    paired = weekly.withColumn("before", before).withColumn(
        "before",
        F.when(F.col("before.week_start") == F.date_sub("week_start", 7), F.col("before")),
    )
    changes, columns = {}, []
    for value, (name, unit, lower_is_better) in _WEEK_VALUES.items():
        now, then = F.col(value).cast("double"), F.col(f"before.{value}").cast("double")
        usable = (now != 0) & (then != 0) & (F.abs(now - then) >= 0.01)
        changes[f"prev_{name}"] = then
        changes[f"exact_{name}"] = F.when(usable, now - then)
        change = F.col(f"exact_{name}")
        arrow = F.when(change < 0, "↓").otherwise("↑")
        columns += [
            f"prev_{name}",
            text.round_tenths(change).alias(f"{name}_change"),
            ((change < 0) if lower_is_better else (change > 0)).alias(f"{name}_better"),
            F.concat(arrow, text.one_digit(F.abs(change)), F.lit(unit)).alias(f"{name}_text"),
        ]
    return paired.withColumns(changes).select("athlete_id", "week_start", *_WEEK_VALUES, *columns, *more)


def weekly_review(metrics: DataFrame, recovery: DataFrame) -> DataFrame:
    """Per athlete and week: spread of the splits, best and worst session, and how the split goes with the body battery of
    the day (NULL where either does not vary)."""
    split, battery = F.col("avg_split_sec").cast("double"), F.col("body_battery").cast("double")
    beside = metrics.withColumn("record_date", F.col("workout_date").cast("date")).join(
        recovery.select("athlete_id", "record_date", "body_battery"), ["athlete_id", "record_date"], "left"
    )
    both = F.when(battery.isNotNull(), split)
    varies = (F.max(both) > F.min(both)) & (F.max(battery) > F.min(battery))
    place = F.struct(split, "workout_date", "workout_id")
    return (
        beside.where(split.isNotNull())
        .groupBy("athlete_id", dates.week_start(F.col("workout_date")).alias("week_start"))
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            (F.max(split) - F.min(split)).alias("split_spread"),
            F.min_by("workout_id", place).alias("best_workout"),
            F.max_by("workout_id", place).alias("worst_workout"),
            F.when(varies, F.try_divide(F.covar_pop(both, battery), F.stddev_pop(both) * F.stddev_pop(battery))).alias("battery_correlation"),
        )
    )


def calendar_load(sessions: DataFrame) -> DataFrame:
    """Minutes per athlete and training day, and over the seven calendar days that end with it. Days are summed first, so a
    window holds no more rows than an athlete has days, however many sessions there are."""
    daily = sessions.groupBy("athlete_id", F.col("workout_date").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum(F.col("duration_sec").cast("bigint")).alias("seconds")
    )
    week = Window.partitionBy("athlete_id").orderBy(F.unix_date("day")).rangeBetween(-6, 0)
    return daily.select(
        "athlete_id", "day", "sessions", (F.col("seconds") / F.lit(60.0)).alias("day_min"),
        (F.sum("seconds").over(week) / F.lit(60.0)).alias("load_7d_min"),
    )


def iso_week_volume(metrics: DataFrame) -> DataFrame:
    day = F.col("workout_date").cast("date")
    return metrics.groupBy(
        "athlete_id",
        F.extract(F.lit("YEAROFWEEK"), day).cast("int").alias("iso_year"),
        F.weekofyear(day).alias("iso_week"),
    ).agg(F.sum(F.col("distance_m").cast("bigint")).alias("distance_m"))


def week_calendar(metrics: DataFrame, as_of: date | str) -> DataFrame:
    """Seven rows per athlete for the week of ``as_of``; a day shows its last session, or zero.

    Only the sessions of the week are aggregated, with a conditional column per day instead of a calendar table; of all
    others only the athlete is read.
    """
    monday = dates.week_start(dates.day_literal(as_of))
    day = F.col("workout_date").cast("date")
    first = monday.cast("timestamp_ntz")
    of_week = (F.col("workout_date") >= first) & (F.col("workout_date") < F.date_add(monday, 7).cast("timestamp_ntz"))
    last_of_day = [
        F.max_by("distance_m", F.when(day == F.date_add(monday, i), F.struct(*SESSION_ORDER))).alias(f"day_{i}")
        for i in range(7)
    ]
    week = metrics.where(of_week).groupBy("athlete_id").agg(*last_of_day)
    per_athlete = metrics.select("athlete_id").distinct().join(week, "athlete_id", "left")
    days = F.array(
        *[F.struct(F.date_add(monday, i).alias("day"), F.col(f"day_{i}").alias("metres")) for i in range(7)]
    )
    km = F.coalesce(F.col("metres") / F.lit(1000.0), F.lit(0.0))
    return per_athlete.select("athlete_id", F.inline(days)).select(
        "athlete_id",
        "day",
        F.date_format("day", "d MMM").alias("day_text"),
        km.alias("km"),
        F.when(km > 0, F.concat(text.one_digit(km), F.lit("km"))).otherwise("").alias("km_text"),
    )


# ---- Row-level views ----------------------------------------------------------------------------
def session_history(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        "athlete_id",
        "workout_id",
        "workout_date",
        "distance_m",
        text.round_tenths_by_product(F.col("duration_sec") / F.lit(60.0)).alias("duration_min"),
        text.format_split(F.col("avg_split_sec"), suffix="").alias("split"),
        text.signed_seconds(F.col("delta")).alias("delta_s"),
        "session_type",
        F.col("fatigue_flag").alias("fatigue"),
        "weekly_load_min",
    )


def load_vs_performance(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        "athlete_id", "workout_id", "weekly_load_min", "avg_split_sec", "distance_m", "session_type"
    )


def display_attributes(metrics: DataFrame) -> DataFrame:
    """Colour and marker of each session; unknown values get those of a normal or unknown session."""
    colours = _lookup(S.FATIGUE_COLOURS)[F.col("fatigue_flag")]
    markers = _lookup(S.FATIGUE_MARKERS)[F.col("fatigue_flag")]
    types = _lookup(S.SESSION_COLOURS)[F.col("session_type")]
    return metrics.select(
        "athlete_id",
        "workout_id",
        F.coalesce(colours, F.lit(S.FATIGUE_COLOURS["normal"])).alias("fatigue_colour"),
        F.coalesce(markers, F.lit(S.FATIGUE_MARKERS["normal"])).alias("fatigue_marker"),
        F.coalesce(types, F.lit(S.UNKNOWN_SESSION_COLOUR)).alias("session_colour"),
    )


def _lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


def goal_progress(goals: DataFrame) -> DataFrame:
    """``goals`` (…, current, target) with the whole percentage reached, at most 100; NULL for a target of zero."""
    share = (F.try_divide("current", "target") * 100).cast("int")
    return goals.withColumn("progress_pct", F.least(share, F.lit(100)))


def training_phases(sessions: DataFrame, training_start: date | str) -> DataFrame:
    """Programme week and phase of each session. The few fixed week ranges become a lookup by week, so no
    range join is needed."""
    phases = {week: name for first, last, name in S.TRAINING_PHASES for week in range(first, last + 1)}
    week = dates.training_week(F.col("workout_date"), training_start)
    return sessions.withColumn("training_week", week).withColumn("phase", _lookup(phases)[F.col("training_week")])


def countdown(sessions: DataFrame, competition: date | str, training_start: date | str) -> DataFrame:
    """Days left to the competition (not below 0) and days since the start, as seen on each session day."""
    day = F.col("workout_date")
    return sessions.select(
        "athlete_id",
        "workout_id",
        dates.days_left(day, competition).alias("days_left"),
        dates.training_day(day, training_start).alias("training_day"),
    )
