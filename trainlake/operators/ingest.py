"""Raw workouts to session and interval rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainlake import schemas as S
from trainlake.functions.dates import parse_iso, utc_time


def split_seconds(duration: Column, distance: Column) -> Column:
    """Seconds per 500 m; NULL when distance or duration is missing or zero."""
    usable = (distance > 0) & (duration != 0)
    return F.when(usable, duration.cast("double") / (distance.cast("double") / F.lit(500.0)))


def session_measures(tenths: Column, distance: Column) -> list[Column]:
    """Duration and split from a raw time in tenths of a second; the split uses the full duration."""
    duration = tenths.cast("double") / 10
    return [
        duration.cast("int").alias("duration_sec"),
        split_seconds(duration, distance).cast("float").alias("avg_split_sec"),
    ]


def valid_workouts(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("time").isNotNull())


def rejected_workouts(raw: DataFrame) -> DataFrame:
    """Workouts without a time; they are set aside and the rest goes on."""
    return raw.where(F.col("time").isNull())


def normalise(raw: DataFrame) -> DataFrame:
    return valid_workouts(raw).select(
        F.col("id").cast("string").alias("workout_id"),
        "athlete_id",
        parse_iso(F.col("date")).alias("workout_date"),
        F.col("distance").alias("distance_m"),
        *session_measures(F.col("time"), F.col("distance")),
    )


def flatten_intervals(raw: DataFrame, interval_time_unit: float = 1.0) -> DataFrame:
    """One row per interval with its position. ``interval_time_unit`` is the length in seconds of one
    unit of the interval time (the session time is in tenths, the interval time is not)."""
    exploded = valid_workouts(raw).select(
        F.col("id").cast("string").alias("workout_id"),
        F.posexplode("intervals").alias("interval_index", "interval"),
    )
    duration = F.col("interval.time") * F.lit(float(interval_time_unit))
    return exploded.select(
        F.concat_ws("_", "workout_id", "interval_index").alias("interval_id"),
        "workout_id",
        "interval_index",
        duration.cast("float").alias("work_duration_sec"),
        F.lit(None).cast("float").alias("rest_duration_sec"),
        F.col("interval.distance").alias("distance_m"),
        split_seconds(duration, F.col("interval.distance")).cast("float").alias("split_sec"),
        F.col("interval.spm").alias("spm"),
    )


def last_sync(sync_state: DataFrame, source: str) -> DataFrame:
    """Exactly one row: the sync time of ``source``, NULL when it has none."""
    return sync_state.where(F.col("source_name") == source).agg(F.max("last_sync_ts").alias("last_sync_ts"))


def incremental(
    raw: DataFrame, sync_state: DataFrame, source: str, replay_days: int = S.REPLAY_DAYS
) -> DataFrame:
    """Rows dated no more than ``replay_days`` before the last sync. The first run keeps everything,
    later runs drop rows whose date cannot be read. The mark is a scalar subquery."""
    mark = last_sync(sync_state, source).scalar()
    since = mark - F.expr(f"INTERVAL {int(replay_days)} DAYS")
    return raw.where(mark.isNull() | (parse_iso(F.col("date")) >= since))


# ---- What comes too late ------------------------------------------------------------------------
def lateness(date_text: Column, mark: Column, replay_days: int) -> Column:
    """Why a workout is not taken in although there is a mark: "before_limit", "no_date", or NULL if it is taken."""
    day = parse_iso(date_text)
    limit = mark - F.expr(f"INTERVAL {int(replay_days)} DAYS")
    return F.when(mark.isNotNull(), F.when(day.isNull(), "no_date").when(day < limit, "before_limit"))


def judged_by_source(raw: DataFrame, sync_state: DataFrame, source: str, replay_days: int | None = S.REPLAY_DAYS) -> DataFrame:
    """``raw`` with ``late``: one mark for all, the last sync of ``source``. What ``incremental`` drops has a reason here."""
    if replay_days is None:
        return raw.withColumn("late", F.lit(None).cast("string"))
    return raw.withColumn("late", lateness(F.col("date"), last_sync(sync_state, source).scalar(), replay_days))


def judged_by_athlete(raw: DataFrame, marks: DataFrame, replay_days: int | None = S.REPLAY_DAYS) -> DataFrame:
    """``raw`` with ``late``: the mark of its own athlete (rows athlete_id, last_sync_ts, any number for each; the newest
    counts). An athlete without a mark is new, and everything is taken."""
    if replay_days is None:
        return raw.withColumn("late", F.lit(None).cast("string"))
    newest = marks.groupBy(F.col("athlete_id").alias("mark_of")).agg(F.max("last_sync_ts").alias("mark"))
    joined = raw.join(newest, F.col("athlete_id").eqNullSafe(F.col("mark_of")), "left")
    return joined.withColumn("late", lateness(F.col("date"), F.col("mark"), replay_days)).drop("mark_of", "mark")


def marks_of(raw: DataFrame, source: str) -> DataFrame:
    """The newest usable date of each athlete in a batch (source_name, athlete_id, last_sync_ts). A date after the landing of
    its file is wrong: it moves no mark."""
    moment = parse_iso(F.col("date"))
    honest = valid_workouts(raw).where(moment <= utc_time(F.col("landed_at")))
    newest = honest.groupBy("athlete_id").agg(F.max(moment).alias("last_sync_ts"))
    return newest.select(F.lit(source).alias("source_name"), "athlete_id", "last_sync_ts")
