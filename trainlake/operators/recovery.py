"""Daily recovery signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainlake import schemas as S

_BATTERY = "ARRAY<STRUCT<charged: DOUBLE>>"
_HRV = "STRUCT<hrvSummary: STRUCT<status: STRING>>"
_SLEEP = "STRUCT<dailySleepDTO: STRUCT<sleepScores: STRUCT<overall: STRUCT<value: DOUBLE>>>>"
_HEART_RATE = (
    "STRUCT<allMetrics: STRUCT<metricsMap: STRUCT<WELLNESS_RESTING_HEART_RATE: ARRAY<STRUCT<value: DOUBLE>>>>>"
)
_STRESS = "STRUCT<overallStressLevel: DOUBLE>"
_READINESS = "ARRAY<STRUCT<score: DOUBLE>>"


def extract_signals(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Six nested JSON documents per athlete and day to one flat row (with the columns ``keep`` beside it). Each signal stands alone: a missing,
    empty or unreadable document makes only its own signal NULL."""
    battery = F.try_element_at(F.from_json("battery_doc", _BATTERY), F.lit(-1))["charged"]
    hrv = F.from_json("hrv_doc", _HRV)["hrvSummary"]["status"]
    sleep = F.from_json("sleep_doc", _SLEEP)["dailySleepDTO"]["sleepScores"]["overall"]["value"]
    beats = F.from_json("heart_rate_doc", _HEART_RATE)["allMetrics"]["metricsMap"]["WELLNESS_RESTING_HEART_RATE"]
    resting = F.try_element_at(beats, F.lit(1))["value"]
    stress = F.from_json("stress_doc", _STRESS)["overallStressLevel"]
    readiness = F.try_element_at(F.from_json("readiness_doc", _READINESS), F.lit(1))["score"]
    return documents.select(
        "athlete_id",
        "record_date",
        battery.cast("int").alias("body_battery"),
        hrv.alias("hrv_status"),
        sleep.cast("int").alias("sleep_score"),
        resting.cast("int").alias("resting_hr"),
        stress.cast("int").alias("stress"),
        readiness.cast("int").alias("readiness"),
        *(keep or []),
    )


def newest_days(recovery: DataFrame, days: int = S.RECOVERY_DAYS) -> DataFrame:
    """The newest ``days`` records of each athlete; partitions are cut to that many before the shuffle."""
    newest = Window.partitionBy("athlete_id").orderBy(F.desc("record_date"))
    return recovery.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= days).drop("rank")


def snapshot(recovery: DataFrame) -> DataFrame:
    """The newest recovery day of each athlete as one nested row."""
    signals = [c for c in recovery.columns if c not in ("athlete_id", "record_date", "created_at")]
    return newest_days(recovery, 1).select("athlete_id", "record_date", F.struct(*signals).alias("signals"))


def recovery_vs_performance(
    metrics: DataFrame, recovery: DataFrame, days: int | None = S.RECOVERY_DAYS
) -> DataFrame:
    """Sessions beside the recovery signals of their day (the newest ``days`` only, or all for None)."""
    signals = recovery if days is None else newest_days(recovery, days)
    signals = signals.select("athlete_id", "record_date", "body_battery", "sleep_score")
    sessions = metrics.select(
        "athlete_id",
        "workout_id",
        "avg_split_sec",
        F.col("workout_date").cast("date").alias("record_date"),
    )
    return sessions.join(signals, ["athlete_id", "record_date"], "inner")


def signal_bands(recovery: DataFrame) -> DataFrame:
    """One row per athlete, day and signal with its band; no value and no number count as ``warn``."""
    signals = []
    for name, (low, high) in S.RECOVERY_BANDS.items():
        number = F.lit(None).cast("int") if name == "hrv_status" else F.col(name)
        signals.append(
            F.struct(
                F.lit(name).alias("signal"),
                F.col(name).cast("string").alias("value_text"),
                F.when(number.isNull(), "warn")
                .when(number >= (high or 100), "good")
                .when(number >= (low or 0), "warn")
                .otherwise("bad")
                .alias("band"),
            )
        )
    return recovery.select("athlete_id", "record_date", F.inline(F.array(*signals)))


def battery_colour(battery: Column) -> Column:
    level = F.coalesce(battery, F.lit(0))
    return F.when(level >= S.LOW_BATTERY, "teal").when(level >= S.BATTERY_AMBER, "amber").otherwise("red")


def adjusted_target(target_split: Column, battery: Column) -> Column:
    """The target split, relaxed by 4 s when the battery is known, not zero and low."""
    low = (battery != 0) & (battery < S.LOW_BATTERY)
    return F.when(low, target_split + S.LOW_BATTERY_SPLIT_RELIEF_SEC).otherwise(target_split)
