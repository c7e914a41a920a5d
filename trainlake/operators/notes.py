"""Coaching notes: an append-only log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainlake import schemas as S
from trainlake.functions import text


def expects_taper(tag: Column, session_type: Column) -> Column:
    recovery = F.lit("recovery")
    return F.coalesce(tag == recovery, F.lit(False)) | F.coalesce(session_type == recovery, F.lit(False))


def new_tips(notes: DataFrame) -> DataFrame:
    """Complete rows for the log from (athlete_id, created_at, author, tip_text, tag, session_type,
    session_date). An author that is not given is the coach; an empty session type is none."""
    kind = F.when(F.col("session_type") != "", F.col("session_type"))
    return notes.select(
        text.note_id(F.col("created_at"), F.col("athlete_id"), F.col("author"), F.col("tip_text")).alias("tip_id"),
        "athlete_id",
        "created_at",
        "session_date",
        F.coalesce("author", F.lit("coach")).alias("author"),
        "tip_text",
        "tag",
        kind.alias("session_type"),
        expects_taper(F.col("tag"), kind).alias("expect_taper"),
    )


def recent_tips(tips: DataFrame, limit: int | None = None) -> DataFrame:
    """The newest ``limit`` tips of each athlete (0 and None mean the default)."""
    newest = Window.partitionBy("athlete_id").orderBy(F.desc("created_at"), F.desc("tip_id"))
    return tips.withColumn("rank", F.row_number().over(newest)).where(
        F.col("rank") <= (limit or S.NOTE_WINDOW)
    )


def taper_flags(tips: DataFrame) -> DataFrame:
    """Whether the newest coach tip of an athlete announced a recovery session. Athletes without a coach
    tip have no row; join left and read NULL as false."""
    return (
        tips.where(F.col("author") == "coach")
        .groupBy("athlete_id")
        .agg(F.max_by("expect_taper", F.struct("created_at", "tip_id")).alias("taper_active"))
    )


def context_blocks(tips: DataFrame, limit: int | None = None) -> DataFrame:
    """The newest tips of each athlete as text in time order. At most ``limit`` lines are collected."""
    line = text.note_line(
        F.col("created_at"), F.col("author"), F.col("tag"), F.col("expect_taper"), F.col("tip_text")
    )
    lines = F.array_sort(F.collect_list(F.struct("created_at", "tip_id", "line")))
    return (
        recent_tips(tips, limit)
        .withColumn("line", line)
        .groupBy("athlete_id")
        .agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context_block"))
    )


def tip_sessions(tips: DataFrame, metrics: DataFrame) -> DataFrame:
    """Each tip with a label made from the last session of the day it is about."""
    day = F.to_date(F.col("workout_date"))
    last_of_day = (
        metrics.groupBy("athlete_id", F.date_format(day, "yyyy-MM-dd").alias("day_text"))
        .agg(
            F.max_by(F.struct("distance_m", "avg_split_sec"), F.struct("workout_date", "workout_id")).alias("s")
        )
        .select("athlete_id", "day_text", "s.*")
    )
    keyed = tips.withColumn("day_text", F.substring(F.coalesce("session_date", F.lit("")), 1, 10))
    label = text.session_label(F.col("distance_m"), F.col("avg_split_sec"), F.col("day_text"))
    return keyed.join(last_of_day, ["athlete_id", "day_text"], "left").withColumn("session_label", label)
