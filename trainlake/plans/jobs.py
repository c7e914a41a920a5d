"""The whole runs over one lake folder, for all athletes and requests at once.

Tables with keys are batch logs (see ``writers``); each refresh is one batch. Model answers are made
elsewhere: prompts go out as rows, answers come back as rows.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlake import schemas as S
from trainlake.functions.dates import day_literal, time_literal, week_start
from trainlake.operators import context, ingest, metrics, notes, quality, quarantine, recovery, summary, upsert
from trainlake.plans import prompts
from trainlake.session import materialise, tune
from trainlake.sources import readers, writers

SOURCE = "workouts"


# ---- Stored tables ------------------------------------------------------------------------------
def _current(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """Current rows of a batch log, or none."""
    if not readers.path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return writers.current_rows(spark, path, keys).select(*schema.fieldNames())


def _before(spark: SparkSession, path: str, schema, batch_id: int) -> DataFrame:
    """What the batches before this one stored: a repeated batch must not see itself."""
    stored = writers.stored_rows(spark, path, up_to=batch_id - 1)
    return spark.createDataFrame([], schema) if stored is None else stored.select(*schema.fieldNames())


def sessions(spark: SparkSession, lake: str) -> DataFrame:
    return _current(spark, f"{lake}/sessions", S.SESSIONS, ["workout_id"])


def intervals(spark: SparkSession, lake: str) -> DataFrame:
    return _current(spark, f"{lake}/intervals", S.INTERVALS, ["interval_id"])


def recovery_days(spark: SparkSession, lake: str) -> DataFrame:
    return _current(spark, f"{lake}/recovery", S.RECOVERY_DAILY, ["athlete_id", "record_date"])


def sync_state(spark: SparkSession, lake: str) -> DataFrame:
    return _current(spark, f"{lake}/sync_state", S.SYNC_STATE, ["source_name"])


def daily_metrics(spark: SparkSession, lake: str) -> DataFrame:
    return readers.read_version(spark, f"{lake}/metrics", S.METRICS).select(*S.METRICS.fieldNames())


def metrics_between(spark: SparkSession, lake: str, first: date, last: date) -> DataFrame:
    """The metrics of a range of days, from the folders of its months only."""
    stored = readers.read_version(spark, f"{lake}/metrics", S.METRICS)
    day = F.col("workout_date").cast("date")
    if "month" in stored.columns:
        stored = stored.where(readers.month_range(first, last))
    return stored.where(day.between(day_literal(first), day_literal(last))).select(*S.METRICS.fieldNames())


def tips(spark: SparkSession, lake: str) -> DataFrame:
    return readers.read_or_empty(spark, f"{lake}/tips", S.TIPS).select(*S.TIPS.fieldNames())


def rejected_workouts(spark: SparkSession, lake: str) -> DataFrame:
    """Every workout that was set aside, of all batches."""
    return readers.read_or_empty(spark, f"{lake}/rejected_workouts", S.RAW_WORKOUT).select(*S.RAW_WORKOUT.fieldNames())


def late_workouts(spark: SparkSession, lake: str) -> DataFrame:
    """Every workout that came too late to be taken in, with the reason."""
    return readers.read_or_empty(spark, f"{lake}/late_workouts", S.LATE_WORKOUT).select(*S.LATE_WORKOUT.fieldNames())


def corrupt_lines(spark: SparkSession, lake: str, kind: str = "workouts") -> DataFrame:
    """Every landed line ("workouts" or "recovery") that is not what it should be."""
    return readers.read_or_empty(spark, f"{lake}/corrupt_{kind}", S.CORRUPT_LINE).select(*S.CORRUPT_LINE.fieldNames())


# ---- Daily run ----------------------------------------------------------------------------------
def refresh(
    spark: SparkSession,
    lake: str,
    batch_id: int,
    now: datetime | str,
    pages: str | None = None,
    recovery_documents: str | None = None,
    replay_days: int = S.REPLAY_DAYS,
) -> DataFrame:
    """Take in what has landed since the refresh before (workout pages and recovery documents), then rebuild the metrics. Returns
    the workouts that had to be set aside. Repeating a refresh under its number gives the same tables.

    Files are noted in a ledger when all of their rows are stored, so each is read by one refresh. Every landed workout is stored,
    rejected, or late (``late_workouts``); lines that cannot be read are kept (``corrupt_lines``)."""
    tune(spark)
    rejected = spark.createDataFrame([], S.RAW_WORKOUT)
    if pages:
        rejected = _take_in_workouts(spark, lake, batch_id, now, pages, replay_days)
    if recovery_documents:
        _take_in_recovery(spark, lake, batch_id, now, recovery_documents)
    writers.rebuild_metrics(metrics.daily_metrics(sessions(spark, lake)), f"{lake}/metrics")
    return rejected


def _new_files(spark: SparkSession, lake: str, kind: str, batch_id: int, folder: str) -> tuple[list[str], DataFrame]:
    """The landed files that no earlier batch has taken in, by name and time of change, and the same as rows for the ledger."""
    known = _before(spark, f"{lake}/landed_{kind}", S.LANDED_FILE, batch_id)
    fresh = readers.landed_files(spark, folder).join(known, ["file", "modified"], "left_anti")
    fresh = materialise(fresh.select(*S.LANDED_FILE.fieldNames()), "new-files")
    return [r.file for r in fresh.select("file").collect()], fresh


def _close_landing(spark: SparkSession, lake: str, kind: str, batch_id: int, files: DataFrame, lines: DataFrame) -> None:
    """Keep the lines that could not be read and, last of all, note the files as taken in."""
    broken = lines.where(F.col(readers.CORRUPT).isNotNull()).select(*S.CORRUPT_LINE.fieldNames())
    writers.write_batch(broken, f"{lake}/corrupt_{kind}", batch_id)
    writers.write_batch(files, f"{lake}/landed_{kind}", batch_id)
    writers.compact_if_long(spark, f"{lake}/landed_{kind}", ["file", "modified"])


def _take_in_workouts(spark, lake, batch_id, now, pages, replay_days) -> DataFrame:
    files, ledger = _new_files(spark, lake, SOURCE, batch_id, pages)
    raw = readers.numbered(readers.ordered_workouts(readers.read_lines(spark, files, S.RAW_WORKOUT_PAGE)))
    marks = _before(spark, f"{lake}/sync_state", S.SYNC_STATE, batch_id)
    landed = materialise(ingest.judged_by_source(raw, marks, SOURCE, replay_days), "arrivals")
    workouts = landed.where(F.col(readers.CORRUPT).isNull())
    late = workouts.where(F.col("late").isNotNull()).select(*S.LATE_WORKOUT.fieldNames())
    writers.write_batch(late, f"{lake}/late_workouts", batch_id)
    fresh = workouts.where(F.col("late").isNull()).drop("late", readers.CORRUPT)
    # What is unusable is set aside first: it must not hide an older good version of the same workout.
    newest = materialise(upsert.latest_by_key(ingest.valid_workouts(fresh), ["id"], readers.ARRIVAL), "workouts")
    moment = time_literal(now)
    table = ingest.normalise(newest).withColumns({"created_at": moment, "updated_at": moment})
    writers.write_batch(table, f"{lake}/sessions", batch_id)
    writers.write_batch(ingest.flatten_intervals(newest).withColumn("created_at", moment), f"{lake}/intervals", batch_id)
    rejected = ingest.rejected_workouts(fresh).select(*S.RAW_WORKOUT.fieldNames())
    writers.write_batch(rejected, f"{lake}/rejected_workouts", batch_id)
    mark = spark.range(1).select(F.lit(SOURCE).alias("source_name"), moment.alias("last_sync_ts"))
    writers.write_batch(mark, f"{lake}/sync_state", batch_id)
    _close_landing(spark, lake, SOURCE, batch_id, ledger, landed)
    for name, keys in (("sessions", ["workout_id"]), ("intervals", ["interval_id"]), ("sync_state", ["source_name"])):
        writers.compact_if_long(spark, f"{lake}/{name}", keys)
    return rejected


def _take_in_recovery(spark, lake, batch_id, now, documents) -> None:
    files, ledger = _new_files(spark, lake, "recovery", batch_id, documents)
    lines = materialise(readers.ordered_recovery(spark, files), "documents")
    # A line of which only some fields could be read still counts with these, if it says whose and of which day it is.
    usable = F.col(readers.CORRUPT).isNull() | (F.col("athlete_id").isNotNull() & F.col("record_date").isNotNull())
    signals = recovery.extract_signals(lines.where(usable).drop(readers.CORRUPT), readers.ARRIVAL)
    path = f"{lake}/recovery"
    known = _before(spark, path, S.RECOVERY_DAILY, batch_id)
    stamped = upsert.stamped_recovery(known, signals, readers.ARRIVAL, now)
    writers.write_batch(stamped.select(*S.RECOVERY_DAILY.fieldNames()), path, batch_id)
    _close_landing(spark, lake, "recovery", batch_id, ledger, lines)
    writers.compact_if_long(spark, path, upsert.RECOVERY_KEYS)


def store_recovery_snapshot(spark: SparkSession, lake: str) -> None:
    """The newest recovery signals of every athlete as nested rows."""
    writers.write_snapshot(recovery.snapshot(recovery_days(spark, lake)), f"{lake}/recovery_snapshot", ("athlete_id",))


def _latest(spark: SparkSession, lake: str) -> DataFrame:
    return summary.latest_session(daily_metrics(spark, lake))


def _signals(spark: SparkSession, lake: str) -> DataFrame:
    return recovery.newest_days(recovery_days(spark, lake), 1).drop("created_at")


def session_summaries(spark: SparkSession, lake: str) -> DataFrame:
    return summary.session_summary(_latest(spark, lake), sessions(spark, lake))


def coaching_prompts(spark: SparkSession, lake: str, goal: str) -> DataFrame:
    stored = tips(spark, lake)
    return prompts.coaching_prompts(
        session_summaries(spark, lake), notes.context_blocks(stored), notes.taper_flags(stored),
        _signals(spark, lake), goal,
    )


def store_coaching(
    spark: SparkSession, lake: str, answers: DataFrame, now: datetime | str, model: str, batch_id: int | None = None
) -> None:
    """Keep generated texts (athlete_id, coaching): as tagged notes and beside what they were made from. Repeated
    under the same number, the notes are stored once."""
    summaries = session_summaries(spark, lake)
    active = F.coalesce("taper_active", F.lit(False))
    fresh = (
        answers.join(summaries, "athlete_id")
        .join(notes.taper_flags(tips(spark, lake)), "athlete_id", "left")
        .select(
            "athlete_id",
            time_literal(now).alias("created_at"),
            F.col("session_time").cast("string").alias("session_date"),
            F.lit("coach").alias("author"),
            F.col("coaching").alias("tip_text"),
            summary.generated_note_tag(active, F.col("delta_sec")).alias("tag"),
            F.lit(None).cast("string").alias("session_type"),
        )
    )
    output = writers.coaching_output(summaries.join(answers.select("athlete_id"), "athlete_id", "left_semi"),
                                     answers, _signals(spark, lake), now, model)
    writers.write_snapshot(output, f"{lake}/coaching_output", ("athlete_id",))
    # The new notes depend on the stored ones, so they are made before the log grows.
    writers.append_tips(materialise(notes.new_tips(fresh), "tips"), f"{lake}/tips", batch_id)


def brief_prompts(spark: SparkSession, lake: str, goal: str) -> DataFrame:
    stored = tips(spark, lake)
    return prompts.brief_prompts(
        summary.brief_summary(_latest(spark, lake)), notes.context_blocks(stored, 5), notes.taper_flags(stored),
        _signals(spark, lake), goal,
    )


def notifications(spark: SparkSession, lake: str, as_of: date | str, competition: date | str) -> DataFrame:
    briefs = readers.latest_briefs(writers.stored_briefs(spark, f"{lake}/briefs"), as_of)
    return prompts.notifications(
        session_summaries(spark, lake), briefs, _signals(spark, lake), as_of, competition
    )


# ---- Weekly run ---------------------------------------------------------------------------------
def _weeks(spark: SparkSession, lake: str, as_of: date | str) -> DataFrame:
    """Summaries of the week of ``as_of`` (up to that day) and of the week before."""
    last = date.fromisoformat(str(as_of)[:10])
    first = last - timedelta(days=last.weekday() + 7)
    return summary.weekly_summary(metrics_between(spark, lake, first, last))


def weekly_prompts(spark: SparkSession, lake: str, as_of: date | str) -> DataFrame:
    weeks = summary.week_over_week(_weeks(spark, lake, as_of), ("avg_split_formatted", "fatigue_days"))
    return prompts.weekly_prompts(weeks, notes.context_blocks(tips(spark, lake), 3), as_of)


def store_plans(
    spark: SparkSession, lake: str, answers: DataFrame, as_of: date | str, now: datetime | str, model: str
) -> DataFrame:
    """Write the snapshot of the week of ``as_of`` with the plans (athlete_id, answer) made for it. Returns
    the answers that hold no plan."""
    monday = week_start(day_literal(as_of))
    plans = prompts.parsed_plans(answers).where("is_plan").select(
        "athlete_id", monday.alias("week_start"), "plan.insight", "plan.next_week"
    )
    snapshot = writers.weekly_snapshot(_weeks(spark, lake, as_of), plans, now, model)
    writers.write_snapshot(
        snapshot.where(F.col("week_start") == monday).join(plans.select("athlete_id"), "athlete_id", "left_semi"),
        f"{lake}/weekly_plan", ("athlete_id",),
    )
    return prompts.rejected_plans(answers)


# ---- Context requests ---------------------------------------------------------------------------
def serve_requests(
    spark: SparkSession,
    lake: str,
    entities: DataFrame,
    offers: DataFrame,
    requests: DataFrame,
    grants: DataFrame,
    user_text: str,
    now: datetime | str,
    strict: bool = False,
    batch_id: int | None = None,
) -> DataFrame:
    """Assemble the requests from the records offered to them (request_id, id, ordinal).

    Records that break the rules of their kind are set aside and never served. Every offer has one audit row, also one
    whose record or request is unknown; every exclusion goes to the exclusion log, whose retention is applied. Repeated
    under its number (by default the next one), a run leaves the logs as they are. With ``strict``, a denial by policy
    then stops the run.
    """
    tune(spark)
    batch_id = writers.next_batch(spark, f"{lake}/audit") if batch_id is None else batch_id
    rejected = quality.rejected_entities(entities).select("id", "entity_type", "problem")
    writers.write_batch(rejected.withColumn("logged_at", time_literal(now)), f"{lake}/rejected_entities", batch_id)
    entities = quality.valid_entities(entities)
    measured = materialise(context.measured(entities), "measured")
    decisions = materialise(context.decide(offers.join(measured, "id"), requests, grants), "decisions")
    audit = context.audit_records(decisions).unionByName(context.unmatched_offers(offers, measured, requests))
    writers.write_batch(audit.withColumn("logged_at", time_literal(now)), f"{lake}/audit", batch_id)
    writers.append_exclusions(quarantine.exclusions(decisions, now), f"{lake}/exclusions", batch_id)
    writers.prune_exclusions(spark, f"{lake}/exclusions", now)
    if strict:
        context.require_clear(decisions)
    return context.context_requests(entities, decisions, requests, user_text)
