"""The registered queries: every operator over the given tables. Each takes (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlake import schemas as S
from trainlake.functions import dates, text
from trainlake.operators import (
    calibration, context, ingest, metrics, notes, quality, quarantine, recovery, skew, summary, upsert,
)
from trainlake.plans import bindings as B
from trainlake.plans import jobs, prompts
from trainlake.session import materialise, new_path, tune
from trainlake.sources import readers, writers
from trainlake.streaming import keyed, streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    def tuned(spark: SparkSession, folder: str) -> DataFrame:
        return build(tune(spark), folder)

    QUERIES[build.__name__] = tuned
    return tuned


def _rounded(rows: DataFrame) -> DataFrame:
    """Averages with four digits, for comparison."""
    names = ["rolling_avg_split", "consistency", "weekly_load_min"]
    return rows.withColumns({n: F.round(n, 4) for n in names if n in rows.columns})


# ---- Metrics ------------------------------------------------------------------------------------
@query
def daily_metrics(spark, folder):
    return _rounded(B.daily_metrics(spark, folder))


@query
def daily_metrics_split(spark, folder):
    """The same with the busiest athletes cut into segments."""
    return _rounded(B.daily_metrics(spark, folder, max_rows_per_athlete=75))


@query
def metrics_row_count(spark, folder):
    return metrics.row_count(metrics.eligible_sessions(B.sessions(spark, folder)))


@query
def metrics_rebuild(spark, folder):
    path = new_path(spark, "metrics")
    writers.rebuild_metrics(B.daily_metrics(spark, folder), path)
    return _rounded(readers.read_version(spark, path, S.METRICS).drop("month"))


# ---- Ingest -------------------------------------------------------------------------------------
@query
def workout_normalise(spark, folder):
    return ingest.normalise(B.raw_workouts(spark, folder))


@query
def workout_rejects(spark, folder):
    return ingest.rejected_workouts(B.raw_workouts(spark, folder)).select("id", "athlete_id", "distance")


@query
def interval_flatten(spark, folder):
    flat = ingest.flatten_intervals(B.line_intervals(spark, folder))
    return flat.drop("rest_duration_sec")


@query
def interval_flatten_scaled(spark, folder):
    return ingest.flatten_intervals(B.raw_workouts(spark, folder), interval_time_unit=0.1).drop("rest_duration_sec")


def _marks(spark, folder):
    """A sync time per event type."""
    return B.table(spark, folder, "events").groupBy(F.col("event_type").alias("source_name")).agg(
        (F.max("ts") - F.expr("INTERVAL 5 DAYS")).alias("last_sync_ts")
    )


@query
def incremental_filter(spark, folder):
    raw = B.raw_workouts(spark, folder)
    return ingest.incremental(raw, _marks(spark, folder), "click").select("id", "athlete_id", "date")


@query
def incremental_first_run(spark, folder):
    raw = B.raw_workouts(spark, folder)
    return ingest.incremental(raw, _marks(spark, folder), "never synced").select("id", "athlete_id", "date")


@query
def sync_lookup(spark, folder):
    return ingest.last_sync(_marks(spark, folder), "view")


def _stored_sessions(spark, folder):
    earlier = F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    return B.sessions(spark, folder).where(F.col("workout_id").cast("bigint") % 13 != 0).withColumns(
        {"created_at": earlier, "updated_at": earlier}
    )


@query
def upsert_sessions(spark, folder):
    """Every tenth workout comes again twice with other distances; every 13th is new."""
    again = B.sessions(spark, folder).where(
        (F.col("workout_id").cast("bigint") % 10 == 0) | (F.col("workout_id").cast("bigint") % 13 == 0)
    )
    batch = again.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("ordinal"))
    batch = batch.withColumn("distance_m", F.col("distance_m") + F.col("ordinal") * 100)
    return upsert.upsert_sessions(_stored_sessions(spark, folder), batch, B.SYNC_TIME)


@query
def upsert_intervals(spark, folder):
    flat = ingest.flatten_intervals(B.raw_workouts(spark, folder))
    number = F.col("workout_id").cast("bigint")
    stored = flat.where(number % 13 != 0).withColumn("created_at", dates.time_literal("2024-01-31 12:00:00"))
    # The repeats have one interval less; the old last one stays.
    batch = flat.where(((number % 3 == 0) | (number % 13 == 0)) & (F.col("interval_index") < number % 5 - 1))
    batch = batch.withColumn("spm", F.col("spm") + 5).withColumn("ordinal", F.col("interval_index"))
    return upsert.upsert_intervals(stored, batch, B.SYNC_TIME).drop("rest_duration_sec")


@query
def upsert_recovery(spark, folder):
    daily = B.recovery_daily(spark, folder)
    odd = F.col("athlete_id") + F.dayofmonth("record_date")
    stored = daily.where(odd % 11 != 0).withColumn("created_at", dates.time_literal("2024-01-31 12:00:00"))
    batch = daily.where((odd % 10 == 0) | (odd % 11 == 0)).withColumn("stress", F.col("stress") + 1)
    return upsert.upsert_recovery(stored, batch.withColumn("ordinal", F.lit(0)), B.SYNC_TIME)


@query
def sync_mark(spark, folder):
    stored = _marks(spark, folder).where(F.col("source_name") != "view")
    marks = B.table(spark, folder, "events").select(
        F.col("event_type").alias("source_name"), F.col("ts").alias("last_sync_ts")
    )
    return upsert.mark_synced(stored, marks.where(F.col("source_name").isin("view", "click")))


@query
def recovery_extract(spark, folder):
    return recovery.extract_signals(B.recovery_documents(spark, folder))


# ---- Per athlete --------------------------------------------------------------------------------
@query
def latest_session(spark, folder):
    return _rounded(summary.latest_session(B.daily_metrics(spark, folder)))


@query
def fastest_session(spark, folder):
    return summary.fastest_session(B.sessions(spark, folder))


@query
def personal_best(spark, folder):
    return summary.personal_best(B.sessions(spark, folder))


@query
def top_k_sessions(spark, folder):
    newest = [F.desc("workout_date"), F.desc("workout_id")]
    return skew.best_rows(B.sessions(spark, folder), "athlete_id", newest, 3)


def _summaries(spark, folder):
    sessions = B.sessions(spark, folder)
    return summary.session_summary(metrics.newest_metrics(sessions), sessions)


@query
def newest_metrics(spark, folder):
    return _rounded(metrics.newest_metrics(B.sessions(spark, folder)))


@query
def session_summary(spark, folder):
    return _summaries(spark, folder)


@query
def prompt_summary(spark, folder):
    return summary.without_raw_splits(_summaries(spark, folder))


@query
def brief_summary(spark, folder):
    return summary.brief_summary(metrics.newest_metrics(B.sessions(spark, folder)))


def _flags(spark, folder):
    return notes.taper_flags(B.tips(spark, folder))


@query
def generated_note_tags(spark, folder):
    latest = metrics.newest_metrics(B.sessions(spark, folder)).join(_flags(spark, folder), "athlete_id", "left")
    active = F.coalesce("taper_active", F.lit(False))
    return latest.select("athlete_id", summary.generated_note_tag(active, F.col("delta")).alias("tag"))


@query
def staleness(spark, folder):
    sessions = B.sessions(spark, folder)
    latest = summary.latest_session(sessions).select("athlete_id", "workout_date")
    # Summary dates as text: that of the newest session, one day less, unreadable, or none at all.
    which = F.col("athlete_id") % 4
    summary_date = (
        F.when(which == 0, F.col("workout_date").cast("string"))
        .when(which == 1, (F.col("workout_date") - F.expr("INTERVAL 1 DAY")).cast("string"))
        .when(which == 2, F.lit("unknown"))
    )
    summaries = latest.where(which != 3).select("athlete_id", summary_date.alias("summary_date"))
    return summary.stale_summaries(latest, summaries)


# ---- Weeks --------------------------------------------------------------------------------------
@query
def weekly_summary(spark, folder):
    return summary.weekly_summary(B.daily_metrics(spark, folder))


@query
def week_over_week(spark, folder):
    return summary.week_over_week(summary.weekly_summary(B.daily_metrics(spark, folder)))


@query
def iso_week_volume(spark, folder):
    return summary.iso_week_volume(metrics.eligible_sessions(B.sessions(spark, folder)))


@query
def week_calendar(spark, folder):
    return summary.week_calendar(metrics.eligible_sessions(B.sessions(spark, folder)), B.MID_WEEK)


@query
def week_range_rows(spark, folder):
    return _rounded(summary.week_rows(B.daily_metrics(spark, folder), "2024-01-22", B.MID_WEEK))


# ---- Rows ---------------------------------------------------------------------------------------
@query
def session_history(spark, folder):
    return _rounded(summary.session_history(B.daily_metrics(spark, folder)))


@query
def load_vs_performance(spark, folder):
    return _rounded(summary.load_vs_performance(B.daily_metrics(spark, folder)))


@query
def category_attributes(spark, folder):
    return summary.display_attributes(B.daily_metrics(spark, folder))


@query
def training_phase(spark, folder):
    phases = summary.training_phases(B.sessions(spark, folder), B.TRAINING_START)
    return phases.select("athlete_id", "workout_id", "training_week", "phase")


@query
def countdown(spark, folder):
    return summary.countdown(B.sessions(spark, folder), B.COMPETITION, B.TRAINING_START)


@query
def goal_progress(spark, folder):
    """Four goals per athlete, one of them always exceeded."""
    sessions = B.sessions(spark, folder).where(F.col("duration_sec") > 0)
    totals = sessions.groupBy("athlete_id").agg(
        F.sum("distance_m").alias("metres"), F.max("distance_m").alias("longest"),
        F.min("duration_sec").alias("shortest"), F.count(F.lit(1)).alias("n"),
    )
    goal = lambda name, current, target: F.struct(
        F.lit(name).alias("label"), current.cast("bigint").alias("current"), target.cast("bigint").alias("target")
    )
    goals = F.array(
        goal("volume", F.col("metres"), F.lit(500000)), goal("longest", F.col("longest"), F.lit(12000)),
        goal("shortest", F.col("shortest"), F.lit(900)), goal("sessions", F.col("n") + 10, F.col("n")),
    )
    return summary.goal_progress(totals.select("athlete_id", F.inline(goals)))


@query
def text_functions(spark, folder):
    m = B.daily_metrics(spark, folder)
    delta = F.col("delta")
    return m.select(
        "athlete_id",
        "workout_id",
        text.format_split(F.col("avg_split_sec")).alias("with_suffix"),
        text.format_split(F.col("prev_split"), suffix="", null_text="N/A").alias("without_suffix"),
        text.signed_seconds(delta).alias("history_delta"),
        text.signed_seconds(delta, zero_sign="+").alias("message_delta"),
        text.round_tenths(F.col("duration_sec") / F.lit(60.0)).alias("minutes"),
        text.thousands(F.col("distance_m")).alias("metres_text"),
        F.date_format("workout_date", "MMM dd").alias("best_day"),
        F.date_format("workout_date", "EEE dd MMM").alias("title_day"),
        F.date_format("workout_date", "d MMM").alias("bar_day"),
        F.initcap("fatigue_flag").alias("fatigue_title"),
        text.direction(delta).alias("direction"),
        text.trend(delta).alias("trend"),
    )


@query
def long_text_functions(spark, folder):
    body = F.concat(F.lit("*"), F.col("text"), F.lit("*"))
    return B.table(spark, folder, "documents").select(
        "doc_id",
        text.truncate(text.double_asterisks(body)).alias("short"),
        text.first_words(F.col("text")).alias("summary"),
        text.is_blank(F.col("text")).alias("blank"),
    )


@query
def parse_functions(spark, folder):
    rows = B.raw_workouts(spark, folder)
    number = F.when(F.col("id").cast("bigint") % 7 == 0, F.lit("n/a")).otherwise(
        (F.col("time") / 10).cast("string")
    )
    return rows.select(
        "id",
        dates.parse_iso(F.col("date")).alias("moment"),
        number.try_cast("double").alias("number"),
        F.to_json(F.struct("id", "distance"), {"ignoreNullFields": "false"}).alias("as_json"),
        F.try_element_at(F.transform("intervals", lambda i: i["spm"]), F.lit(-1)).alias("last_spm"),
        F.try_element_at(F.transform("intervals", lambda i: i["spm"]), F.lit(1)).alias("first_spm"),
        F.startswith(text.note_id(F.lit(B.SYNC_TIME).cast("timestamp_ntz"), F.col("id")),
                     F.lit("tip_20240201000000000000_")).alias("id_has_time"),
    )


# ---- Recovery -----------------------------------------------------------------------------------
@query
def recovery_vs_performance(spark, folder):
    m = B.daily_metrics(spark, folder)
    return recovery.recovery_vs_performance(m, B.recovery_daily(spark, folder))


@query
def newest_recovery_days(spark, folder):
    return recovery.newest_days(B.recovery_daily(spark, folder))


@query
def recovery_bands(spark, folder):
    return recovery.signal_bands(B.recovery_daily(spark, folder))


@query
def recovery_adjusted_target(spark, folder):
    signals = B.recovery_daily(spark, folder).select("athlete_id", "record_date", "body_battery")
    rows = recovery.recovery_vs_performance(
        B.daily_metrics(spark, folder), B.recovery_daily(spark, folder), days=None
    ).drop("sleep_score", "body_battery")
    return rows.join(signals, ["athlete_id", "record_date"]).select(
        "athlete_id",
        "workout_id",
        recovery.battery_colour(F.col("body_battery")).alias("battery_colour"),
        recovery.adjusted_target(F.col("avg_split_sec").cast("double"), F.col("body_battery")).alias("target_split"),
    )


# ---- Notes --------------------------------------------------------------------------------------
@query
def recent_tips(spark, folder):
    return notes.recent_tips(B.tips(spark, folder)).select(
        "athlete_id", "rank", "tip_id", "created_at", "author", "tag", "session_type", "expect_taper"
    )


@query
def taper_flag(spark, folder):
    athletes = B.table(spark, folder, "events").select(F.col("user_id").alias("athlete_id")).distinct()
    flags = athletes.join(_flags(spark, folder), "athlete_id", "left")
    return flags.withColumn("taper_active", F.coalesce("taper_active", F.lit(False)))


@query
def context_block(spark, folder):
    return notes.context_blocks(B.tips(spark, folder), 5)


@query
def tip_session_lookup(spark, folder):
    looked_up = notes.tip_sessions(B.tips(spark, folder), B.daily_metrics(spark, folder))
    return looked_up.select("tip_id", "athlete_id", "session_label")


@query
def note_append(spark, folder):
    """Notes are added in two steps and read back."""
    path = new_path(spark, "tips")
    fresh = notes.new_tips(B.raw_notes(spark, folder).drop("tip_id"))
    writers.append_tips(fresh.where(F.col("author") == "coach"), path)
    writers.append_tips(fresh.where(F.col("author") != "coach"), path)
    stored = readers.read_or_empty(spark, path, S.TIPS).drop("batch_id")
    return stored.select("athlete_id", "created_at", "author", "tip_text", "tag", "session_type", "expect_taper")


@query
def brief_lookup(spark, folder):
    path = new_path(spark, "briefs")
    briefs = B.tips(spark, folder).groupBy("athlete_id", F.to_date("created_at").alias("brief_date")).agg(
        F.max_by("tip_text", F.struct("created_at", "tip_id")).alias("brief_text")
    )
    writers.write_briefs(briefs, path)
    return readers.latest_briefs(writers.stored_briefs(spark, path), "2024-01-15")


# ---- Context ------------------------------------------------------------------------------------
def _offer(spark, folder):
    return B.candidates(spark, folder), B.requests(spark, folder), B.grants(spark, folder)


def _decisions(spark, folder):
    return context.decide(*_offer(spark, folder))


@query
def entity_scores(spark, folder):
    scored = context.with_scores(B.measured_entities(spark, folder), dates.time_literal(f"{B.AS_OF} 00:00:00"))
    return scored.select("id", "entity_type", "completeness", "recency", "priority")


@query
def entity_scores_steep(spark, folder):
    """Recency with another decay and floor."""
    weight = context.recency(F.col("created_at"), dates.time_literal(f"{B.AS_OF} 00:00:00"), 20, 0.2)
    return B.measured_entities(spark, folder).select("id", weight.alias("recency"))


@query
def policy_decisions(spark, folder):
    candidates, requests, grants = _offer(spark, folder)
    return context.audit_records(context.policy_decisions(candidates, *context.written(requests, grants)))


def _pairs(spark, folder):
    return B.candidates(spark, folder).select(
        F.concat(F.lit("coach_"), F.split_part("request_id", F.lit("-"), F.lit(1))).alias("coach_id"),
        "participant_id", "request_id", "id",
    )


@query
def access_semi(spark, folder):
    return context.granted_rows(_pairs(spark, folder), B.grants(spark, folder))


@query
def access_anti(spark, folder):
    return context.ungranted_rows(_pairs(spark, folder), B.grants(spark, folder))


@query
def context_budget(spark, folder):
    return _decisions(spark, folder).select(
        "request_id", "ordinal", "id", "priority", "estimated_tokens", "reason_code", "summarised"
    )


@query
def completeness_quarantine(spark, folder):
    log = quarantine.exclusions(_decisions(spark, folder), B.SYNC_TIME)
    return quarantine.query(log, reason_code="completeness_below_threshold").select(
        "timestamp", "object_id", "entity_type", "reason_code", "priority_score",
        F.col("extra")["completeness_ratio"].try_cast("double").alias("ratio"),
    )


def _dated_log(spark, folder):
    """Exclusions spread over 45 days; every 19th without a readable time."""
    log = quarantine.exclusions(_decisions(spark, folder), B.SYNC_TIME)
    number = F.col("object_id").cast("bigint")
    age = F.make_dt_interval((number % 45).cast("int"), F.lit(0), F.lit(0))
    return log.withColumn("timestamp", F.when(number % 19 != 0, F.col("timestamp") - age))


_LOG_FIELDS = ["timestamp", "object_id", "entity_type", "reason_code", "priority_score"]


def _log_columns():
    return [*_LOG_FIELDS, F.col("extra")["mode"].alias("mode"), F.col("extra")["token_budget"].alias("token_budget")]


@query
def quarantine_counts(spark, folder):
    return quarantine.counts(_dated_log(spark, folder))


@query
def quarantine_query(spark, folder):
    found = quarantine.query(
        quarantine.with_event_date(_dated_log(spark, folder)), "budget_truncation", "session_note",
        "2024-01-15 00:00:00",
    )
    return found.select(*_log_columns())


@query
def quarantine_retention(spark, folder):
    """Written, pruned as stored files, and read back."""
    path = new_path(spark, "exclusions")
    writers.append_exclusions(_dated_log(spark, folder), path)
    writers.prune_exclusions(spark, path, "2024-02-05 12:00:00")
    return readers.read_table(spark, path, S.EXCLUSION).select(*_log_columns())


@query
def log_append(spark, folder):
    path = new_path(spark, "exclusions")
    log = quarantine.exclusions(_decisions(spark, folder), B.SYNC_TIME)
    gate = F.col("reason_code").startswith("pep")
    writers.append_exclusions(log.where(gate), path)
    writers.append_exclusions(log.where(~gate), path)
    return readers.read_table(spark, path, S.EXCLUSION).select(*_log_columns())


@query
def context_request(spark, folder):
    candidates, requests, grants = _offer(spark, folder)
    decisions = context.decide(candidates, requests, grants)
    # Only the texts of selected documents go on from here.
    chosen = materialise(
        decisions.where(F.col("reason_code").isNull()).select(F.col("id").cast("bigint").alias("doc_id")).distinct(),
        "chosen",
    )
    documents = B.table(spark, folder, "documents").join(chosen, "doc_id", "left_semi")
    entities = B.entities(spark, folder, documents)
    return context.context_requests(entities, decisions, requests, "What should the next session be?")


def _broken_entities(spark, folder):
    number = F.col("doc_id")
    return (
        B.entities(spark, folder)
        .withColumn("confidence", F.when(number % 23 == 0, 1.5).otherwise(F.col("confidence")))
        .withColumn("tier", F.when(number % 29 == 0, "silver ").otherwise(F.col("tier")))
        .withColumn("entity_type", F.when(number % 31 == 0, "workout").otherwise(F.col("entity_type")))
        .withColumn("goal_text", F.when(number % 37 == 0, "finish").otherwise(F.col("goal_text")))
    )


@query
def entity_validation(spark, folder):
    """Entities with planted mistakes and the first rule each of them breaks."""
    return quality.entity_problems(_broken_entities(spark, folder)).select("id", "problem")


@query
def request_rejects(spark, folder):
    """The audit of whole requests over records with planted mistakes; every 13th record is also offered to a request that
    nobody made. Each offer has one row."""
    lake = new_path(spark, "lake")
    offers = B.candidates(spark, folder).select("request_id", "id", "ordinal")
    stray = B.table(spark, folder, "documents").where("doc_id % 13 = 0").selectExpr(
        "'nobody' AS request_id", "CAST(doc_id AS STRING) AS id", "doc_id AS ordinal"
    )
    jobs.serve_requests(
        spark, lake, _broken_entities(spark, folder).drop("doc_id"), offers.unionByName(stray), B.requests(spark, folder),
        B.grants(spark, folder), "What next?", B.SYNC_TIME,
    )
    return spark.read.parquet(f"{lake}/audit").drop("logged_at", "batch_id")


@query
def entity_assembly(spark, folder):
    """The three kinds as typed tables and put together again."""
    entities = B.entities(spark, folder)
    part = lambda kind: entities.where(F.col("entity_type") == kind).select(
        *context.entity_schema(kind).fieldNames()
    )
    whole = context.assemble_entities(part("participant_profile"), part("session_note"), part("goal_record"))
    return whole.select("id", "entity_type", "tier", "display_name", "coach_id", "goal_text", "content")


@query
def null_violations(spark, folder):
    tips = B.tips(spark, folder).withColumn("tag_or_type", F.coalesce("tag", "session_type"))
    return quality.null_violations(tips, ["tag", "tag_or_type", "tip_text"]).select("tip_id", "missing")


@query
def duplicate_keys(spark, folder):
    lines = B.table(spark, folder, "lineitem")
    return quality.duplicate_keys(lines, ["l_orderkey", "l_linenumber"])


@query
def x_weekly_review(spark, folder):
    review = summary.weekly_review(B.daily_metrics(spark, folder), B.recovery_daily(spark, folder))
    return review.withColumns({c: F.round(c, 4) for c in ("split_spread", "battery_correlation")})


@query
def x_calendar_load(spark, folder):
    return summary.calendar_load(metrics.eligible_sessions(B.sessions(spark, folder)))


# ---- Calibration --------------------------------------------------------------------------------
@query
def initial_confidence(spark, folder):
    unset = B.measured_entities(spark, folder).withColumn(
        "confidence", F.when(F.col("doc_id") % 2 == 0, F.col("confidence"))
    )
    return calibration.with_initial_confidence(unset).select("id", F.round("confidence", 8).alias("confidence"))


@query
def recalibrate_batch(spark, folder):
    updated = calibration.recalibrate_batch(B.measured_entities(spark, folder), B.lineage(spark, folder))
    return updated.select("id", F.round("confidence", 8).alias("confidence"))


@query
def recalibrate_scorer(spark, folder):
    """Another scorer: the result leaves [0, 1] and is clamped."""
    scorer = lambda confidence, complete, referenced, usefulness: confidence * 3 - usefulness
    updated = calibration.recalibrate_batch(B.measured_entities(spark, folder), B.lineage(spark, folder), scorer)
    return updated.select("id", F.round("confidence", 8).alias("confidence"))


def _folded(spark, folder, **options):
    folded = calibration.recalibrate_fold(B.profiles(spark, folder), B.lineage_history(spark, folder), **options)
    return folded.select("id", F.round("confidence", 8).alias("confidence"))


@query
def recalibrate_fold(spark, folder):
    return _folded(spark, folder)


@query
def recalibrate_fold_split(spark, folder):
    """The same with the longest history cut into segments."""
    n_events = B.table(spark, folder, "events").count()
    return _folded(spark, folder, events_per_task=max(1, n_events // 20))


# ---- Plans and prompts --------------------------------------------------------------------------
def _labels(spark, folder):
    """A plan label per session, in the spellings that occur."""
    label = (
        "CASE CAST(workout_id AS BIGINT) % 6"
        " WHEN 0 THEN concat(1 + athlete_id % 5, 'x', 1 + distance_m % 3, 'km intervals')"
        " WHEN 1 THEN concat(distance_m % 20, 'km easy')"
        " WHEN 2 THEN concat(1 + athlete_id % 5, 'X', distance_m % 4, '.5 km')"
        " WHEN 3 THEN 'Rest'"
        " WHEN 4 THEN concat('warm ', 1 + athlete_id % 5, 'x', 1 + distance_m % 9, 'km')"
        " ELSE NULL END"
    )
    return B.sessions(spark, folder).selectExpr(
        "workout_id", "athlete_id", "CAST(workout_date AS DATE) AS day", "distance_m", f"{label} AS label"
    )


@query
def planned_km(spark, folder):
    rows = _labels(spark, folder)
    return rows.select("workout_id", "label", text.planned_km(F.col("label")).alias("planned_km"))


def _answers(spark, folder):
    """A stored plan answer per session with two days: plain, fenced in two ways, or broken JSON."""
    day = (
        "named_struct('day', 'Mon', 'date', CAST(day AS STRING), 'session_type', 'steady', 'label', label,"
        " 'target_split', '2:20.0', 'duration_min', distance_m % 90, 'notes', 'easy')"
    )
    other = (
        "named_struct('day', 'Tue', 'date', CAST(date_add(day, 1) AS STRING), 'session_type', CAST(NULL AS STRING),"
        " 'label', 'Rest', 'target_split', CAST(NULL AS STRING), 'duration_min', CAST(NULL AS INT),"
        " 'notes', CAST(NULL AS STRING))"
    )
    plan = f"to_json(named_struct('insight', concat('week of ', label), 'next_week', array({day}, {other})))"
    answer = (
        f"CASE CAST(workout_id AS BIGINT) % 4 WHEN 0 THEN {plan}"
        f" WHEN 1 THEN concat(' ```json\\n', {plan}, '\\n``` done') WHEN 2 THEN concat('```\\n', {plan}, '\\n```')"
        f" ELSE concat('{{\"insight\": ', label) END"
    )
    rows = _labels(spark, folder).withColumn("label", F.coalesce("label", F.lit("8km")))
    return materialise(rows.selectExpr("workout_id", "athlete_id", f"{answer} AS answer"), "answers")


@query
def plan_parse(spark, folder):
    parsed = prompts.parsed_plans(_answers(spark, folder)).where("is_plan")
    return parsed.select("workout_id", "plan.insight", F.size("plan.next_week").alias("n_days"))


@query
def plan_rejects(spark, folder):
    return prompts.rejected_plans(_answers(spark, folder)).select("workout_id")


@query
def plan_days(spark, folder):
    return prompts.plan_days(_answers(spark, folder), B.MID_WEEK)


@query
def next_week_dates(spark, folder):
    athletes = B.table(spark, folder, "events").select(F.col("user_id").alias("athlete_id")).distinct()
    return prompts.next_week_days(athletes, B.AS_OF)


def _today(spark, folder):
    return recovery.newest_days(B.recovery_daily(spark, folder), 1).where(F.col("athlete_id") % 4 != 0)


GOAL = "a first indoor race"


@query
def coaching_prompt(spark, folder):
    tips = B.tips(spark, folder)
    return prompts.coaching_prompts(
        _summaries(spark, folder), notes.context_blocks(tips), notes.taper_flags(tips), _today(spark, folder), GOAL
    )


@query
def brief_prompt(spark, folder):
    tips = B.tips(spark, folder)
    summaries = summary.brief_summary(metrics.newest_metrics(B.sessions(spark, folder)))
    return prompts.brief_prompts(
        summaries, notes.context_blocks(tips, 5), notes.taper_flags(tips), _today(spark, folder), GOAL
    )


@query
def weekly_prompt(spark, folder):
    weekly = summary.weekly_summary(B.daily_metrics(spark, folder))
    weeks = summary.week_over_week(weekly, ("avg_split_formatted", "fatigue_days"))
    return prompts.weekly_prompts(weeks, notes.context_blocks(B.tips(spark, folder), 3), B.AS_OF)


@query
def notification_payload(spark, folder):
    briefs = B.tips(spark, folder).groupBy("athlete_id").agg(
        F.max_by("tip_text", F.struct("created_at", "tip_id")).alias("brief_text")
    )
    return prompts.notifications(_summaries(spark, folder), briefs, _today(spark, folder), B.AS_OF, "2024-06-30")


# ---- Files --------------------------------------------------------------------------------------
@query
def scan_tables(spark, folder):
    path = new_path(spark, "sessions")
    B.sessions(spark, folder).write.parquet(path)
    return readers.read_or_empty(spark, path, S.SESSIONS).drop("created_at", "updated_at")


@query
def missing_source(spark, folder):
    """A table that is there beside one that is not."""
    absent = readers.read_or_empty(spark, new_path(spark, "absent"), S.RECOVERY_DAILY)
    return B.recovery_daily(spark, folder).join(
        absent.select("athlete_id", "record_date", F.lit(True).alias("found")), ["athlete_id", "record_date"], "left"
    ).select("athlete_id", "record_date", "stress", F.col("found").isNotNull().alias("is_in_both"))


@query
def raw_json_scan(spark, folder):
    """Landed pages of workouts (see ``_pages``), read back, the last version of each normalised. Every seventh page lacks
    the list."""
    path = new_path(spark, "landed")
    number = F.col("id").cast("bigint")
    raw = B.raw_workouts(spark, folder)
    _pages(raw.where(number % 7 != 0)).unionByName(
        raw.where(number % 7 == 0).select(F.lit(None).cast(S.RAW_WORKOUT_PAGE["data"].dataType).alias("data"))
    ).write.json(path)
    landed = readers.numbered(readers.ordered_workouts(spark.read.schema(S.RAW_WORKOUT_PAGE).json(path)))
    return ingest.normalise(upsert.latest_by_key(landed, ["id"], readers.ARRIVAL))


@query
def raw_corrupt_pages(spark, folder):
    """Landed lines of one workout each, some of them cut off: workouts that are read, and the text of what is not."""
    path = new_path(spark, "landed")
    _lines(B.raw_workouts(spark, folder), 31).write.text(path)
    files = [r.file for r in readers.landed_files(spark, path).collect()]
    found = readers.ordered_workouts(readers.read_lines(spark, files, S.RAW_WORKOUT_PAGE))
    return found.select("id", "athlete_id", "distance", "corrupt")


def _lines(raw, cut):
    """One page per workout as text; every ``cut``-th ends after the id."""
    page = F.to_json(F.struct(F.array(F.struct(*S.RAW_WORKOUT.fieldNames())).alias("data")))
    broken = F.concat(F.lit('{"data": [{"id": "'), "id")
    return raw.select(F.when(F.col("id").cast("bigint") % cut == 0, broken).otherwise(page).alias("value"))


@query
def refresh_two_landings(spark, folder):
    """Two refreshes over one landing folder that grows: how often each workout was stored, set aside, late or unreadable."""
    lake, landing = new_path(spark, "lake"), new_path(spark, "landing")
    raw = B.raw_workouts(spark, folder)
    even = F.col("id").cast("bigint") % 2 == 0
    for batch_id, (arrival, now) in enumerate(((raw.where(even), "2024-01-15 00:00:00"), (raw.where(~even), "2024-01-20 00:00:00"))):
        _lines(arrival, 31).write.mode("append").text(landing)
        jobs.refresh(spark, lake, batch_id, now, pages=landing)
    ends = [
        jobs.sessions(spark, lake).select(F.col("workout_id").alias("id"), F.lit("stored").alias("outcome")),
        jobs.rejected_workouts(spark, lake).select("id", F.lit("rejected").alias("outcome")),
        jobs.late_workouts(spark, lake).select("id", F.col("late").alias("outcome")),
        jobs.corrupt_lines(spark, lake).select(F.regexp_extract("corrupt", r"(\d+)$", 1).alias("id"), F.lit("corrupt").alias("outcome")),
    ]
    return reduce(lambda a, b: a.unionByName(b), ends).groupBy("id", "outcome").agg(F.count(F.lit(1)).alias("times"))


def _pages(raw):
    """Pages of workouts, some with an older version before them: every fourth in the same page, every sixth of the others
    in the line before."""
    number = F.col("id").cast("bigint")
    newest = F.struct(*S.RAW_WORKOUT.fieldNames())
    older = newest.withField("distance", F.col("distance") + 7)
    lists = (
        F.when(number % 4 == 0, F.array(F.array(older, newest)))
        .when(number % 6 == 0, F.array(F.array(older), F.array(newest)))
        .otherwise(F.array(F.array(newest)))
    )
    return raw.select(F.explode(lists).alias("data"))


@query
def raw_recovery_scan(spark, folder):
    path = new_path(spark, "recovery")
    B.recovery_documents(spark, folder).write.json(path)
    return recovery.extract_signals(readers.read_raw_recovery(spark, path))


def _plan_rows(weekly):
    return weekly.where(F.col("athlete_id") % 3 != 0).select(
        "athlete_id",
        "week_start",
        F.concat(F.lit("volume "), F.col("total_volume_km").cast("string")).alias("insight"),
        F.array(F.lit("Mon"), F.lit("Tue")).alias("next_week"),
    )


@query
def snapshot_roundtrip(spark, folder):
    path = new_path(spark, "snapshot")
    weekly = summary.weekly_summary(B.daily_metrics(spark, folder))
    rows = writers.weekly_snapshot(weekly, _plan_rows(weekly), B.SYNC_TIME, "a-model")
    writers.write_snapshot(rows, path)
    return readers.read_snapshot(spark, path, rows.schema).select(
        "athlete_id",
        "generated_at",
        "week_start",
        "week_end",
        F.col("this_week.total_volume_m").alias("volume"),
        F.col("prev_week.total_volume_m").alias("prev_volume"),
        "insight",
        F.coalesce(F.size("next_week_plan"), F.lit(-1)).alias("n_days"),
    )


@query
def snapshot_two_writes(spark, folder):
    """All athletes, then the even ones again: the second write leaves the others alone."""
    path = new_path(spark, "snapshot")
    weekly = summary.weekly_summary(B.daily_metrics(spark, folder))
    for model, chosen in (("first", F.lit(True)), ("second", F.col("athlete_id") % 2 == 0)):
        rows = writers.weekly_snapshot(weekly, _plan_rows(weekly), B.SYNC_TIME, model)
        writers.write_snapshot(rows.where(chosen), path, ("athlete_id", "week_start"))
    return readers.read_snapshot(spark, path, rows.schema).select(
        "athlete_id", "week_start", F.col("this_week.total_volume_m").alias("volume"), "insight", "model"
    )


@query
def brief_two_writes(spark, folder):
    """The briefs of all athletes, then those of the even ones again for the same days."""
    path = new_path(spark, "briefs")
    briefs = B.tips(spark, folder).groupBy("athlete_id", F.to_date("created_at").alias("brief_date")).agg(
        F.max_by("tip_text", F.struct("created_at", "tip_id")).alias("brief_text")
    )
    writers.write_briefs(briefs, path)
    again = briefs.where(F.col("athlete_id") % 2 == 0).withColumn("brief_text", F.concat(F.lit("Again: "), "brief_text"))
    writers.write_briefs(again, path)
    return readers.latest_briefs(writers.stored_briefs(spark, path), "2024-01-15")


@query
def recovery_snapshot(spark, folder):
    path = new_path(spark, "recovery-snapshot")
    rows = recovery.snapshot(B.recovery_daily(spark, folder))
    writers.write_snapshot(rows, path, ("athlete_id",))
    return readers.read_snapshot(spark, path, rows.schema).select("athlete_id", "record_date", "signals.*")


@query
def refresh_rejects(spark, folder):
    """A whole refresh in which every fifth workout comes again without a time: what was good stays, what is not usable is
    set aside."""
    lake, landing = new_path(spark, "lake"), new_path(spark, "landing")
    raw = B.raw_workouts(spark, folder)
    good = F.struct(*S.RAW_WORKOUT.fieldNames())
    bad = good.withField("time", F.lit(None).cast("double"))
    again = F.col("id").cast("bigint") % 5 == 0
    raw.select(F.when(again, F.array(good, bad)).otherwise(F.array(good)).alias("data")).write.json(landing)
    jobs.refresh(spark, lake, 0, B.SYNC_TIME, pages=landing)
    stored = jobs.sessions(spark, lake).select(F.col("workout_id").alias("id"), F.lit("stored").alias("state"), "distance_m")
    aside = jobs.rejected_workouts(spark, lake).select("id", F.lit("set aside").alias("state"), F.col("distance").alias("distance_m"))
    return stored.unionByName(aside)


@query
def refresh_recovery(spark, folder):
    """A whole refresh in which every document comes twice, first with larger values: the last one counts."""
    lake, landing = new_path(spark, "lake"), new_path(spark, "landing")
    documents = B.recovery_documents(spark, folder)
    right = F.struct(*documents.columns)
    wrong = right.withField("battery_doc", F.lit('[{"charged": 100}]')).withField("stress_doc", F.lit('{"overallStressLevel": 100}'))
    documents.select(F.explode(F.array(wrong, right)).alias("row")).select("row.*").write.json(landing)
    jobs.refresh(spark, lake, 0, B.SYNC_TIME, recovery_documents=landing)
    return jobs.recovery_days(spark, lake).drop("created_at")


@query
def coaching_output(spark, folder):
    path = new_path(spark, "output")
    summaries = _summaries(spark, folder)
    answers = summaries.select("athlete_id", F.concat(F.lit("trend "), F.col("trend")).alias("coaching"))
    rows = writers.coaching_output(summaries, answers, _today(spark, folder), B.SYNC_TIME, "a-model")
    writers.write_snapshot(rows, path)
    return readers.read_snapshot(spark, path, rows.schema).select(
        "athlete_id", "summary.split_formatted", "summary.delta_sec", "coaching",
        F.col("recovery.body_battery").alias("body_battery"), "generated_at", "model",
    )


@query
def malformed_log_scan(spark, folder):
    """A JSON-lines log with blank and broken lines among the records."""
    path = new_path(spark, "log")
    number = F.col("event_id")
    moment = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    record = F.to_json(
        F.struct(
            F.when(number % 17 == 0, F.lit("long ago")).otherwise(moment).alias("timestamp"),
            number.cast("string").alias("object_id"),
            F.col("event_type").alias("reason_code"),
            F.col("value").alias("priority_score"),
            F.create_map(F.lit("token_budget"), F.col("user_id")).alias("extra"),
        )
    )
    line = F.when(number % 11 == 0, "").when(number % 13 == 0, F.lit('{"object_id": ')).otherwise(record)
    B.table(spark, folder, "events").select(line.alias("value")).write.text(path)
    return readers.read_exclusion_lines(spark, path).select(
        "timestamp", "object_id", "reason_code", "priority_score", F.col("extra")["token_budget"].alias("token_budget")
    )


# ---- Streams ------------------------------------------------------------------------------------
def _workout_arrivals(spark, folder, start, after=lambda: None) -> None:
    """All workouts as landed pages in three arrivals: the even ones, the odd ones, and every tenth again
    with 100 m more. The stream runs after each arrival and goes on where it stopped; then ``after`` is called."""
    landing, progress = new_path(spark, "landing"), new_path(spark, "progress")
    raw = B.raw_workouts(spark, folder)
    number = F.col("id").cast("bigint")
    again = raw.where(number % 10 == 0).withColumn("distance", F.col("distance") + 100)
    for arrival in (raw.where(number % 2 == 0), raw.where(number % 2 != 0), again):
        _pages(arrival).write.mode("append").json(landing)
        start(streams.workout_stream(spark, landing), progress).awaitTermination()
        after()


@query
def stream_sessions(spark, folder):
    table = new_path(spark, "sessions")
    _workout_arrivals(
        spark, folder, lambda workouts, progress: streams.sync_sessions(workouts, table, progress, replay_days=None)
    )
    return writers.current_rows(spark, table, ["workout_id"])


@query
def stream_sessions_compacted(spark, folder):
    """With the batches folded after each arrival."""
    table = new_path(spark, "sessions")
    _workout_arrivals(
        spark, folder, lambda workouts, progress: streams.sync_sessions(workouts, table, progress, replay_days=None),
        lambda: writers.compact(spark, table, ["workout_id"]),
    )
    return writers.current_rows(spark, table, ["workout_id"])


@query
def stream_rejects(spark, folder):
    """How often each workout without a time was set aside."""
    table = new_path(spark, "sessions")
    _workout_arrivals(
        spark, folder, lambda workouts, progress: streams.sync_sessions(workouts, table, progress, replay_days=None)
    )
    return streams.rejected_workouts(spark, table).groupBy("id", "athlete_id").agg(F.count(F.lit(1)).alias("times"))


@query
def stream_intervals(spark, folder):
    table, intervals = new_path(spark, "sessions"), new_path(spark, "intervals")
    _workout_arrivals(
        spark,
        folder,
        lambda workouts, progress: streams.sync_sessions(
            workouts, table, progress, replay_days=None, intervals=intervals
        ),
    )
    return writers.current_rows(spark, intervals, ["interval_id"]).drop("rest_duration_sec")


@query
def stream_sessions_replay(spark, folder):
    """With the replay limit: what comes again is taken in only if it is recent."""
    table = new_path(spark, "sessions")
    _workout_arrivals(
        spark, folder, lambda workouts, progress: streams.sync_sessions(workouts, table, progress, mark_of="source")
    )
    return writers.current_rows(spark, table, ["workout_id"])


@query
def stream_sessions_late(spark, folder):
    """Two arrivals under the replay limit, with dates that lie far ahead: each workout is stored, set aside or late."""
    table, landing, progress = (new_path(spark, name) for name in ("sessions", "landing", "progress"))
    raw = B.raw_workouts(spark, folder)
    number = F.col("id").cast("bigint")
    raw = raw.withColumn("date", F.when(number % 101 == 0, "2199-05-05T00:00:00").otherwise(F.col("date")))
    for arrival in (raw.where(number % 2 == 0), raw.where(number % 2 != 0)):
        _pages(arrival).write.mode("append").json(landing)
        streams.sync_sessions(streams.workout_stream(spark, landing), table, progress).awaitTermination()
    ends = [
        writers.current_rows(spark, table, ["workout_id"]).select(F.col("workout_id").alias("id"), "athlete_id", F.lit("stored").alias("outcome")),
        streams.rejected_workouts(spark, table).select("id", "athlete_id", F.lit("rejected").alias("outcome")),
        streams.late_workouts(spark, table).select("id", "athlete_id", F.col("late").alias("outcome")),
    ]
    return reduce(lambda a, b: a.unionByName(b), ends).distinct()


@query
def stream_metrics(spark, folder):
    sessions, derived = new_path(spark, "sessions"), new_path(spark, "metrics")
    _workout_arrivals(
        spark,
        folder,
        lambda workouts, progress: streams.sync_metrics(workouts, sessions, derived, progress, replay_days=None, buckets=8),
    )
    return _rounded(streams.current_metrics(spark, derived))


@query
def stream_quarantine(spark, folder):
    landing, progress, log = (new_path(spark, name) for name in ("records", "progress", "exclusions"))
    records = _dated_log(spark, folder)
    even = F.col("object_id").cast("bigint") % 2 == 0
    for arrival in (records.where(even), records.where(~even)):
        arrival.write.mode("append").json(landing)
        stream = streams.exclusion_stream(spark, landing)
        streams.keep_exclusion_log(stream, log, progress, "2024-02-05 12:00:00").awaitTermination()
    return readers.read_table(spark, log, S.EXCLUSION).select(*_log_columns())


@query
def stream_quarantine_future(spark, folder):
    """Without a reference time, records of a time after their landing are set aside and the others stay in the log."""
    landing, progress, log = (new_path(spark, name) for name in ("records", "progress", "exclusions"))
    records = _dated_log(spark, folder)
    number = F.col("object_id").cast("bigint")
    wrong = F.lit("2199-05-05 00:00:00").cast("timestamp_ntz")
    records = records.withColumn("timestamp", F.when(number % 23 == 0, wrong).otherwise(F.col("timestamp")))
    for arrival in (records.where(number % 2 == 0), records.where(number % 2 != 0)):
        arrival.write.mode("append").json(landing)
        stream = streams.exclusion_stream(spark, landing)
        streams.keep_exclusion_log(stream, log, progress, days=36500).awaitTermination()
    kept = readers.read_table(spark, log, S.EXCLUSION).withColumn("set_aside", F.lit(False))
    aside = streams.future_exclusions(spark, log).withColumn("set_aside", F.lit(True))
    return kept.select(*aside.columns).unionByName(aside).select(*_log_columns(), "set_aside")


@query
def stream_confidence(spark, folder):
    """The lineage history in three arrivals, each later than the one before."""
    return _streamed_confidence(spark, folder, lambda store: None)


@query
def stream_confidence_compacted(spark, folder):
    """With the stored confidences folded after each arrival."""
    return _streamed_confidence(spark, folder, lambda store: writers.compact(spark, store, ["id"]))


@query
def x_keyed_confidence(spark, folder):
    """The same with the confidences as keyed state, restarted before each arrival."""
    return _streamed_confidence(spark, folder, lambda store: None, keyed.keep_confidence)


def _streamed_confidence(spark, folder, after, update=streams.update_confidence):
    landing, progress, store = (new_path(spark, name) for name in ("lineage", "progress", "confidence"))
    events, entities = B.lineage_history(spark, folder), B.profiles(spark, folder)
    third = B.table(spark, folder, "events").agg(F.max("event_id")).first()[0] // 3 + 1
    for i in range(3):
        arrival = events.where((F.col("seq") >= i * third) & (F.col("seq") < (i + 1) * third))
        arrival.write.mode("append").json(landing)
        stream = streams.landed(spark, landing, events.schema)
        update(stream, entities, store, progress).awaitTermination()
        after(store)
    return streams.current_confidence(spark, entities, store).select(
        "id", F.round("confidence", 8).alias("confidence")
    )
