"""Prompt and message rows, one per athlete. The wording is our own; the data carried is what counts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainlake import schemas as S
from trainlake.functions import dates, text
from trainlake.operators.summary import without_raw_splits


def _or(column: str, missing: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(missing))


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _with_notes(rows: DataFrame, tips_block: DataFrame, taper: DataFrame) -> DataFrame:
    """Adds the note block and the taper flag; both tables have one row per athlete."""
    return (
        rows.join(tips_block, "athlete_id", "left")
        .join(taper, "athlete_id", "left")
        .withColumn("context_block", F.coalesce("context_block", F.lit(text.EMPTY_NOTES)))
        .withColumn("taper_active", F.coalesce("taper_active", F.lit(False)))
    )


def _recovery_text(signals: list[tuple[str, str, str]], missing: str) -> Column:
    lines = [F.concat(F.lit(f"{label}: "), _or(name, missing), F.lit(unit)) for name, label, unit in signals]
    return F.when(F.col("has_recovery"), _lines(*lines)).otherwise("")


_TAPER_TEXT = "The last coach note planned this as a recovery session: a slower split is intended."


def coaching_prompts(
    summaries: DataFrame, tips_block: DataFrame, taper: DataFrame, recovery: DataFrame, goal: str
) -> DataFrame:
    """Session summary as JSON (without raw splits), notes, taper remark and recovery signals."""
    fields = [c for c in without_raw_splits(summaries).columns if c != "athlete_id"]
    rows = _with_notes(summaries, tips_block, taper).join(
        recovery.withColumn("has_recovery", F.lit(True)), "athlete_id", "left"
    )
    signals = [
        ("body_battery", "Body battery", " / 100"), ("hrv_status", "HRV status", ""),
        ("sleep_score", "Sleep score", ""), ("resting_hr", "Resting heart rate", " bpm"),
        ("stress", "Stress", ""), ("readiness", "Readiness", "%"),
    ]
    return rows.select(
        "athlete_id",
        "taper_active",
        _lines(
            f"Coach an indoor rower whose goal is: {goal}. Give splits as m:SS.t per 500 m.",
            F.when(F.col("taper_active"), F.lit(_TAPER_TEXT)),
            "Notes so far:",
            F.col("context_block"),
            "Latest session:",
            F.to_json(F.struct(*fields), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}),
            _recovery_text(signals, "N/A"),
            F.concat(F.lit("Personal best: "), F.col("personal_best_split")),
        ).alias("prompt"),
    )


def brief_prompts(
    summaries: DataFrame, tips_block: DataFrame, taper: DataFrame, recovery: DataFrame, goal: str
) -> DataFrame:
    rows = _with_notes(summaries, tips_block, taper).join(
        recovery.withColumn("has_recovery", F.lit(True)), "athlete_id", "left"
    )
    signals = [
        ("body_battery", "Body battery", "/100"), ("hrv_status", "HRV", ""),
        ("sleep_score", "Sleep", ""), ("resting_hr", "Resting heart rate", " bpm"),
    ]
    split = text.format_split(F.col("split"), suffix="", null_text="N/A")
    return rows.select(
        "athlete_id",
        _lines(
            f"Write a short morning message for an indoor rower whose goal is: {goal}.",
            F.when(F.col("taper_active"), F.lit(_TAPER_TEXT)),
            "Notes so far:",
            F.col("context_block"),
            F.concat(
                F.lit("Split "), split, F.lit(" /500m, change "), text.signed_seconds(F.col("delta"), zero_sign="+")
            ),
            F.concat(F.lit("Distance "), _or("distance_m", "?"), F.lit(" m in "), _or("duration_min", "?"), F.lit(" min")),
            F.concat(F.lit("Type "), _or("session_type", "?"), F.lit(", fatigue "), _or("fatigue_flag", "?")),
            F.concat(F.lit("Load "), _or("weekly_load_min", "?"), F.lit(" min, trend "), _or("trend", "?")),
            _recovery_text(signals, "?"),
        ).alias("prompt"),
    )


def weekly_prompts(weeks: DataFrame, tips_block: DataFrame, as_of: date | str) -> DataFrame:
    """``weeks``: the rows of ``week_over_week`` joined to the formatted split and the fatigue days. One
    prompt per athlete that trained in the week of ``as_of``."""
    today = dates.day_literal(as_of)
    rows = weeks.where(F.col("week_start") == dates.week_start(today)).join(tips_block, "athlete_id", "left")
    next_days = F.transform(
        dates.next_week_dates(today),
        lambda d: F.struct(F.date_format(d, "E").alias("day"), F.date_format(d, "yyyy-MM-dd").alias("date")),
    )
    figure = lambda label, name, unit: F.concat(F.lit(f"{label}: "), _or(name, "0"), F.lit(unit))
    previous = F.when(
        F.col("prev_sessions").isNotNull(),
        _lines(
            "Week before:",
            figure("Volume", "prev_volume", " km"),
            F.concat(F.lit("Sessions: "), F.col("prev_sessions").cast("bigint").cast("string")),
            F.concat(F.lit("Mean split: "), text.format_split(F.col("prev_split"))),
            figure("Duration", "prev_duration", " min"),
        ),
    )
    return rows.select(
        "athlete_id",
        "week_start",
        _lines(
            "Plan the next training week of an indoor rower. Answer with JSON only.",
            "Notes so far:",
            F.coalesce("context_block", F.lit(text.EMPTY_NOTES)),
            figure("Sessions", "sessions_completed", ""),
            figure("Volume", "total_volume_km", " km"),
            F.concat(F.lit("Mean split: "), _or("avg_split_formatted", "N/A")),
            figure("Duration", "total_duration_min", " min"),
            figure("Fatigue days", "fatigue_days", ""),
            previous,
            F.concat(F.lit("Days: "), F.to_json(next_days)),
        ).alias("prompt"),
    )


def notifications(
    summaries: DataFrame, briefs: DataFrame, recovery: DataFrame, as_of: date | str, competition: date | str
) -> DataFrame:
    """One message per athlete: title, colour and five fields as JSON."""
    rows = summaries.join(briefs, "athlete_id", "left").join(
        recovery.withColumn("has_recovery", F.lit(True)), "athlete_id", "left"
    )
    today = dates.day_literal(as_of)
    colours = F.create_map(*[F.lit(x) for pair in S.FATIGUE_COLOURS.items() for x in pair])
    markers = F.create_map(*[F.lit(x) for pair in S.FATIGUE_MARKERS.items() for x in pair])
    fatigue = F.coalesce("fatigue", F.lit("normal"))
    change = F.when(
        F.col("delta_sec").isNotNull(),
        F.concat(text.signed_seconds(F.col("delta_sec"), zero_sign="+"), F.lit(" — "), F.col("delta_direction")),
    ).otherwise(text.NO_VALUE)
    dash = text.NO_VALUE
    signals = [
        ("body_battery", "Body battery", "/100"), ("hrv_status", "HRV status", ""),
        ("sleep_score", "Sleep score", ""), ("resting_hr", "Resting heart rate", " bpm"),
        ("stress", "Stress level", ""), ("readiness", "Readiness", "%"),
    ]
    recovery_text = F.when(F.col("has_recovery"), _recovery_text(signals, dash)).otherwise("No recovery data yet")
    field = lambda name, value, inline: F.struct(
        (F.lit(name) if isinstance(name, str) else name).alias("name"),
        value.alias("value"),
        F.lit(inline).alias("inline"),
    )
    fields = F.array(
        field(
            "Last session",
            _lines(
                F.concat(F.lit("Split: "), F.col("split_formatted")),
                F.concat(F.lit("Change: "), change),
                F.concat(F.lit("Distance: "), _or("distance_m", dash), F.lit(" m")),
                F.concat(F.lit("Duration: "), _or("duration_min", dash), F.lit(" min")),
            ),
            True,
        ),
        field(
            F.concat(F.coalesce(markers[fatigue], F.lit(S.FATIGUE_MARKERS["normal"])), F.lit(" Readiness")),
            _lines(
                F.concat(F.lit("Fatigue: "), F.initcap(fatigue)),
                F.concat(F.lit("Load: "), _or("weekly_load_min", dash), F.lit(" min")),
                F.concat(F.lit("Trend: "), _or("trend", dash)),
            ),
            True,
        ),
        field("Recovery", recovery_text, False),
        field(
            "Brief", F.coalesce(text.truncate(text.double_asterisks(F.col("brief_text"))), F.lit("")), False
        ),
        field(
            "Countdown",
            F.concat(dates.days_left(today, competition).cast("string"), F.lit(f" days until {competition}")),
            False,
        ),
    )
    message = F.struct(
        F.concat(F.lit("Morning brief "), F.date_format(today, "EEE dd MMM")).alias("title"),
        F.coalesce(colours[fatigue], F.lit(S.FATIGUE_COLOURS["normal"])).alias("color"),
        fields.alias("fields"),
    )
    return rows.select("athlete_id", F.to_json(message).alias("payload"))


# ---- Plan answers -------------------------------------------------------------------------------
def parsed_plans(answers: DataFrame) -> DataFrame:
    """``answers`` (…, answer text) with ``plan``, and ``is_plan`` for a whole JSON object with at least one
    of the two fields; half an object, or text around it, is none."""
    with_reject = T.StructType([*S.PLAN.fields, T.StructField("malformed", T.StringType())])
    whole = F.col("body").rlike(r"(?s)^\{.*\}$") & F.col("plan.malformed").isNull()
    has_fields = F.col("plan.insight").isNotNull() | F.col("plan.next_week").isNotNull()
    return (
        answers.withColumn("body", text.strip_code_fence(F.col("answer")))
        .withColumn("plan", F.from_json("body", with_reject, {"columnNameOfCorruptRecord": "malformed"}))
        .withColumn("is_plan", F.coalesce(whole & has_fields, F.lit(False)))
        .drop("body")
    )


def rejected_plans(answers: DataFrame) -> DataFrame:
    return parsed_plans(answers).where(~F.col("is_plan")).drop("plan", "is_plan")


def plan_days(answers: DataFrame, as_of: date | str) -> DataFrame:
    """One row per planned day, with its position, the planned distance and whether it is today."""
    others = [c for c in answers.columns if c != "answer"]
    days = F.when(F.col("is_plan"), F.col("plan.next_week"))
    # The outer form with a filter on its result: a filter below would parse every answer again.
    exploded = parsed_plans(answers).select(*others, F.posexplode_outer(days).alias("position", "entry"))
    day = F.col("entry.date").try_cast("date")
    return exploded.where(F.col("position").isNotNull()).select(
        *others,
        "position",
        "entry.day",
        day.alias("date"),
        F.date_format(day, "d MMM").alias("date_text"),
        F.coalesce("entry.session_type", F.lit("rest")).alias("session_type"),
        "entry.label",
        "entry.target_split",
        F.col("entry.duration_min").try_cast("int").alias("duration_min"),
        text.planned_km(F.col("entry.label")).alias("planned_km"),
        F.coalesce(day == dates.day_literal(as_of), F.lit(False)).alias("is_today"),
    )


def next_week_days(athletes: DataFrame, as_of: date | str) -> DataFrame:
    """The seven day names and dates of the coming week for every athlete."""
    day = dates.next_week_dates(dates.day_literal(as_of))
    return athletes.select("athlete_id", F.posexplode(day).alias("position", "date")).withColumn(
        "day", F.date_format("date", "E")
    )
