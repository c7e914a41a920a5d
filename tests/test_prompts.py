import json
from datetime import date, datetime

import pytest
from helpers import day, sessions
from pyspark.sql import functions as F

from trainlake import schemas as S
from trainlake.operators import metrics, summary
from trainlake.plans import prompts

NO_NOTES = "athlete_id long, context_block string"
NO_FLAGS = "athlete_id long, taper_active boolean"
DAILY = S.struct("athlete_id BIGINT, record_date DATE, body_battery INT, hrv_status STRING, sleep_score INT,"
                 " resting_hr INT, stress INT, readiness INT")


def summaries(spark):
    s = sessions(spark, [(1, "a", day(0), 4200, 1241, 147.7), (1, "b", day(1), 4200, 1219, 145.1), (2, "c", day(1), 4200, 1219, 145.1)])
    return summary.session_summary(metrics.newest_metrics(s), s), metrics.newest_metrics(s)


def recovery(spark, *rows):
    return spark.createDataFrame([(1, date(2024, 1, 2), 88, "BALANCED", 67, 49, None, 93), *rows], DAILY)


def prompts_of(df):
    return {r.athlete_id: r.prompt for r in df.collect()}


def test_coaching_prompt(spark):
    notes = spark.createDataFrame([(1, "[2024-01-01 08:00] Coach: Easy.")], NO_NOTES)
    flags = spark.createDataFrame([(1, True)], NO_FLAGS)
    found = prompts_of(prompts.coaching_prompts(summaries(spark)[0], notes, flags, recovery(spark), "a race"))
    assert "Coach: Easy." in found[1] and "planned this as a recovery session" in found[1]
    assert "Body battery: 88 / 100" in found[1] and "Stress: N/A" in found[1]
    assert '"split_formatted":"2:25.1/500m"' in found[1] and "split_raw_sec" not in found[1]
    assert "(No previous coaching context available)" in found[2] and "planned" not in found[2] and "battery" not in found[2]


def test_brief_prompt(spark):
    empty = spark.createDataFrame([], NO_NOTES), spark.createDataFrame([], NO_FLAGS)
    found = prompts_of(prompts.brief_prompts(summary.brief_summary(summaries(spark)[1]), *empty, recovery(spark), "a race"))
    assert "Split 2:25.1 /500m, change -2.6s" in found[1] and "Sleep: 67" in found[1]
    assert "change —" in found[2] and "trend ?" in found[2]


def test_weekly_prompt(spark):
    s = sessions(spark, [(1, "a", day(0), 5000, 1362, 143.5), (1, "b", day(8), 7000, 2100, 150.0), (2, "c", day(0), 100000, 1, 1.0)])
    weekly = summary.weekly_summary(metrics.daily_metrics(s))
    extra = weekly.select("athlete_id", "week_start", "avg_split_formatted", "fatigue_days")
    weeks = summary.week_over_week(weekly).join(extra, ["athlete_id", "week_start"])
    found = prompts_of(prompts.weekly_prompts(weeks, spark.createDataFrame([], NO_NOTES), "2024-01-14"))
    assert set(found) == {1}  # the other athlete did not train that week
    assert "Volume: 7.0 km" in found[1] and "Week before:" in found[1] and "Mean split: 2:23.5/500m" in found[1]
    assert '{"day":"Mon","date":"2024-01-15"}' in found[1] and '{"day":"Sun","date":"2024-01-21"}' in found[1]
    first = prompts_of(prompts.weekly_prompts(weeks, spark.createDataFrame([], NO_NOTES), "2024-01-01"))
    assert "Week before:" not in first[1]


def payloads(spark, brief="*Go* easy"):
    briefs = spark.createDataFrame([(1, brief)], "athlete_id long, brief_text string")
    found = prompts.notifications(summaries(spark)[0], briefs, recovery(spark), "2024-01-28", "2024-06-30").collect()
    return {r.athlete_id: json.loads(r.payload) for r in found}


def test_notification(spark):
    found = payloads(spark)
    assert (found[1]["title"], found[1]["color"]) == ("Morning brief Sun 28 Jan", 0x00E5B4)
    fields = found[1]["fields"]
    assert len(fields) == 5 and [f["inline"] for f in fields] == [True, True, False, False, False]
    assert "Change: -2.6s — FASTER (improved)" in fields[0]["value"] and "Distance: 4200 m" in fields[0]["value"]
    assert fields[1]["name"] == "🟢 Readiness" and "Fatigue: Normal" in fields[1]["value"]
    assert "Stress level: —" in fields[2]["value"] and fields[3]["value"] == "**Go** easy"
    assert fields[4]["value"] == "154 days until 2024-06-30"
    assert found[2]["fields"][2]["value"] == "No recovery data yet"
    assert len(payloads(spark, "x" * 1200)[1]["fields"][3]["value"]) == 1003


def test_fatigue_colours(spark):
    base = summaries(spark)[0].where("athlete_id = 1")
    for state, colour in [("caution", 0xF59E0B), ("fatigue", 0xEF4444), ("unheard", 0x00E5B4)]:
        rows = base.withColumn("fatigue", F.lit(state))
        briefs = spark.createDataFrame([], "athlete_id long, brief_text string")
        found = prompts.notifications(rows, briefs, recovery(spark), "2024-01-28", "2024-01-01").first()
        assert json.loads(found.payload)["color"] == colour and "0 days" in found.payload


PLAN = {"insight": "good", "next_week": [
    {"day": "Mon", "date": "2024-01-29", "session_type": "steady", "label": "7km steady", "target_split": "2:31", "duration_min": 41, "notes": "x"},
    {"day": "Tue", "date": None, "label": "Rest", "target_split": None},
]}


@pytest.mark.parametrize("wrap", ["{}", "```json\n{}\n```", " ```\n{}\n```\n"])
def test_plan_answers(spark, wrap):
    answers = spark.createDataFrame([(1, wrap.replace("{}", json.dumps(PLAN)))], "athlete_id long, answer string")
    found = prompts.plan_days(answers, datetime(2024, 1, 29).date()).orderBy("position").collect()
    assert [(r.day, r.date_text, r.session_type, r.planned_km, r.is_today) for r in found] == [
        ("Mon", "29 Jan", "steady", 7.0, True), ("Tue", None, "rest", 0.0, False)
    ]
    assert prompts.rejected_plans(answers).count() == 0


@pytest.mark.parametrize("answer", ['{"insight": ', '{"insight": "x", "next_week": [', '{"insight": "x"} and so on', "sorry", "", "[]", "{}", None])
def test_rejected_answers(spark, answer):
    answers = spark.createDataFrame([(1, answer)], "athlete_id long, answer string")
    assert prompts.rejected_plans(answers).count() == 1 and prompts.plan_days(answers, "2024-01-29").count() == 0


def test_next_week(spark):
    athletes = spark.createDataFrame([(1,), (2,)], "athlete_id long")
    found = prompts.next_week_days(athletes, "2024-01-28").where("athlete_id = 2").orderBy("position").collect()
    assert [r.day for r in found] == ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
    assert (found[0].date, found[6].date) == (date(2024, 1, 29), date(2024, 2, 4))
