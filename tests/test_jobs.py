"""Whole runs over a lake, from landed files to prompts and snapshots."""

import json
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from helpers import entity, rows

from trainlake import schemas as S
from trainlake.operators import context, notes
from trainlake.plans import jobs
from trainlake.sources import readers, writers

START = datetime(2024, 1, 1, 8)


def workout(number, day, time=13500, distance=5000, athlete=1, **more):
    return {"id": number, "athlete_id": athlete, "date": (START + timedelta(days=day)).isoformat() + "Z",
            "distance": distance, "time": time, **more}


@pytest.fixture
def lake(spark, tmp_path):
    def land(name, *lines):
        (tmp_path / name).write_text("\n".join(json.dumps(x) for x in lines))
        return str(tmp_path / name)

    first = land(
        "first.json",
        {"data": [workout(1, 0), workout(2, 2, 13400, intervals=[{"distance": 500, "time": 120, "spm": 20}] * 2),
                  workout(3, 8, 13300), workout(3, 8, 13200), workout(7, 8, None)]},
        {"data": [workout(4, 8, 14000, athlete=2)]}, {"meta": {}},
    )
    docs = land("docs.json", {"athlete_id": 1, "record_date": "2024-01-09", "stress_doc": '{"overallStressLevel": 20}'})
    root = str(tmp_path / "lake")
    rejected = jobs.refresh(spark, root, 0, "2024-01-10 12:00:00", first, docs)
    assert [r.id for r in rejected.collect()] == ["7"]
    return root, land


def test_tables_after_one_refresh(spark, lake):
    root, _ = lake
    assert rows(jobs.sessions(spark, root), ["workout_id", "duration_sec"]) == [("1", 1350), ("2", 1340), ("3", 1320), ("4", 1400)]
    assert jobs.sessions(spark, root).schema == S.SESSIONS and jobs.intervals(spark, root).count() == 2
    assert rows(jobs.sync_state(spark, root)) == [(datetime(2024, 1, 10, 12), "workouts")]
    assert jobs.recovery_days(spark, root).first().stress == 20
    assert jobs.daily_metrics(spark, root).count() == 4


def test_second_refresh_replays_three_days(spark, lake):
    root, land = lake
    more = land("more.json", {"data": [workout(1, 0, 999), workout(3, 8, 13100), workout(5, 9, 13000)]})
    docs = land("docs2.json", {"athlete_id": 1, "record_date": "2024-01-09", "stress_doc": '{"overallStressLevel": 30}'},
                {"athlete_id": 1, "record_date": "2024-01-10"})
    for _ in range(2):  # the second time repeats the batch
        jobs.refresh(spark, root, 1, "2024-01-11 12:00:00", more, docs)
    assert rows(jobs.sessions(spark, root), ["workout_id", "duration_sec"]) == [
        ("1", 1350), ("2", 1340), ("3", 1310), ("4", 1400), ("5", 1300)
    ]
    assert rows(jobs.recovery_days(spark, root), ["record_date", "stress", "created_at"]) == [
        (date(2024, 1, 9), 30, datetime(2024, 1, 10, 12)), (date(2024, 1, 10), None, datetime(2024, 1, 11, 12))
    ]
    assert jobs.daily_metrics(spark, root).count() == 5


def test_the_last_document_of_a_day_counts(spark, lake):
    root, land = lake
    day = {"athlete_id": 1, "record_date": "2024-01-09"}
    docs = land("late.json", {**day, "battery_doc": '[{"charged": 80}]'}, {**day, "battery_doc": '[{"charged": 60}]'})
    jobs.refresh(spark, root, 1, "2024-01-11 12:00:00", recovery_documents=docs)
    assert [(r.body_battery, r.stress) for r in jobs.recovery_days(spark, root).collect()] == [(60, None)]


def test_an_unusable_version_hides_no_good_one(spark, lake):
    root, land = lake
    pages = land("odd.json", {"data": [workout(9, 9, 13000), workout(9, 9, 13100)]}, {"data": [workout(9, 9, 13200), workout(9, 9, None)]})
    jobs.refresh(spark, root, 1, "2024-01-11 12:00:00", pages)
    assert [r.duration_sec for r in jobs.sessions(spark, root).where("workout_id = '9'").collect()] == [1320]
    assert sorted(r.id for r in jobs.rejected_workouts(spark, root).collect()) == ["7", "9"]


def test_what_other_athletes_have_stays(spark, lake):
    root, _ = lake
    for athlete in (1, 2):
        answers = spark.createDataFrame([(athlete, f"text {athlete}")], "athlete_id long, coaching string")
        for _ in range(2):  # repeated under its number
            jobs.store_coaching(spark, root, answers, "2024-01-10 13:00:00", "a-model", batch_id=athlete)
    schema = S.struct("athlete_id BIGINT, coaching STRING")
    assert rows(readers.read_snapshot(spark, f"{root}/coaching_output", schema)) == [(1, "text 1"), (2, "text 2")]
    assert jobs.tips(spark, root).count() == 2
    jobs.store_recovery_snapshot(spark, root)
    assert readers.read_snapshot(spark, f"{root}/recovery_snapshot", S.struct("athlete_id BIGINT, record_date DATE")).count() == 1


def test_broken_records_are_never_served(spark, tmp_path):
    root = str(tmp_path / "lake")
    entities = entity(spark, {"id": "a"}, {"id": "b", "confidence": 7.5}, {"id": "c", "entity_type": "workout"}, {"id": "d", "goal_text": "x"})
    offers = spark.createDataFrame([("r1", i, n) for n, i in enumerate("abcdz")] + [("r9", "a", 0)], "request_id string, id string, ordinal long")
    requests = spark.createDataFrame([("r1", "c1", "exploration", 4000, datetime(2024, 1, 28))],
                                     "request_id string, coach_id string, mode string, token_budget int, as_of timestamp_ntz")
    grants = spark.createDataFrame([("c1", "p1")], "coach_id string, participant_id string")
    for _ in range(2):  # a repeated run leaves the logs as they are
        found = jobs.serve_requests(spark, root, entities, offers, requests, grants, "?", "2024-01-28 10:00:00", batch_id=0)
        assert [o["id"] for o in json.loads(found.first().context)] == ["a"]
        audit = spark.read.parquet(f"{root}/audit")
        assert rows(audit, ["request_id", "object_id", "reason"]) == [
            ("r1", "a", "ok"), *[("r1", i, "unknown_record") for i in "bcdz"], ("r9", "a", "unknown_request")
        ]
    problems = spark.read.parquet(f"{root}/rejected_entities")
    assert rows(problems, ["id", "problem"]) == [("b", "confidence_out_of_range"), ("c", "unknown_kind"), ("d", "foreign_field")]


def test_weeks_are_read_from_their_months_only(spark, lake):
    root, _ = lake
    plan = jobs.metrics_between(spark, root, date(2024, 1, 1), date(2024, 1, 9))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_coaching_and_brief(spark, lake):
    root, _ = lake
    found = {r.athlete_id: r for r in jobs.coaching_prompts(spark, root, "a race").collect()}
    assert set(found) == {1, 2} and "Stress: 20" in found[1].prompt and not found[1].taper_active
    answers = spark.createDataFrame([(1, "Keep it easy.")], "athlete_id long, coaching string")
    jobs.store_coaching(spark, root, answers, "2024-01-10 13:00:00", "a-model")
    tip = jobs.tips(spark, root).first()
    assert (tip.author, tip.tag, tip.session_date, tip.expect_taper) == ("coach", "performance", "2024-01-09 08:00:00", False)
    taper = notes.new_tips(spark.createDataFrame(
        [(1, datetime(2024, 1, 10, 14), None, "coach", "Rest.", "recovery", None)],
        "athlete_id long, created_at timestamp_ntz, session_date string, author string, tip_text string, tag string,"
        " session_type string"))
    writers.append_tips(taper, f"{root}/tips")
    prompt = {r.athlete_id: r.prompt for r in jobs.brief_prompts(spark, root, "a race").collect()}
    assert "planned this as a recovery session" in prompt[1] and "Keep it easy." in prompt[1] and "Rest." not in prompt[2]
    output = json.loads(next(line for f in sorted(Path(f"{root}/coaching_output").glob("*/*.json"))
                             for line in f.read_text().splitlines()))
    assert output["coaching"] == "Keep it easy." and output["summary"]["split_raw_sec"] == 132.0


def test_notifications(spark, lake):
    root, _ = lake
    writers.write_briefs(spark.createDataFrame([(1, date(2024, 1, 9), "*Go*")], S.BRIEFS), f"{root}/briefs")
    found = {r.athlete_id: json.loads(r.payload) for r in jobs.notifications(spark, root, "2024-01-10", "2024-01-15").collect()}
    assert found[1]["fields"][3]["value"] == "**Go**" and found[2]["fields"][3]["value"] == ""
    assert found[1]["fields"][4]["value"].startswith("5 days")


def test_weekly_planning(spark, lake):
    root, _ = lake
    found = {r.athlete_id: r.prompt for r in jobs.weekly_prompts(spark, root, "2024-01-09").collect()}
    assert set(found) == {1, 2} and "Week before:" in found[1] and "Week before:" not in found[2]
    plan = json.dumps({"insight": "good", "next_week": [{"day": "Mon", "date": "2024-01-15", "label": "5km"}]})
    answers = spark.createDataFrame([(1, f"```json\n{plan}\n```"), (2, "no plan")], "athlete_id long, answer string")
    rejected = jobs.store_plans(spark, root, answers, "2024-01-09", "2024-01-10 12:00:00", "a-model")
    assert [r.athlete_id for r in rejected.collect()] == [2]
    schema = S.struct("athlete_id BIGINT, week_start DATE, week_end DATE, insight STRING, model STRING")
    assert rows(readers.read_snapshot(spark, f"{root}/weekly_plan", schema)) == [
        (1, "good", "a-model", date(2024, 1, 14), date(2024, 1, 8))
    ]


def test_context_requests(spark, tmp_path):
    root = str(tmp_path / "lake")
    entities = entity(spark, {"id": "a"}, {"id": "b", "tier": "silver", "confidence": 0.5}, {"id": "c", "participant_id": "p2"})
    offers = spark.createDataFrame(
        [(r, i, n) for r in ("r1", "r2") for n, i in enumerate("abc")], "request_id string, id string, ordinal long"
    )
    requests = spark.createDataFrame(
        [("r1", "c1", "exploration", 4000, datetime(2024, 1, 28)), ("r2", "c1", "execution", None, datetime(2024, 1, 28))],
        "request_id string, coach_id string, mode string, token_budget int, as_of timestamp_ntz",
    )
    grants = spark.createDataFrame([("c1", "p1")], "coach_id string, participant_id string")
    serve = lambda now, **k: jobs.serve_requests(spark, root, entities, offers, requests, grants, "next?", now, **k)
    found = {r.request_id: [o["id"] for o in json.loads(r.context)] for r in serve("2024-01-28 10:00:00").collect()}
    assert found == {"r1": ["a", "b"], "r2": ["a"]}
    log = lambda: rows(spark.read.schema(S.EXCLUSION).parquet(f"{root}/exclusions"), ["object_id", "reason_code"])
    assert log() == [("b", "pep_tier_gate"), ("c", "pep_access_denied"), ("c", "pep_access_denied")]
    assert spark.read.parquet(f"{root}/audit").count() == 6
    with pytest.raises(context.PolicyViolation):
        serve("2024-03-28 10:00:00", strict=True)
    assert len(log()) == 3  # logged before the stop; the older records have expired
    assert spark.read.parquet(f"{root}/audit").count() == 12


def test_empty_lake(spark, tmp_path):
    root = str(tmp_path / "lake")
    jobs.refresh(spark, root, 0, "2024-01-10 12:00:00")
    assert jobs.daily_metrics(spark, root).count() == 0 and jobs.coaching_prompts(spark, root, "x").count() == 0
    assert jobs.weekly_prompts(spark, root, "2024-01-09").count() == 0


def outcomes(spark, root):
    late = [(r.id, r.late) for r in jobs.late_workouts(spark, root).collect()]
    rejected = [(r.id, "rejected") for r in jobs.rejected_workouts(spark, root).collect()]
    return sorted(late + rejected + [(r.workout_id, "stored") for r in jobs.sessions(spark, root).collect()])


def test_each_file_is_taken_in_once_and_each_line_accounted_for(spark, tmp_path):
    folder, root = tmp_path / "landing", str(tmp_path / "lake")
    folder.mkdir()
    land = lambda name, *lines: (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    land("a [1].json", {"data": [workout(1, 0), workout(2, 1, None)]}, "no json", {"data": [workout(3, 2)]})
    jobs.refresh(spark, root, 0, "2024-01-10 12:00:00", str(folder))
    assert outcomes(spark, root) == [("1", "stored"), ("2", "rejected"), ("3", "stored")]
    land("b.json", {"data": [workout(4, 8), workout(5, 3), workout(6, 9, None)]}, '{"data": [')
    for _ in range(2):  # the second time repeats the batch
        jobs.refresh(spark, root, 1, "2024-01-11 12:00:00", str(folder))
        assert outcomes(spark, root) == [("1", "stored"), ("2", "rejected"), ("3", "stored"), ("4", "stored"), ("5", "before_limit"), ("6", "rejected")]
        assert sorted(r.corrupt for r in jobs.corrupt_lines(spark, root).collect()) == ["no json", '{"data": [']
    jobs.refresh(spark, root, 2, "2024-01-12 12:00:00", str(folder))
    assert spark.read.parquet(f"{root}/sessions/batch_id=2").count() == 0
    assert spark.read.parquet(f"{root}/landed_workouts").groupBy("batch_id").count().count() == 2
    assert jobs.daily_metrics(spark, root).count() == 3


def test_broken_recovery_lines_are_kept(spark, tmp_path):
    folder, root = tmp_path / "landing", str(tmp_path / "lake")
    folder.mkdir()
    day = {"athlete_id": 1, "record_date": "2024-01-09", "stress_doc": '{"overallStressLevel": 20}'}
    (folder / "a.json").write_text(json.dumps(day) + "\n{broken\n" + json.dumps({**day, "athlete_id": 2, "record_date": "someday"}))
    jobs.refresh(spark, root, 0, "2024-01-10 12:00:00", recovery_documents=str(folder))
    assert rows(jobs.recovery_days(spark, root), ["athlete_id", "stress"]) == [(1, 20)]
    assert jobs.corrupt_lines(spark, root, "recovery").count() == 2
    (folder / "b.json").write_text(json.dumps({**day, "record_date": "2024-01-10"}))
    jobs.refresh(spark, root, 1, "2024-01-11 12:00:00", recovery_documents=str(folder))
    assert jobs.recovery_days(spark, root).count() == 2
    assert spark.read.parquet(f"{root}/recovery/batch_id=1").count() == 1
